"""Operators against other implementations, brute force and held-out accuracy on driver tables."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from panelyard.llm import ann, bpe, langid, lcp, neardup, pretoken, quality, tokencount, warc
from panelyard.llm.common import table

SF = "/root/testdata/sf0.001"
ODD = ["it's we'll 'tis ሴx ℵ 12³ 漢字仮名", " " * 700, "\x1c\x1dx\x85 y", "ab" * 900, "a<|endoftext|>b <|startoftext|><|startoftext|> C <|End|>", "ΟΔΟΣ Σ İstanbul é ÅÉ Straße ﬁ", "𝔘nicode 🎉🎉 ½ ²", "'S don't I'LL x'''s  \n\n  z"]


@pytest.fixture(scope="module")
def texts(spark):
    return [r["text"] for r in table(spark, SF, "documents").select("text").collect()] + ODD


def test_splitter_equals_regex(texts):
    import regex

    split, full = pretoken.splitter(public_tokenizers.PATTERN), regex.compile(public_tokenizers.PATTERN)
    assert all(split(t) == full.findall(t) for t in texts)


def test_bpe_equals_library(spark, texts):
    import tiktoken

    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    out = bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), keep_ids=True).collect()
    for r in out:
        assert r["ids"] == lib.encode_ordinary(texts[r["doc_id"]])
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_long_words_contract_alike():
    own = bpe.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rng = random.Random(1)
    words = {"".join(rng.choice("abeinrst") for _ in range(rng.randint(1, 120))) for _ in range(200)}
    own.learn(sorted(words))
    assert all(own.ids[w] == " ".join(map(str, own.contract_long(w.encode()))) for w in words)


def test_very_long_words_equal_library():
    import tiktoken

    path, rng = public_tokenizers.path("byte_bpe_50k.tiktoken"), random.Random(2)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    own = bpe.encoder(path)
    for n in (1023, 1025, 5000):  # both ways of contraction
        word = "".join(rng.choice("etaoinshrdlu") for _ in range(n))
        own.learn([word])
        assert own.ids[word] == " ".join(map(str, lib.encode_ordinary(word))) and own.decode([word]) == word.encode()


def test_token_counts_equal_library(texts):
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), tokencount.counter(public_tokenizers.path("word_bpe_49k.json"))
    assert [own.count(t) for t in texts] == [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_gradients_match_differences():
    net, rng = langid.Network.new(["a", "b", "c"], 4), np.random.default_rng(0)
    seq = rng.integers(97, 105, (6, 5)).astype(np.intp)
    seq[4:, 2] = langid.PAD
    lang = np.array([0, 1, 2, 0, 1])
    _, grads = net.gradients(seq, lang)
    for p, g in ((net.u, grads[1]), (net.o, grads[2]), (net.c, grads[3]), (net.x, grads[0])):
        for _ in range(5):
            at = tuple(rng.integers(0, s) for s in p.shape)
            old, step = p[at], 1e-2
            p[at] = old + step
            up, _ = net.gradients(seq, lang)
            p[at] = old - step
            down, _ = net.gradients(seq, lang)
            p[at] = old
            if p is not net.x or at[2] != langid.PAD:
                assert abs((up - down) / (2 * step) - g[at]) < 2e-3


def test_language_held_out(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    out = langid.identify(docs, langid.fit(docs, per_lang=60, steps=120)).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] >= 0.97


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    out = quality.score(docs, quality.fit(docs, labels)).filter("held_out").join(labels.select("doc_id", "quality"), "doc_id")
    assert out.agg(F.avg((F.col("quality") == F.col("predicted")).cast("double"))).first()[0] >= 0.95


def test_phrases_do_not_depend_on_offset():
    rng = random.Random(3)
    body = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    for shift in ("", "x", "yz", "another start "):
        assert lcp.likeness(lcp.fingerprint(shift + body), lcp.fingerprint(body)) > 0.9
    other = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    assert lcp.likeness(lcp.fingerprint(other), lcp.fingerprint(body)) < 0.2
    together = lcp.sketches([body, "", other, "a", "aaaa"])
    assert (together[0] == lcp.fingerprint(body)).all() and (together[2] == lcp.fingerprint(other)).all()


def test_fingerprints_next_and_edited(spark):
    docs = table(spark, SF, "documents")
    rows = docs.orderBy("doc_id").collect()
    out = {r["doc_id"]: r for r in lcp.fingerprints(docs, rows_per_bucket=30).collect()}
    for i, r in enumerate(rows):
        changed = lcp.edited(r["text"], rows[(i + 1) % len(rows)]["text"])
        assert out[r["doc_id"]]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert out[r["doc_id"]]["edited_fingerprint"] == lcp.to_hex(lcp.fingerprint(changed))


def naive_level(symbols):
    """Runs, coin tossing and local maxima symbol by symbol, without arrays."""
    top = (1 << 64) - 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & top
        x = (x ^ x >> 27) * 0x94D049BB133111EB & top
        return x ^ x >> 31

    runs = []
    for x in symbols:
        if runs and runs[-1][0] == x:
            runs[-1][1] += 1
        else:
            runs.append([x, 1])
    s = [x if n == 1 else mix((x + mix(n)) & top) for x, n in runs]
    label = s
    for _ in range(3):
        tossed = [0]
        for left, x in zip(label, label[1:]):
            place = ((left ^ x) & -(left ^ x)).bit_length() - 1
            tossed.append(2 * place + (x >> place & 1))
        tossed[0] = (tossed[1] if len(s) > 1 else 0) ^ 1
        label = tossed
    starts = [0] + ([i for i in range(1, len(s) - 1) if label[i - 1] < label[i] > label[i + 1]] if len(s) >= 4 else [])
    names = []
    for a, b in zip(starts, starts[1:] + [len(s)]):
        total = 0
        for place, x in enumerate(s[a:b], 1):
            h = ((place * 0x9E3779B97F4A7C15 & top) ^ x) * 0xBF58476D1CE4E5B9 & top
            total += (h ^ h >> 32) * 0x94D049BB133111EB
        names.append(mix(total & top))
    return names, mix


def naive_fingerprint(text):
    symbols, slots = [ord(c) + 1 for c in text], [0xFFFF] * 64
    for depth in (1, 2, 3) if symbols else ():
        symbols, mix = naive_level(symbols)
        for x in symbols if depth > 1 else ():
            h = mix((x + depth) & ((1 << 64) - 1))
            slots[(h >> 32) % 64] = min(slots[(h >> 32) % 64], (h & 0xFFFFFFFF) % 0xFFFF)
    return slots


def naive_likeness(a, b):
    filled = [(x, y) for x, y in zip(a, b) if x != 0xFFFF or y != 0xFFFF]
    return sum(x == y for x, y in filled) / len(filled) if filled else 1.0


def test_fingerprints_equal_a_naive_parser(spark):
    rows = table(spark, SF, "documents").select("doc_id", "text").orderBy("doc_id").limit(60).collect()
    extra = ["", "a", "ab", "aaaa", "abc" * 3, "x" * 50 + "yx", None, "ab" * 400, "a\U0001F389b" * 30]
    texts = [r["text"] for r in rows] + extra
    out = {r["doc_id"]: r for r in lcp.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), rows_per_bucket=7).collect()}
    texts = [x or "" for x in texts]
    prints = [naive_fingerprint(x) for x in texts]
    for i, text in enumerate(texts):
        following = (i + 1) % len(texts)
        half = len(text) // 2
        changed = text[: len(text) - half] + texts[following][:half]
        other = naive_fingerprint(changed)
        assert out[i]["fingerprint"] == "".join(f"{x:04x}" for x in prints[i]) and out[i]["edited_fingerprint"] == "".join(f"{x:04x}" for x in other)
        assert out[i]["near_edited"] == naive_likeness(prints[i], other) and out[i]["near_next"] == naive_likeness(prints[i], prints[following])
        assert out[i]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest() and out[i]["n_chars"] == len(text)


def test_long_texts_are_parsed_alike_in_parts():
    rng = random.Random(1)
    for _ in range(150):
        alphabet = rng.choice(["ab", "abcdefgh ", " "])
        text = "".join(rng.choice(alphabet) * rng.choice([1, 1, 1, 1, 2, 5, 40]) for _ in range(rng.choice([1, 2, 3, 4, 5, 10, 50, 300])))
        whole = lcp.fingerprint(text)
        assert all((lcp.sketches([text], block)[0] == whole).all() for block in (1, 2, 3, 7, 50))
    body = "".join(rng.choice("abcdefgh ") for _ in range(3_000_000))
    a, b = lcp.sketches([body, "q" + body])
    assert lcp.likeness(a, b) == 1.0


def naive_network(net, raw):
    """Mean of the position probabilities of one window, gate by gate and byte by byte."""
    def sigmoid(x):
        return 1 / (1 + np.exp(-x))

    states = []
    for d, order in ((0, range(len(raw))), (1, range(len(raw) - 1, -1, -1))):
        h, own = np.zeros(net.u.shape[-1]), {}
        for t in order:
            z, r = (sigmoid(net.x[d, g, raw[t]].astype(float) + h @ net.u[d, g].astype(float)) for g in (0, 1))
            n = np.tanh(net.x[d, 2, raw[t]].astype(float) + r * (h @ net.u[d, 2].astype(float)))
            h = own[t] = (1 - z) * n + z * h
        states.append(own)
    total = 0
    for t in range(len(raw)):
        e = np.exp(np.concatenate([states[0][t], states[1][t]]) @ net.o.astype(float) + net.c)
        total = total + e / e.sum()
    return total


def test_language_equals_a_naive_network(texts):
    rng = np.random.default_rng(0)
    seqs = rng.integers(97, 123, (60, langid.WINDOW)).astype(np.int16)
    net = langid.train(seqs, rng.integers(0, 3, 60), ["a", "b", "c"], steps=5)
    some = [t for t in texts[:25] + ODD if t]
    for text, (lang, score, n, _) in zip(some, langid.label(some, net), strict=True):
        raw = text.encode()
        p = sum(naive_network(net, raw[at : at + langid.WINDOW]) for at in range(0, len(raw), langid.WINDOW)) / len(raw)
        assert lang == "und" or (n == len(raw) and abs(score - p.max()) < 1e-3 and abs(p[net.langs.index(lang)] - p.max()) < 1e-3)
    assert [x[0] for x in langid.label(["½ ²", "Ⅷ", "③ 12", "_"], net)] == ["und"] * 4


def test_seventy_languages(spark):
    docs = spark.createDataFrame([(i, f"lang{i % 70}", " ".join([f"w{i % 70}x"] * 20)) for i in range(700)], "doc_id bigint, lang string, text string")
    assert len(langid.fit(docs, steps=2).langs) == 70


def test_descent_reaches_the_optimum():
    """The hinge loss with the quadratic penalty cannot be lowered by subgradient steps from what the descent finds."""
    rng = np.random.default_rng(2)
    rows = [np.flatnonzero(rng.random(12) < 0.4) for _ in range(60)]
    y = np.where(np.array([len(r) and r[0] < 2 for r in rows]) ^ (rng.random(60) < 0.1), 1, -1)
    ratio = rng.normal(0, 1, 12)
    x = np.zeros((60, 13))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / max(1.0, len(r) ** 0.5)
    x[:, 12] = 1
    c = quality.C * np.where(y > 0, 60 / (2 * (y > 0).sum()), 60 / (2 * (y < 0).sum()))

    def objective(w):
        return 0.5 * w @ w + (c * np.maximum(0, 1 - y * (x @ w))).sum()

    w, b = quality.descend(rows, y, ratio, passes=2000)
    found, best = objective(np.append(w, b)), np.inf
    own = np.zeros(13)
    for step in range(1, 60_001):
        slack = 1 - y * (x @ own) > 0
        own = own - (own - (c * y * slack) @ x) / step
        best = min(best, objective(own))
    assert found <= best + 1e-6 * abs(best)


def test_quality_scores_equal_a_naive_model(spark, texts):
    rng = np.random.default_rng(4)
    model = quality.Model(rng.normal(0, 1, quality.SPACE).astype(np.float32), 0.2, 1.3, -0.1)
    some = [t for t in texts[:30] + ODD]
    out = {r["doc_id"]: r["score"] for r in quality.score(spark.createDataFrame(list(enumerate(some)), "doc_id bigint, text string"), model).collect()}
    for i, text in enumerate(some):
        raw, found = text.encode(), set()
        for n in quality.LENGTHS:
            for at in range(len(raw) - n + 1):
                h = 0
                for byte in raw[at : at + n]:
                    h = (h + 1) * 0x01000193 & 0xFFFFFFFF ^ (byte * 0x9E3779B1 & 0xFFFFFFFF)
                found.add((h ^ h >> 15) & quality.SPACE - 1)
        margin = model.bias + sum(float(model.weights[f]) for f in found) / max(1.0, len(found) ** 0.5)
        assert abs(out[i] - 1 / (1 + np.exp(-(model.slope * margin + model.offset)))) < 1e-9


def edit_distance(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


def test_banded_distance_equals_full():
    rng = random.Random(5)
    for _ in range(600):
        a = [rng.choice("abcd") for _ in range(rng.randint(0, 25))]
        b = list(a) if rng.random() < 0.7 else [rng.choice("abcd") for _ in range(rng.randint(0, 25))]
        for _ in range(rng.randint(0, 6)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = [rng.choice("abcd")] * rng.randint(0, 1)
        most = rng.randint(0, 12)
        assert neardup.distance(a, b, most) == min(edit_distance(a, b), most + 1)


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(60, 200))]
        for _ in range(rng.choice([1, 1, 4])):
            copy = list(base)
            for _ in range(len(copy) // 40):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(copy)
        texts.append([rng.choice(vocabulary) for _ in range(150)] + passage)
    texts += [texts[0], texts[0]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if edit_distance(texts[i], texts[j]) <= int(0.2 * max(len(texts[i]), len(texts[j])) + 1e-9):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert {r["doc_id"]: r["class_id"] for r in neardup.classes(df).collect()} == dict(enumerate(root))


def classes_by_all_pairs(texts):
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            most = int(0.2 * max(len(texts[i]), len(texts[j])) + 1e-9)
            if root[i] != root[j] and neardup.distance(texts[i], texts[j], most) <= most:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return dict(enumerate(root))


def found_classes(spark, texts):
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    return {r["doc_id"]: r["class_id"] for r in neardup.classes(df).collect()}


def test_near_duplicates_that_quote_what_many_quote(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(4):
        passage = [f"p{rng.randrange(10**6)}" for _ in range(80)]
        texts += [passage + [f"o{rng.randrange(10**6)}" for _ in range(20)] for _ in range(2)]
        texts += [passage + [f"l{rng.randrange(10**6)}" for _ in range(rng.randint(30, 300))] for _ in range(60)]
    assert found_classes(spark, texts) == classes_by_all_pairs(texts)


def test_near_duplicates_of_many_versions(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    versions = []
    for _ in range(60):
        at = set(rng.sample(range(100), rng.randint(6, 14)))
        versions.append([f"v{rng.randrange(10**6)}" if i in at else w for i, w in enumerate(base)])
    # a bridge: b ~ a, a ~ c, b !~ c, whichever of them comes first in a bucket
    bridges = []
    for _ in range(20):
        a = [f"a{rng.randrange(10**6)}" for _ in range(50)]
        bridges += [a, [f"b{i}" if i % 6 == 0 else w for i, w in enumerate(a)], [f"c{i}" if i % 6 == 3 else w for i, w in enumerate(a)]]
    texts = versions + bridges
    assert found_classes(spark, texts) == classes_by_all_pairs(texts)


def test_near_duplicates_in_cells(spark, monkeypatch):
    # cells and parts much smaller than the buckets: every pair must still meet
    monkeypatch.setattr(neardup, "CELL", 4)
    monkeypatch.setattr(neardup, "HOT", 20)
    monkeypatch.setattr(neardup.cells, "__defaults__", (4, 300))
    rng = random.Random(13)
    passage, texts = [f"p{rng.randrange(10**6)}" for _ in range(80)], []
    for _ in range(30):
        own = [f"o{rng.randrange(10**6)}" for _ in range(rng.randint(10, 40))]
        texts += [passage + own, own[: len(own) // 2] + passage + own[len(own) // 2 :]]
    assert found_classes(spark, texts) == classes_by_all_pairs(texts)


@pytest.mark.parametrize("stretch", [3, 8, 4096])
def test_distance_in_stretches(monkeypatch, stretch):
    monkeypatch.setattr(neardup, "STRETCH", stretch)
    rng = random.Random(stretch)
    for _ in range(400):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(30))] for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        most = rng.randrange(20)
        assert neardup.distance(a, b, most) == min(row[-1], most + 1)


def test_sketches_of_repeated_lines_meet():
    rng = random.Random(9)
    for kinds, least in ((3, 0.93), (10, 0.95)):
        met = 0
        for i in range(250):
            lines = [[f"w{rng.randrange(10**6)}" for _ in range(8)] for _ in range(kinds)]
            text = [w for _ in range(20) for w in rng.choice(lines)]
            n = len(text)
            at = set(rng.sample(range(n), n // 5) if i % 2 else range(2, n, 5))
            other = [f"x{j}" if j in at else w for j, w in enumerate(text)]
            assert neardup.similar(text, other)
            met += bool({*neardup.sketched(text)} & {*neardup.sketched(other)})
        assert met / 250 >= least, (kinds, met)


def test_sketches_meet_at_the_threshold():
    rng = random.Random(6)
    for similarity, least in ((0.9, 0.999), (0.85, 0.995), (0.8, 0.985)):
        met = 0
        for i in range(400):
            n = rng.randint(40, 300)
            text, edits = [f"w{rng.randrange(10**6)}" for _ in range(n)], int((1 - similarity) * n + 1e-9)
            at = set(rng.sample(range(n), edits) if i % 2 else range(1, n, n // edits))  # scattered, or as far apart as can be
            met += bool({*neardup.sketched(text)} & {*neardup.sketched([f"x{j}" if j in at else w for j, w in enumerate(text)])})
        assert met / 400 >= least


def test_near_duplicates_at_the_threshold(spark):
    rng = random.Random(4)
    texts = []
    for n in [5, 6, 9, 10, 10, 14, 15, 20, 40, 60, 100, 300, 1000] * 3:
        text = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        at = set(rng.sample(range(n), n // 5))
        texts += [text, [f"x{rng.randrange(10**6)}" if i in at else w for i, w in enumerate(text)]]
    ten = [f"t{i}" for i in range(10)]
    texts += [ten, ten[:5] + ["other"] + ten[6:]]
    want = classes_by_all_pairs(texts)
    assert len(set(want.values())) == len(texts) // 2
    assert found_classes(spark, texts) == want


def test_neighbours_against_brute_force(spark):
    df = table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = df.select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    found: dict = {}
    for r in ann.neighbours(df, sample=400, leaf=64).collect():  # the trees know a fifth of the vectors
        found.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    hits = []
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        want = [j for j in np.lexsort((ids, -s)) if j != i][:20]
        assert len(found[ids[i]]) == 20 and all(abs(v - s[np.flatnonzero(ids == k)[0]]) < 1e-9 for k, v in found[ids[i]].items())
        hits.append(len({ids[j] for j in want} & set(found[ids[i]])) / 20)
    assert np.mean(hits) >= 0.9


def test_neighbours_of_clustered_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 48))[rng.integers(0, 200, 20_000)] + 0.3 * rng.normal(size=(20_000, 48))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id bigint, embedding array<double>")
    found: dict = {}
    for r in ann.neighbours(df, every=50, sample=8000, room=3000).collect():  # many parts
        found.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    hits = []
    for i in range(0, 20_000, 50):
        s = x @ x[i]
        s[i] = -np.inf
        assert len(found[i]) == 20 and all(abs(v - s[k]) < 1e-9 for k, v in found[i].items())
        hits.append(len({*np.argsort(-s)[:20].tolist()} & {*found[i]}) / 20)
    assert np.mean(hits) >= 0.9
    forest = ann.grow(x[rng.permutation(len(x))[:8000]], len(x), float(np.linalg.norm(x, axis=1).max()))
    leaves, met = forest.leaves(x) + np.arange(ann.TREES)[:, None] * forest.sizes.shape[1], []
    assert forest.sizes.shape[1] >= 64 and forest.sizes.max() < 1000
    set_rule(forest, x, range(1, 20_000, 200))
    for i in range(0, 20_000, 200):
        met.append(np.isin(leaves, forest.search(x[i])).any(0).mean())
    assert np.mean(met) < 0.3


def set_rule(forest, x, trials):
    score = x[list(trials)] @ x.T
    score[np.arange(len(score)), list(trials)] = -np.inf
    forest.set_rule(x[list(trials)], [x[np.argsort(-s)[:20]] for s in score])


@pytest.mark.parametrize(("clusters", "sample", "spread"), [(200, 2000, 0.0), (2000, 2000, 0.0), (2000, 20_000, 0.0), (200, 2000, 0.5)])
def test_stop_rule_meets_a_small_share_of_clustered_vectors(clusters, sample, spread):
    rng = np.random.default_rng(7)
    n = 60_000
    x = (rng.normal(size=(clusters, 64))[rng.integers(0, clusters, n)] + 0.3 * rng.normal(size=(n, 64))) * np.exp(spread * rng.normal(size=(n, 1)))  # spread: of their lengths
    forest = ann.grow(x[rng.permutation(n)[:sample]], n, float(np.linalg.norm(x, axis=1).max()))
    set_rule(forest, x, rng.choice(n, 100, replace=False).tolist())
    leaves = forest.leaves(x) + np.arange(ann.TREES)[:, None] * forest.sizes.shape[1]
    recall, scored = [], []
    for i in rng.choice(n, 100, replace=False):
        s = x @ x[i]
        s[i] = -np.inf
        met = np.isin(leaves, forest.search(x[i]))
        recall.append(met.any(0)[np.argsort(-s)[:20]].mean())
        scored.append(met.sum() / n)
    assert np.mean(recall) >= 0.9 and np.mean(scored) < 0.3


def test_large_leaves_fill_several_parts(spark):
    sizes = np.array([[5.0, 100.0, 20.0, 20.0]])
    assert ann.laid_out(sizes, 40) == [(0, 1), (1, 3), (4, 1), (4, 1)]
    x = np.random.default_rng(1).normal(size=(600, 4))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id bigint, embedding array<double>")
    found = {(r["query_id"], r["rank"]): r["vec_id"] for r in ann.neighbours(df, leaf=600, room=50).collect()}  # one leaf, so exact
    for i in range(0, 600, 20):
        s = x @ x[i]
        s[i] = -np.inf
        assert [found[i, n] for n in range(1, 21)] == np.argsort(-s)[:20].tolist()


def test_neighbours_of_equal_scores(spark):
    # one-hot vectors: nearly all scores tie, so the smallest ids must win
    df = spark.createDataFrame([(i, [1.0 if j == i % 7 else 0.0 for j in range(7)] + [float(i // 7 % 3 == 0)]) for i in range(400)], "vec_id bigint, embedding array<double>")
    x = {r["vec_id"]: np.array(r["embedding"]) for r in df.collect()}
    found = {(r["query_id"], r["rank"]): r["vec_id"] for r in ann.neighbours(df, leaf=2).collect()}
    exact = {(r["query_id"], r["rank"]): r["vec_id"] for r in ann.neighbours(df, leaf=1000).collect()}
    for i in range(0, 400, 20):
        want = sorted((j for j in x if j != i), key=lambda j: (-x[j] @ x[i], j))[:20]
        assert [exact[i, n] for n in range(1, 21)] == want and found[i, 1] == want[0]


def test_warc_record_round_trip():
    raw = warc.record(5, "http://x/ü?a=b", b"payload", warc.sha1_base32(b"payload"), None)
    got = warc.parse(raw)
    assert (got["page_id"], got["url"], got["payload"], got["record_type"]) == (5, "http://x/ü?a=b", b"payload", "response")
    with pytest.raises(ValueError, match="damaged"):
        warc.parse(raw.replace(b"payload", b"pay1oad"))
    assert list(warc.coalesced([(0, 10), (10, 5), (200_000, 5)])) == [[0, 1], [2]]
