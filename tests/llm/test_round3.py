"""Centroids, fill-in-middle and shards against plain versions, on odd rows and on hot groups."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from panelyard.llm import fim, kmeans, shards

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, key int, size string, `a.b` int, shard_no int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", 1, "x", 1, "y", 2, 3) for i, t in rows], DOCS)


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one  two three\n"), (4, "one  two three\n"), (None, "no id here, at all"), (5, "é😀 ü \x0b x"), (6, "has <M> in it"), (7, " lead"), (8, "w" * 300_000), (9, " " * 200_000 + "x " * 100_000), (10, "<P text S> <S"), (11, "> <P M")]


def by_lists(doc_id, text):
    """The transformation with the list of units that the library never makes."""
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text) if len(text) < 100_000 else fim.UNIT.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle(spark):
    rows = ODD + [(i, f"word {'more ' * (i % 50)} <{'PSM'[i % 3]} >{i}\t end{' ' * (i % 3)}") for i in range(20, 400)]
    out = fim.restore(fim.transform(documents(spark, rows))).collect()
    want = sorted((str(i), *map(str, by_lists(i, t)), t or "") for i, t in rows)
    assert sorted((str(r["doc_id"]), *(str(r[c]) for c in ("n", "form", "prefix_chars", "middle_chars", "output")), r["restored"]) for r in out) == want
    assert {r["form"] for r in out} == {"plain", "psm", "spm"}
    assert fim.transform(documents(spark, [])).count() == 0


def test_offsets_by_rank():
    text = "a  bc\n d  "
    ends = [0, *(m.end() for m in fim.UNIT.finditer(text))]
    for i in range(len(ends)):
        for j in range(i, len(ends)):
            assert fim.offsets(text, i, j) == (ends[i], ends[j])


def test_possessive_units_are_the_same():
    rng = np.random.default_rng(0)
    plain = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
    for _ in range(300):
        text = "".join(rng.choice(list(" \n\t\x0bab é"), size=rng.integers(0, 30)))
        assert plain.findall(text) == fim.UNIT.findall(text)


def sharded(df, **options):
    return [(r["doc_id"], r["text"], *r["place"]) for r in shards.assign(df, **options).select("row.doc_id", "row.text", "place").collect()]


def plain_shards(rows, n=16, together=32):
    """One sort and one running sum."""
    order = sorted(((hashlib.md5((t or "").encode()).hexdigest(), -math.inf if i is None else i, t or "") for i, t in rows), key=lambda r: r[:2])
    size = [len(t.encode()) + 1 for _, _, t in order]
    total, at, groups, out, next_slot = sum(size), 0, {}, [], defaultdict(int)
    for (h, _, _), s in zip(order, size, strict=True):
        g = groups.setdefault(h[:15], [at, 0])
        g[1] += s
        at += s
    at = 0
    for (h, i, t), s in zip(order, size, strict=True):
        start, weight = groups[h[:15]]
        twice = 2 * start + weight if weight * n * together <= total else 2 * at + s
        shard = twice * n // (2 * total)
        out.append((i, t, s, zlib.crc32(t.encode()), shard, next_slot[shard]))
        next_slot[shard] += 1
        at += s
    return out


def same(got, want):
    return sorted((-math.inf if i is None else i, t or "", *rest) for i, t, *rest in got) == sorted(want)


def test_shards_of_odd_rows(spark):
    df = documents(spark, ODD)
    assert same(sharded(df), plain_shards(ODD)) and same(sharded(df, shards=3), plain_shards(ODD, 3))
    assert sharded(documents(spark, [])) == []
    one = sharded(documents(spark, [(1, "x")]))
    assert len(one) == 1 and one[0][-1] == 0


@pytest.mark.parametrize("hot", ["", "the same text in a third of all rows ", None])
def test_shards_with_a_hot_group(spark, monkeypatch, hot):
    monkeypatch.setattr(shards, "RANGES", 8)
    monkeypatch.setattr(shards, "PER_RANGE", 4)
    rows = [(i if i % 7 else None, hot if i % 3 == 0 else f"text {i % 1900} " * (i % 23)) for i in range(6000)] + [(12, hot)] * 500
    got = sharded(documents(spark, rows))
    assert same(got, plain_shards(rows))
    by = defaultdict(int)
    for r in got:
        by[r[4]] += r[2]
    mean = sum(by.values()) / 16
    assert len(by) == 16 and (hot is None or hot == "" or max(by.values()) < 1.04 * mean)
    # the work is spread: no range holds much more than its part
    keys = shards.materialize(shards.keyed(documents(spark, rows), ["doc_id"]), "test-keys")
    n, total = len(rows), sum(r[2] for r in got)
    cuts, totals = shards.splitters(keys, total, n, 16)
    load = totals["bytes"].to_numpy() / total + totals["n"].to_numpy() / n
    assert len(load) > 64 and load.max() < 3 * 2 / 128


def test_small_groups_stay_together(spark):
    rows = [(i, f"pair {i // 2} " * 5) for i in range(4000)]
    where = defaultdict(set)
    for _, t, *_, shard, _ in sharded(documents(spark, rows)):
        where[t].add(shard)
    assert all(len(s) == 1 for s in where.values())


def test_ranges_are_those_of_bisection():
    rng = np.random.default_rng(5)
    cuts = np.unique(rng.integers(0, 4, (12, 3)), axis=0)
    rows = rng.integers(-1, 5, (500, 3))
    want = [sum(tuple(c) <= tuple(r) for c in cuts.tolist()) for r in rows.tolist()]
    assert shards.ranges_of(*rows.T, cuts).tolist() == want


def test_written_shards(spark, tmp_path):
    rows = [(i, f"text {i} " * (i % 9)) for i in range(500)]
    df = documents(spark, rows).drop("shard_no")
    shards.write_shards(df, f"{tmp_path}/out", 4)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 500 and set(df.columns) < set(back.columns)
    assert sorted(map(str, back.select(*[f"`{c}`" for c in df.columns]).collect())) == sorted(map(str, df.collect()))
    assert {r[0] for r in back.select("shard_no").distinct().collect()} == {0, 1, 2, 3}


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 7, "c", 0.5) for i, v in rows], "vec_id bigint, embedding array<double>, own int, cluster string, of double")


def by_sql(df, **options):
    con = duckdb.connect()
    con.register("raw", df.select("vec_id", "embedding").toArrow())
    con.execute("CREATE VIEW embeddings AS SELECT * FROM raw")
    return sorted(con.execute(kmeans.oracle(**options)).fetchall())


def test_centroids_with_ties_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.integers(-2, 3, 64) / 1024).tolist()) for i in range(200)]  # tiny integers: many equal distances
    rows += [(300, rows[0][1]), (301, rows[0][1]), (5, rows[5][1]), (5, rows[6][1]), (400, (np.ones(64) * 90_000).tolist()), (401, (rng.uniform(-1, 1, 64) * 100_000).tolist())]
    odd = [(None, [0.0] * 64), (500, None), (501, [0.0] * 63), (502, [0.0] * 63 + [None]), (503, [float("nan")] + [0.0] * 63), (504, [float("inf")] * 64), (505, [1e30] + [0.0] * 63), (506, [])]
    df = vectors(spark, rows + odd)
    got = sorted(tuple(r) for r in kmeans.cluster(df).collect())
    assert got == by_sql(df) and len(got) == len(rows) and len({r[1] for r in got}) > 1
    assert kmeans.cluster(df.filter("false")).count() == 0
    few = vectors(spark, rows[:3])
    assert sorted(tuple(r) for r in kmeans.cluster(few).collect()) == by_sql(few)
    same = vectors(spark, [(i, [0.25] * 64) for i in range(20)])
    assert {r["cluster"] for r in kmeans.cluster(same).collect()} == {0}


def test_bounds_skip_distances_and_change_nothing():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 64))
    x = np.floor((centres[rng.integers(0, 8, 4000)] + 0.1 * rng.normal(size=(4000, 64))) * 1024).astype(np.int64)
    c, way, computed = x[:8].copy(), None, 0
    own, upper, lower = np.zeros(len(x), np.int32), np.full(len(x), np.inf), np.zeros((len(x), 8))
    for _ in range(10):
        if way is not None:
            upper, lower = kmeans.moved(own, upper, lower, way)
        own, upper, lower, n = kmeans.nearest(x, own, upper, lower, c, kmeans.apart(c))
        d = np.stack([kmeans.exact(x, j) for j in c], 1)
        assert (own == d.argmin(1)).all()
        assert (np.sqrt(d) >= lower).all() and (np.sqrt(d[np.arange(len(x)), own]) <= upper).all()
        computed += n
        before, c = c, kmeans.updated(np.array(kmeans.sums_of(x, own, 8), object).reshape(8, -1), c)
        way = np.sqrt(kmeans.exact(c, before).astype(float)) * (1 + kmeans.SLACK)
    assert computed < 0.45 * 10 * 8 * len(x)
