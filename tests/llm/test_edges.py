"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from panelyard.llm import ann, bpe, langid, lcp, mixing, neardup, quality, tokencount, urls, warc

WORDS = "the quick brown fox jumps over the lazy dog while seven wizards box quietly near an old stone mill".split()
LONG = " ".join(WORDS[i % 18] + str(i % 97) for i in range(30_000))
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, node string, key int, score string, __of int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, LONG, "en", "a"), (4, "One small text of words.", "en", "b"), (4, "One small text of words.", "en", "b"), (None, "A text without an id.", "en", "b"), (6, "12 34 !!", "en", None), (7, " \n\t ", "de", "b")]
    return spark.createDataFrame([(i, t, la, s, len(t or ""), "x", 1, "y", 2) for i, t, la, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in (3, 4, 6, 7)], "doc_id bigint, quality int, toxic int")


def test_token_counts(docs, none):
    out = tokencount.count_tokens(docs).collect()
    assert len(out) == 8 and tokencount.count_tokens(none).count() == 0
    by = {r["doc_id"]: r for r in out}
    assert by[1]["n_tokens"] == by[2]["n_tokens"] == by[7]["n_tokens"] == 0 and by[1]["n_bytes"] == 0
    assert by[3]["over_limit"] and by[3]["n_bytes"] == len(LONG)


def test_bpe(docs, none):
    out = bpe.encode(docs, keep_ids=True).collect()
    nothing = hashlib.sha256(b"").hexdigest()
    by = {r["doc_id"]: r for r in out}
    assert len(out) == 8 and bpe.encode(none).count() == 0
    assert by[1]["n_tokens"] == 0 and by[1]["ids_sha256"] == by[2]["decoded_sha256"] == nothing
    assert by[3]["decoded_sha256"] == hashlib.sha256(LONG.encode()).hexdigest() and len(by[3]["ids"]) == by[3]["n_tokens"]


def test_fingerprints(docs, none):
    out = lcp.fingerprints(docs, rows_per_bucket=2).collect()
    assert len(out) == 8 and lcp.fingerprints(none).count() == 0
    by = {r["doc_id"]: r for r in out}
    assert by[1]["fingerprint"] == by[2]["fingerprint"] and by[1]["near_edited"] == 1.0
    assert by[3]["near_edited"] > by[3]["near_next"] and by[3]["n_chars"] == len(LONG)
    first = "A text without an id."  # the null id comes first, so it follows the last document
    assert by[7]["edited_sha256"] == hashlib.sha256((" \n" + first[:2]).encode()).hexdigest()


def test_mixing(docs, none):
    m = mixing.mix(docs).select("row.doc_id", "row.source", "mix.*").collect()
    assert len(m) == 8 and mixing.mix(none).count() == 0
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in m)
    taken: dict = {}
    for r in m:
        taken.setdefault(r["source"], [0, r["target"]])[0] += r["taken"]
    assert all(abs(t - goal) <= 1 for t, goal in taken.values())
    assert mixing.training_set(docs).columns == docs.columns


def test_urls(spark):
    rows = [(1, None), (2, "no scheme"), (3, "HTTP://EXAMPLE.ORG/es/1?q"), (4, "http://a.com/fr/x#y"), (4, "http://a.com/fr/x#y"), (5, "https://x.org"), (6, "http://bad.com/de/1")]
    pages = spark.createDataFrame([(i, u, "<p>", 1, "z") for i, u in rows], "page_id bigint, url string, html string, host int, rule string")
    out = {r["page_id"]: r for r in urls.judge(pages).collect()}
    assert urls.judge(pages).count() == 7 and urls.judge(pages.filter("false")).count() == 0
    assert (out[1]["host"], out[1]["path"], out[1]["rule"]) == ("", "", None)
    assert (out[3]["host"], out[3]["rule"], out[3]["verdict"]) == ("example.org", "example.org/es/", "block")
    assert out[4]["verdict"] == "allow" and out[5]["rule"] is None and out[6]["verdict"] == "block"


def test_reputation_blocks_hosts_of_bad_pages(spark):
    rows = [(i, f"http://bad.com/de/{i}") for i in range(40)] + [(100 + i, f"http://good.com/fr/{i}") for i in range(40)] + [(200, "http://bad.com/other"), (201, "http://good.com/other"), (202, "http://new.net/")]
    out = {r["page_id"]: r["verdict"] for r in urls.judge(spark.createDataFrame(rows, "page_id bigint, url string")).collect()}
    assert out[200] == "block" and out[201] == "allow" and out[202] == "allow"


def test_warc(spark):
    html = [(1, "http://a/1", "x"), (2, "http://a/2\r\nX: y", "x"), (3, None, None), (4, "u", ""), (5, "u", "é" * 200_000), (None, "n", "x"), (2, "again", "x")]
    pages = spark.createDataFrame([(*r, 7, "k") for r in html], "page_id bigint, url string, html string, sum int, kept string")
    out = warc.read_records(warc.write_archives(pages), payloads=True).collect()
    assert len(out) == 7 and warc.read_records(warc.write_archives(pages.filter("false"))).count() == 0
    by = {(r["page_id"], r["url"]): r for r in out}
    assert by[(1, "http://a/1")]["refers_to"] == 2 and by[(None, "n")]["record_type"] == "revisit"
    assert by[(2, "http://a/2\r\nX: y")]["record_type"] == by[(2, "again")]["record_type"] == "response"
    assert by[(3, None)]["refers_to"] == 4 and by[(3, None)]["payload_bytes"] == 0
    assert by[(5, "u")]["payload"].decode() == "é" * 200_000 and by[(5, "u")]["payload_bytes"] == 400_000
    assert by[(4, "u")]["payload_digest"] == warc.sha1_base32(b"")


def test_large_payloads_only(spark):
    pages = spark.createDataFrame([(1, "u", "xx"), (2, "u", "xx"), (3, "u", "x"), (4, "u", "x")], "page_id bigint, url string, html string")
    out = {r["page_id"]: r["refers_to"] for r in warc.read_records(warc.write_archives(pages, least=2)).collect()}
    assert out == {1: 2, 2: None, 3: None, 4: None}


def test_quality(docs, none, labels):
    model = quality.fit(docs, labels)
    out = quality.score(docs, model).collect()
    assert len(out) == 8 and all(0 <= r["score"] <= 1 for r in out) and quality.score(none, model).count() == 0
    assert quality.score(docs, quality.fit(none, labels)).filter("score = 0.5").count() == 8
    assert quality.keep_good(docs, model).columns == docs.columns


def test_language(docs, none):
    net = langid.fit(docs, steps=3)
    out = {r["doc_id"]: r for r in langid.identify(docs, net).collect()}
    assert len(out) == 7 and langid.identify(none, net).count() == 0
    assert {out[i]["lang_pred"] for i in (1, 2, 6, 7)} == {"und"} and 0 <= out[3]["score"] <= 1 and out[3]["n_positions"] == len(LONG)
    assert {r["lang_pred"] for r in langid.identify(docs, langid.fit(none)).collect()} == {"und"}
    assert langid.keep_known(docs, net).filter("text is null").isEmpty()


def test_near_duplicates(docs, none):
    out = neardup.classes(docs).collect()
    assert len(out) == 8 and neardup.classes(none).count() == 0
    by = {r["doc_id"]: r["class_id"] for r in out}
    assert by[1] == 1 and by[2] == 2 and by[4] == 4
    kept = neardup.keep_first(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id = 4").count() == 1 and kept.count() == 7


def test_neighbours(spark):
    bad = [(1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (None, [1.0, 1.0]), (6, [1.0, 2.0, 3.0])]
    good = [(20 * i, [1.0, 0.5]) for i in range(4)] + [(7, [1.0, 0.5]), (7, [1.0, 0.5]), (8, [2.0, 0.0]), (9, [-1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 0, "r") for i, v in bad + good], "vec_id bigint, embedding array<float>, key int, rep string")
    out = ann.neighbours(df).collect()
    by: dict = {}
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert by[0] == [(8, 2.0), (7, 1.25), (20, 1.25), (40, 1.25), (60, 1.25), (9, -1.0)] and set(by) == {0, 20, 40, 60}
    assert ann.neighbours(df.filter("false")).count() == 0
    assert ann.neighbours(df.filter(F.col("vec_id") == 20)).count() == 0
