from __future__ import annotations

import hashlib

import corpus_pipeline
import pytest
from panelyard.llm import bpe, langid, mixing, neardup, quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def nothing_stays_cached(spark):
    yield
    spark.catalog.clearCache()


@pytest.fixture(scope="module")
def labels_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 40, 3)] + [(None, 1, None), (3, None, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).persist()
        assert docs.columns == columns, name
        if name != "mixture":
            assert 0 < docs.count() <= before
            before = docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_run_equals_its_stages(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and {r["doc_id"] for r in rows} <= {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    assert sorted(map(str, rows)) == sorted(map(str, corpus_pipeline.run(spark, SF).collect()))  # reruns agree


def odd_rows(spark, n=40):
    prose = "the old mill stood near a quiet stone bridge while seven wizards talked about number {} and about {} other things"
    rows = [(i, prose.format(i * 7919, f"w{i * 31}x " * (i % 9 + 3)), "en", ["a", "b", None][i % 3], 1, "x", i, "s", True, 0.5) for i in range(n)]
    rows += [rows[3], rows[3]]  # repeated rows
    rows += [(100, rows[5][1], "en", "b", None, None, None, None, None, None), (None, rows[6][1], "en", "b", 1, "x", 1, "s", True, 0.5), (101, None, None, None, None, None, None, None, None, None)]
    rows += [(102, "", "en", "a", 0, "x", 1, "s", True, 0.5), (103, " \n", "en", "a", 0, "x", 1, "s", True, 0.5), (104, rows[0][1] * 3000, "en", "a", 0, "x", 1, "s", True, 0.5), (100, rows[7][1], "en", "b", 1, "x", 1, "s", True, 0.5)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, node string, key int, score string, row boolean, mix double")


def test_odd_rows_pass_all_stages(spark, labels_dir):
    docs = odd_rows(spark)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, labels_dir).persist()
        assert docs.columns == columns and docs.schema == odd_rows(spark).schema, name
        if name == "language":
            assert docs.filter("text is null or trim(text) = ''").isEmpty()
        if name == "near_duplicates":
            kept = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
            assert len(kept) == len(set(kept)) == len({t for _, t in kept})
    assert corpus_pipeline.STAGES[-1][1](spark, docs, labels_dir).count() == docs.count()


def test_empty_table_passes_all_stages(spark, labels_dir):
    docs = odd_rows(spark).filter("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, labels_dir)
        assert docs.count() == 0


def test_stages_decide_as_their_operators(spark):
    """Each stage on the rows that it gets, against what the operator's own query says of these rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").persist()
    net = langid.fit(docs)
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    assert ids(corpus_pipeline.language(spark, docs, SF)) == ids(langid.identify(docs, net).filter(f"lang_pred <> 'und' and score >= {corpus_pipeline.LEAST_LANGUAGE}"))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert ids(corpus_pipeline.good(spark, docs, SF)) == ids(quality.score(docs, quality.fit(docs, labels)).filter("predicted = 1"))
    assert ids(corpus_pipeline.near_duplicates(spark, docs, SF)) == ids(neardup.classes(docs).filter("doc_id = class_id").dropDuplicates(["doc_id", "node"]))
    copies = {r["doc_id"]: r["passes"] + (2 * r["part"] > r["size"]) for r in mixing.mix(docs).select("row.doc_id", "mix.*").collect()}
    assert ids(corpus_pipeline.mixture(spark, docs, SF)) == sorted(i for i, n in copies.items() for _ in range(n))
    out = corpus_pipeline.tokens(spark, docs, SF).collect()
    raw = {r["doc_id"]: r["text"].encode() for r in docs.collect()}
    assert all(r["decoded_sha256"] == hashlib.sha256(raw[r["doc_id"]]).hexdigest() for r in out) and len(out) == docs.count()
    assert ids(bpe.encode(docs)) == sorted(raw)
