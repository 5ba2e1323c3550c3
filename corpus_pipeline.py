"""A training corpus from raw documents in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and is written
as Parquet and read again before the next.  All but the last return the columns of documents.

Defined results, at every stage: an empty table gives an empty one; extra columns, whatever their
names, are carried along up to the last stage.  Null texts and texts without letters go in the first
stage; rows that repeat id and text become one in the third, where of equal or similar texts the one
with the smallest id stays (one with a null id, if no other has an id); rows that share an id but not
a text are documents of their own; null sources are one source; the mixture repeats rows on purpose;
texts of any length are read whole.  Without labels the second stage keeps all, without languages the
first keeps none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelyard.llm import bpe, langid, mixing, neardup, quality
from panelyard.llm.common import forget, materialize, table

#: A document whose best language has less than this is rejected, as is one without letters.
LEAST_LANGUAGE = 0.3
#: A document that scores below this is rejected.
LEAST_QUALITY = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in a language that the network knows."""
    return langid.keep_known(docs, langid.fit(docs), LEAST_LANGUAGE)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality classifier accepts."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")), LEAST_QUALITY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return neardup.keep_first(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that the sources meet their targets; in training order."""
    return mixing.training_set(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, with digests of the ids and of their decoding."""
    return bpe.encode(docs, keep_ids=True)


STAGES = [("language", language), ("quality", good), ("near_duplicates", near_duplicates), ("mixture", mixture), ("tokens", tokens)]
#: Trained models and sketches cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if i:
            forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
