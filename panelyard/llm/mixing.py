"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time ``t`` in [0, 1].  Its integral is the
source's share of the mix; inverting the source's cumulative token demand tells at which time a
given word of the source is due.  Documents of a source form a stream in a pseudo-random but fixed
order (MD5 of the id, or of the text if the id is null); a document's training position is the time at which its first word is due,
and the mix is the documents range-sorted by position.

Defined results: a null text has size 0; a null source is a source of its own, last in order; rows
that repeat an id are separate documents next to each other in the stream, in order of size and
text hash; an empty table gives an
empty result; a source without words has target 0.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, log

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: What a word is.
WORD = r"[^\x20\x09-\x0D]+"
#: Weights given to the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
#: No source is repeated more often.
MAX_EPOCHS = 3
#: Documents that a block of a source's stream holds at most, about, and its least and most MD5 digits.
BLOCK_ROWS, DIGITS = 200_000, (3, 6)
#: Slope of the linear weight schedule w(t) = w * (1 + a * (2t - 1)); sign alternates by source.
SLOPE = 0.5


def _due(share: Column, slope: Column) -> Column:
    """Inverse of the cumulative demand G(t) = t + a * (t^2 - t), for a in (-1, 1), a != 0."""
    b = F.lit(1.0) - slope
    return (F.sqrt(b * b + slope * share * 4.0) - b) / (slope * 2.0)


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, slope: float = SLOPE) -> DataFrame:
    """One row per source: source_size, target, slope. sizes: source, size; many rows a source.

    Water filling in closed form: with sources ordered by cap / weight, the level is found at the
    first source whose cap exceeds it.  The single-partition windows see one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    i = F.row_number().over(order) - 1
    per = (
        per.withColumn("i", i)
        .withColumn("w", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("i") % len(weights) + 1).cast("int")).cast("long"))
        .withColumn("cap", F.col("source_size") * max_epochs)
    )
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "i")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    per = (
        per.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))))
        .withColumn("free", F.col("cap").cast("double") >= F.col("level") * F.col("w"))
    )
    level = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("w"), F.col("i"), F.col("level")))).over(every)["level"]
    return per.withColumn("at", level).select(
        "source",
        "source_size",
        F.when(F.col("at").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("at") * F.col("w"))).alias("target"),
        F.when(F.col("i") % 2 == 0, F.lit(-slope)).otherwise(F.lit(slope)).alias("slope"),
    )


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, slope: float = SLOPE, carry: Sequence[str] | None = None) -> DataFrame:
    """Two structs per document: ``row`` (all its columns, or those in ``carry``) and ``mix``: size, source_size, target, slope, goal, start, passes, part, taken.

    ``taken`` counts the words the mix takes, repeats included: every full pass over the source
    takes each document whole, the last pass ends within one document, so that a source's taken
    words are its target rounded to a word.  ``start`` is the place of the document's first word in
    its source's stream.

    The running total within a source is two-level: MD5 prefixes split each source in 4096 blocks or
    more, by the number of documents, so the largest source is summed by many tasks and only block sums meet in one.  Source figures
    travel with the block sums, so the documents are shuffled once, by source and block.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null"), F.coalesce("text", F.lit("")))).cast("binary"))
    digits = min(max(ceil(log(max(1, docs.count()) / BLOCK_ROWS, 16)), DIGITS[0]), DIGITS[1])
    narrow = docs.select("source", key.alias("key"), size.alias("size"), F.substring(order, 1, digits).alias("block"))
    blocks = narrow.groupBy("source", "key", "block").agg(F.sum("size").alias("size"))
    targets = source_targets(blocks, weights, max_epochs, slope).withColumn("t_key", key).drop("source")
    offset = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("offset", F.coalesce(F.sum("size").over(offset), F.lit(0))).join(targets, F.col("key") == F.col("t_key"))
    blocks = blocks.select("key", "block", F.struct("source_size", "target", "slope", "offset").alias("of"))
    rows = docs.select(F.struct(*(carry or docs.columns)).alias("row"), key.alias("key"), F.substring(order, 1, digits).alias("block"), order.alias("order"), size.alias("size"), F.xxhash64("text").alias("hash"))
    inside = Window.partitionBy("key", "block").orderBy("order", "size", "hash").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(blocks, ["key", "block"])
    of = F.col("of")
    rows = rows.withColumn("goal", F.round(of["target"]).cast("long")).withColumn("start", of["offset"] + F.col("inner"))
    rows = rows.withColumn("passes", F.when(of["source_size"] > 0, F.floor(F.col("goal") / of["source_size"])).otherwise(F.lit(0)).cast("long"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("goal") - F.col("passes") * of["source_size"] - F.col("start"))).cast("long")
    rows = rows.withColumn("part", part).withColumn("taken", F.col("passes") * F.col("size") + F.col("part"))
    return rows.select("row", F.struct("size", of["source_size"].alias("source_size"), of["target"].alias("target"), of["slope"].alias("slope"), "goal", "start", "passes", "part", "taken").alias("mix"))


def position(words: Column) -> Column:
    """Training position at which word number ``words`` of a source's stream is due."""
    m = F.col("mix")
    return F.round(_due(words.cast("double") / m["goal"].cast("double"), m["slope"]), 9)


def training_set(docs: DataFrame, **options) -> DataFrame:
    """The documents (all columns) as often as the mix takes them, range-sorted by position.

    The copy in which a source's last pass ends is there if more than half of it is taken.
    """
    m = F.col("mix")
    copies = m["passes"] + F.when(m["part"] * 2 > m["size"], 1).otherwise(0)
    rows = mix(docs, **options).filter(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    at = position(m["start"] + (F.col("copy") - 1) * m["source_size"])
    return rows.withColumn("at", at).orderBy("at", "row.doc_id").select("row.*")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("mix")
    mixed = mix(table(spark, sf_dir, "documents"), carry=["doc_id"])
    first = F.when((m["taken"] > 0) & (m["goal"] > 0), position(m["start"]))
    return mixed.select("row.doc_id", m["size"].alias("size"), m["source_size"].alias("source_size"), m["target"].alias("target"), m["taken"].alias("taken"), first.alias("first_position")).orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


#: The same in one DuckDB statement; the running total needs no blocks there.
OP8_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, 'null' || coalesce(text, ''))) AS k
  FROM documents),
per AS (
  SELECT *, (i % 3 + 1)::BIGINT AS w, 3 * source_size AS cap
  FROM (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS i
        FROM rows GROUP BY source)),
leveled AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER p, 0)::DOUBLE)
            / (sum(w) OVER ()::DOUBLE - coalesce(sum(w) OVER p, 0)::DOUBLE) AS level
  FROM per
  WINDOW p AS (ORDER BY cap::DOUBLE / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT arg_min(level, (cap::DOUBLE / w, i)) AS lam FROM leveled WHERE cap::DOUBLE >= level * w),
targets AS (
  SELECT source, source_size, CASE WHEN lam IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, lam * w) END AS target,
         CASE WHEN i % 2 = 0 THEN -0.5::DOUBLE ELSE 0.5::DOUBLE END AS slope
  FROM leveled, level),
placed AS (
  SELECT r.doc_id, r.size, t.source_size, t.target, t.slope, round(t.target)::BIGINT AS goal,
         coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY r.k, r.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source),
cut AS (
  SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS passes FROM placed),
took AS (
  SELECT *, (passes * size + greatest(0, least(size, goal - passes * source_size - start)))::BIGINT AS taken FROM cut)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 AND goal > 0 THEN
         round((sqrt((1.0::DOUBLE - slope) * (1.0::DOUBLE - slope) + slope * (start::DOUBLE / goal::DOUBLE) * 4.0::DOUBLE) - (1.0::DOUBLE - slope)) / (slope * 2.0::DOUBLE), 9)
       END AS first_position
FROM took
"""
