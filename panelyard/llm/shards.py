"""Shards of near equal bytes by sampled splitters.

The order of the records is that of the MD5 of their text, then of their id: it mixes sources and
puts equal texts next to each other.  A size-weighted sample of keys gives splitters at its quantiles;
these cut the order into many more ranges than there are shards.  Ranges are counted exactly, and
those that hold too much are subdivided by splitters from a denser sample of theirs, until none is
overfull.  A splitter keeps equal texts together, unless the group alone overfills a range: then it is
split by id and, for repeated rows, by their place in the written table.  Within a range a window adds up
sizes, before it stand the ranges' totals; so every record knows its exact place in the whole, and the
shard follows from that place: shards are as near to each other in bytes as whole records allow, and
the sample decides only how the work is spread.  Equal texts stay in one shard, that of the middle of
their group, if the group has no more than ``TOGETHER`` of a shard; larger groups are cut where they meet
a shard's end.

The sample counts a record by its size plus the mean size, so that crowds of tiny records make ranges
of their own too.  Driver and broadcasts hold ``PER_RANGE`` sampled keys and two splitters a range at
most, and there is a range for each ``RANGE_ROWS`` records, ``MOST_RANGES`` at most.

Defined results: a null text is an empty one, of size 1; null ids come first in their group; rows that
repeat id and text are records of their own; an empty table gives an empty result; fewer records than
shards leave shards empty.  Records without text need no special case: each has size 1.  Extra
columns are carried if asked for, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, in_arrow, materialize, small, table

SHARDS = 16
#: Ranges a shard, records a range from which there are more, their bound, and sampled keys a range.
RANGES, RANGE_ROWS, MOST_RANGES, PER_RANGE = 64, 500_000, 65_536, 16
#: A range with more than this, in mean ranges, is subdivided, so often at most.
OVERFULL, ROUNDS = 2.0, 6
#: Share of a shard, as 1 / TOGETHER, up to which equal texts stay in one shard.
TOGETHER = 32
#: Hash slots of the sample.
SLOTS = 1 << 30

KEY = ["key", "id", "tie"]
LEAST = -(1 << 63)


def keyed(docs: DataFrame, carry: Sequence[str]) -> DataFrame:
    """row (the carried columns), key, hash, id, tie, size, crc of every record. The group is the key: 60 bits of the hash."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LEAST)).alias("id"), F.md5(text).alias("hash"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("crc"))
    return rows.withColumn("key", F.conv(F.substring("hash", 1, 15), 16, 10).cast("bigint")).withColumn("tie", F.monotonically_increasing_id())


def ranges_of(key: np.ndarray, ids: np.ndarray, tie: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    """Number of splitters (rows of key, id, tie, in order) up to each record."""
    out = np.searchsorted(splitters[:, 0], key, side="right")
    first = np.searchsorted(splitters[:, 0], key, side="left")
    several = np.flatnonzero(out - first > 1)  # groups that several splitters cut
    for k in np.unique(key[several]):
        at = several[key[several] == k]
        own = splitters[splitters[:, 0] == k]
        order = np.lexsort((np.append(np.zeros(len(own)), np.ones(len(at))), np.append(own[:, 2], tie[at]), np.append(own[:, 1], ids[at])))
        below = np.cumsum(order < len(own))
        rows = order >= len(own)
        out[at[order[rows] - len(own)]] = first[at[0]] + below[rows]
    return out


def chosen(sample: np.ndarray, load: np.ndarray, n: int, before: int | None = None) -> np.ndarray:
    """The splitters of ``n`` equal parts of a weighted sample in order.

    The first one in a group is moved to the group's start, unless that is the key of the splitter before.
    """
    if not len(sample) or n < 2:
        return np.zeros((0, 3), np.int64)
    total = np.cumsum(load)
    cut = np.unique(np.searchsorted(total, total[-1] * np.arange(1, n) / n))
    out = sample[cut].copy()
    new = np.append(out[0, 0] != before, out[1:, 0] != out[:-1, 0])
    out[new, 1:] = LEAST
    return np.unique(out, axis=0)


def _numbered(rows: DataFrame, splitters: np.ndarray, columns: Sequence[str]) -> DataFrame:
    """The columns of the records, and their range."""
    sent = rows.sparkSession.sparkContext.broadcast(splitters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = ranges_of(*[np.asarray(b.column(c)) for c in KEY], sent.value)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in columns], pa.array(got.astype(np.int32))], names=[*columns, "range"])

    rows = rows.select(*dict.fromkeys([*KEY, *columns]))
    return rows.transform(in_arrow, run, rows.select(*columns).withColumn("range", F.lit(0)).schema)


def _sampled(rows: DataFrame, rate: Column, mean: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys in order, their load, and their range, of the records whose hash slot lies below ``rate`` times their load."""
    slot = F.pmod(F.xxhash64(*KEY), F.lit(SLOTS))
    odds = (F.col("size") + mean) * rate
    got = rows.filter(slot < odds * SLOTS).select(*KEY, (F.col("size") + mean).alias("load"), odds.alias("odds"), "range").toArrow()
    key = np.column_stack([got[c].to_numpy() for c in KEY]) if got.num_rows else np.zeros((0, 3), np.int64)
    order = np.lexsort(key.T[::-1])
    return key[order], (got["load"].to_numpy() / np.minimum(1.0, got["odds"].to_numpy()))[order], got["range"].to_numpy()[order]


def splitters(rows: DataFrame, total: int, n: int, shards: int) -> tuple[np.ndarray, DataFrame]:
    """Splitters without overfull ranges, and the records' range, size and count totals. rows: written."""
    spark, mean = rows.sparkSession, total / max(1, n)
    parts = min(max(shards * RANGES, -(-n // RANGE_ROWS)), MOST_RANGES)
    key, load, _ = _sampled(rows.withColumn("range", F.lit(0)), F.lit(parts * PER_RANGE / max(1.0, 2.0 * total)), mean)
    cuts = chosen(key, load, parts)
    for turn in range(ROUNDS + 1):
        totals = _numbered(rows, cuts, ["size"]).groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).toArrow().sort_by("range")
        held = totals["bytes"].to_numpy() + mean * totals["n"].to_numpy()
        full = np.flatnonzero((held > OVERFULL * 2.0 * total / parts) & (totals["n"].to_numpy() > 1))
        if not len(full) or turn == ROUNDS:
            return cuts, totals
        pieces = np.ceil(held[full] * parts / (2.0 * total)).astype(int)
        rates = spark.createDataFrame([(int(totals["range"][i].as_py()), float(p * PER_RANGE / held[i])) for i, p in zip(full.tolist(), pieces.tolist(), strict=True)], "full int, rate double")
        again = _numbered(rows, cuts, [*KEY, "size"]).join(F.broadcast(rates), F.col("range") == F.col("full"))
        key, load, where = _sampled(again, F.col("rate"), mean)
        new = [cuts]
        for i, p in zip(full.tolist(), pieces.tolist(), strict=True):
            number = totals["range"][i].as_py()
            of = where == number
            new.append(chosen(key[of], load[of], p, cuts[number - 1, 0] if number else None))
        more = np.unique(np.concatenate(new), axis=0)
        if len(more) == len(cuts):
            return cuts, totals
        cuts = more
    raise AssertionError


def assign(docs: DataFrame, shards: int = SHARDS, carry: Sequence[str] | None = None, together: int = TOGETHER) -> DataFrame:
    """Two structs per record: ``row`` (all its columns, or those in ``carry``) and ``place``: size, crc, shard, slot."""
    rows = materialize(keyed(docs, carry or docs.columns), "shard-keys")
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    cuts, totals = splitters(rows, total, n, shards)
    number, size, count = (totals[c].to_numpy() for c in ("range", "bytes", "n"))
    spark, bytes_before = rows.sparkSession, (np.cumsum(size) - size).astype(np.int64)
    starts = spark.createDataFrame(pa.table({"at": pa.array(number.astype(np.int32)), "bytes_before": pa.array(bytes_before), "rows_before": pa.array((np.cumsum(count) - count).astype(np.int64))}))
    hot = np.unique(cuts[cuts[:, 2] != LEAST, 0])  # groups that lie in several ranges; each begins a range
    begins = np.searchsorted(cuts[:, 0], hot) + 1
    groups = spark.createDataFrame(pa.table({"g": pa.array(hot), "g_start": pa.array(bytes_before[np.searchsorted(number, begins)])}))  # ranges without records aren't in number
    weights = rows.select("key", "size").join(F.broadcast(groups), F.col("key") == F.col("g")).groupBy("g", "g_start").agg(F.sum("size").alias("g_size"))
    weights = spark.createDataFrame(weights.toArrow())
    placed = _numbered(rows, cuts, ["row", *KEY, "hash", "size", "crc"])
    order = Window.partitionBy("range").orderBy("hash", "id", "tie")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = placed.withColumn("inner", before).withColumn("nth", F.row_number().over(order) - 1)
    group = Window.partitionBy("range", "key")
    placed = placed.withColumn("own_start", F.min("inner").over(group)).withColumn("own_size", F.sum("size").over(group))
    placed = placed.join(F.broadcast(starts), F.col("range") == F.col("at")).join(F.broadcast(weights), F.col("key") == F.col("g"), "left")
    g_start, g_size = F.coalesce("g_start", F.col("bytes_before") + F.col("own_start")), F.coalesce("g_size", "own_size")
    whole = g_size * shards * together <= total
    doubled = F.when(whole, g_start * 2 + g_size).otherwise((F.col("bytes_before") + F.col("inner")) * 2 + F.col("size"))
    placed = placed.withColumn("twice", doubled * shards)
    placed = materialize(placed.select("row", "size", "crc", F.expr(f"twice div {2 * max(1, total)}").cast("int").alias("shard"), (F.col("rows_before") + F.col("nth")).alias("at")), "shard-places")
    forget(rows)
    firsts = small(materialize(placed.groupBy(F.col("shard").alias("of")).agg(F.min("at").alias("first")), "shard-starts"))
    out = placed.join(firsts, F.col("shard") == F.col("of"))
    return out.select("row", F.struct("size", "crc", "shard", (F.col("at") - F.col("first")).alias("slot")).alias("place"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """The documents (all columns) as Parquet, a folder for each shard, its files in order of slot."""
    rows = assign(docs, shards).select("row.*", F.col("place.shard").alias("__shard"), F.col("place.slot").alias("__slot"))
    rows = rows.repartitionByRange("__shard", "__slot").sortWithinPartitions("__shard", "__slot").drop("__slot")
    rows.withColumnRenamed("__shard", "shard_no").write.partitionBy("shard_no").parquet(path)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("place")
    placed = assign(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return placed.select("row.doc_id", p["size"].alias("size"), p["crc"].alias("text_crc32"), F.lit("bytes").alias("law"), p["shard"].alias("shard"), p["slot"].alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


#: The same in one DuckDB statement: the whole order in one window, CRC-32 from its definition.
OP13_SQL = """
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size, md5(coalesce(text, '')) AS h FROM documents),
o AS (
  SELECT *, h[1:15] AS g, coalesce(sum(size) OVER w, 0)::BIGINT AS before, row_number() OVER (ORDER BY h, doc_id NULLS FIRST) - 1 AS rn,
         sum(size) OVER (PARTITION BY h[1:15])::BIGINT AS g_size, sum(size) OVER ()::BIGINT AS total
  FROM d WINDOW w AS (ORDER BY h, doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (
  SELECT *, (CASE WHEN g_size * 16 * 32 <= total THEN 2 * min(before) OVER (PARTITION BY g) + g_size ELSE 2 * before + size END * 16 // (2 * total))::INTEGER AS shard FROM o)
SELECT doc_id, size,
       xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(x, '..'), lambda b: ('0x' || b)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)::BIGINT AS text_crc32,
       'bytes' AS law, shard, rn - min(rn) OVER (PARTITION BY shard) AS slot, NULL::INTEGER AS grown_shard
FROM s, crc
"""
