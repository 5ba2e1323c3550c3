"""Ranks and running values over series of any length, in ranges of one series.

A window without keys, or with a key that holds a third of all rows, sorts and walks these rows in one
task.  Here rows are range-partitioned by key and order and written with the number of their range;
each range is ranked or scanned on its own, and a small table of one row for each key and range
carries what came before into it.  Both steps see a key's rows in as many tasks as they fill.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


def ranged(df: DataFrame, by: Sequence[str], order: Sequence[str], parts: int | None = None, spread_ties: bool = False) -> DataFrame:
    """df written in ranges of (by, order), with the number of the range in ``__range``.

    Written, since the borders come from a sample that another run of the plan would draw anew.  Equal
    keys share a range unless ``spread_ties``, which lets a hash of the row decide among them (rows equal in
    all columns stay together).
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ties = [F.xxhash64(*df.columns)] if spread_ties else []
    return written(df.repartitionByRange(n, *by, *order, *ties).withColumn("__range", F.spark_partition_id()), "ranges")


def _same(by: Sequence[str], *more: str) -> list[Column]:
    return [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*by, *more)]


def scan(df: DataFrame, by: Sequence[str], order: Sequence[str], outputs: Mapping[str, tuple[str, str]], parts: int | None = None) -> DataFrame:
    """Adds running values in order: name -> (``last`` non-null, ``product``, ``max`` or ``sum``, column).

    ``order`` must tell the rows of a key apart.  Nulls are passed over, as windows do; before the first
    value the result is null.
    """
    by, order = list(by), list(order)
    t = ranged(df, by, order, parts)
    whole = {
        "last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))), "product": lambda c: F.product(c), "max": lambda c: F.max(c), "sum": lambda c: F.sum(c),
    }
    running = {"last": lambda c: F.last(c, ignorenulls=True), "product": lambda c: F.product(c), "max": lambda c: F.max(c), "sum": lambda c: F.sum(c)}
    both = {"last": lambda a, b: F.coalesce(b, a), "product": lambda a, b: F.coalesce(a * b, a, b), "max": lambda a, b: F.greatest(a, b), "sum": lambda a, b: F.coalesce(a + b, a, b)}
    per = t.groupBy(*by, "__range").agg(*[whole[kind](c).alias(f"__{out}") for out, (kind, c) in outputs.items()])
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*by, "__range", *[running[kind](f"__{out}").over(before).alias(f"__{out}") for out, (kind, _) in outputs.items()])
    rows = t.alias("l").join(per.alias("r"), _same(by, "__range"), "left").select("l.*", *[F.col(f"r.__{out}") for out in outputs])
    so_far = Window.partitionBy(*by, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({out: both[kind](F.col(f"__{out}"), running[kind](c).over(so_far)) for out, (kind, c) in outputs.items()})
    return rows.drop("__range", *[f"__{out}" for out in outputs])


def average_ranks(df: DataFrame, x: str, by: Sequence[str], out: str = "rank", parts: int | None = None) -> DataFrame:
    """Adds the rank of x within ``by``, ties at their mean rank; rows without x are dropped.

    Rows with equal values are counted first (before the exchange, too), so only the distinct values are put in order, by ranges,
    and the rows look their rank up: no task holds or sorts a run of ties, and with few distinct values the rows stay where they are.
    """
    by = list(by)
    rows = df.filter(F.col(x).isNotNull())
    t = ranged(rows.groupBy(*by, x).agg(F.count(F.lit(1)).alias("__c")), by, [x], parts)
    per = t.groupBy(*by, "__range").agg(F.sum("__c").alias("__n"))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*by, "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    upto = F.sum("__c").over(Window.partitionBy(*by, "__range").orderBy(x).rowsBetween(Window.unboundedPreceding, 0))
    found = t.alias("l").join(F.broadcast(per.alias("r")), _same(by, "__range")).select(*[f"l.{c}" for c in by], F.col(f"l.{x}"), "l.__range", "__c", "__before")
    found = found.select(*by, x, (F.col("__before") + upto - (F.col("__c") - 1) / F.lit(2.0)).alias(out))
    return rows.alias("l").join(written(found, "ranks").alias("r"), _same(by, x)).select("l.*", F.col(f"r.{out}"))
