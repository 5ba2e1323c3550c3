"""Duplicates and latest-per-key selections, all deterministic: every order ends in a tie-break."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def longest_series(df: DataFrame, keys: Sequence[str], series: str, order: Sequence[Column] = ()) -> DataFrame:
    """Of rows that share the keys keep the one whose series has most rows, then the smallest series.

    The counts are an aggregate joined back, so a long series is counted map-side first.
    """
    n = df.groupBy(F.col(series).alias("__s")).agg(F.count(F.lit(1)).alias("__rows"))
    return first_per_key(df.join(n, F.col(series).eqNullSafe(F.col("__s")), "left"), keys, [F.desc("__rows"), F.col(series), *order]).drop("__s", "__rows")


def latest(df: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The columns of the row greatest by ``order``, per key: a partial aggregation, no sort."""
    best = F.max(F.struct(*order, *[c for c in columns if c not in order])).alias("__b")
    return df.groupBy(key).agg(best).select(key, *[F.col(f"__b.{c}").alias(c) for c in columns])


def trailing_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, n: int = 4) -> DataFrame:
    """Sum of the latest ``n`` rows per key; NULL with fewer. keys, ttm."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order])
    last = df.filter(F.col(x).isNotNull()).withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n)
    return last.groupBy(*keys).agg(F.when(F.count(x) == n, F.sum(x)).alias("ttm"))


def year_over_year(df: DataFrame, keys: Sequence[str], year: str, quarter: str, x: str) -> DataFrame:
    """Growth of the latest quarter over the same quarter a year before (by join: quarters may lack)."""
    now = first_per_key(df, keys, [F.desc(year), F.desc(quarter)])
    before = df.select(*keys, (F.col(year) + 1).alias(year), quarter, F.col(x).alias("__before"))
    return now.join(before, [*keys, year, quarter], "left").select(*keys, year, quarter, (F.try_divide(F.col(x), F.col("__before")) - 1).alias("yoy"))


def top_n(df: DataFrame, by: Sequence[str], key: Column, n: int, tie: str) -> DataFrame:
    """The n largest by ``key`` per group, rows without a key left out; ties by ``tie``."""
    w = Window.partitionBy(*by).orderBy(F.desc("__key"), tie)
    return df.withColumn("__key", key).filter(F.col("__key").isNotNull()).withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__key", "__n")


def size_key(enterprise_value: str = "enterprise_value", market_cap: str = "market_cap") -> Column:
    """Positive enterprise value, else positive market cap."""
    return F.coalesce(F.when(F.col(enterprise_value) > 0, F.col(enterprise_value)), F.when(F.col(market_cap) > 0, F.col(market_cap)))
