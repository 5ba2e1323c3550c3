"""Summaries of short per-date series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranges import scan


def tstat(x: Column) -> Column:
    sd = F.stddev_samp(x)
    return F.when((F.count(x) >= 2) & (sd > 0), F.try_divide(F.avg(x), sd / F.sqrt(F.count(x).cast("double"))))


def series_summary(x: str) -> list[Column]:
    """n, mean, std, t-statistic and share of positive values."""
    c = F.col(x)
    return [
        F.count(c).alias("n"),
        F.avg(c).alias("mean"),
        F.stddev_samp(c).alias("std"),
        tstat(c).alias("tstat"),
        F.avg((c > 0).cast("double")).alias("hit_rate"),
    ]


def drawdowns(returns: DataFrame, r: str, order: str, by: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """Adds cum (compounded growth) and dd (cum over its running peak, minus one).

    Products, not logs, so a return of -1 survives.  The frames run within ``by`` (a portfolio leg);
    a leg has one row per period, so a partition is small.  For long series ``parts`` gives the number of ranges
    over which growth and peak are carried.
    """
    if parts is not None:
        grown = scan(returns.withColumn("__g", 1 + F.col(r)), by, [order], {"cum": ("product", "__g")}, parts).drop("__g")
        return scan(grown, by, [order], {"__peak": ("max", "cum")}, parts).withColumn("dd", F.try_divide("cum", "__peak") - 1).drop("__peak")
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = returns.withColumn("cum", F.product(1 + F.col(r)).over(w))
    return df.withColumn("dd", F.try_divide(F.col("cum"), F.max("cum").over(w)) - 1)


def annualized(x: str, periods: int = 12) -> tuple[Column, Column]:
    """(mean * periods, sample deviation * sqrt(periods)); the deviation is 0 for a single period."""
    return F.avg(x) * periods, F.when(F.count(x) > 1, F.stddev_samp(x) * F.sqrt(F.lit(float(periods)))).otherwise(F.lit(0.0))


def ratio_or_zero(a: Column, b: Column) -> Column:
    return F.when(b != 0, F.try_divide(a, b)).otherwise(F.lit(0.0))


def welch(df: DataFrame, x: str, flag: str) -> DataFrame:
    """One row: n and mean of x where flag is true and false, and Welch's t of the difference."""
    a, b = F.when(F.col(flag), F.col(x)), F.when(~F.col(flag), F.col(x))
    se = F.sqrt(F.var_samp(a) / F.count(a) + F.var_samp(b) / F.count(b))
    return df.agg(
        F.count(a).alias("n_true"), F.avg(a).alias("mean_true"), tstat(a).alias("t_true"),
        F.count(b).alias("n_false"), F.avg(b).alias("mean_false"), tstat(b).alias("t_false"),
        F.when((F.count(a) > 1) & (F.count(b) > 1) & (se > 0), F.try_divide(F.avg(a) - F.avg(b), se)).alias("diff_tstat"),
    )
