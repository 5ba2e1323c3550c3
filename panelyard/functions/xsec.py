"""Cross-sectional primitives over a partition such as one date, or one date and sector."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from . import selection


def _over(by: Sequence[str]):
    return Window.partitionBy(*by)


def winsorize_sigma(x: Column, by: Sequence[str], sigma: float = 3.0) -> Column:
    """Clip to mean +- sigma sample deviations of the group; unchanged if the deviation is null or 0."""
    w = _over(by)
    m, s = F.avg(x).over(w), F.stddev_samp(x).over(w)
    clipped = F.greatest(F.least(x, m + sigma * s), m - sigma * s)
    return F.when(x.isNotNull(), F.when(s > 0, clipped).otherwise(x))


def zscore(x: Column, by: Sequence[str]) -> Column:
    w = _over(by)
    s = F.stddev_samp(x).over(w)
    return F.when(s > 0, F.try_divide(x - F.avg(x).over(w), s))


def add_group_z(df: DataFrame, columns: Sequence[str], by: Sequence[str], sigma: float = 3.0, prefix: str = "z_") -> DataFrame:
    """Winsorized z-scores of several columns: two window passes over one shared exchange."""
    clipped = df.withColumns({f"__w_{c}": winsorize_sigma(F.col(c), by, sigma) for c in columns})
    return clipped.withColumns({prefix + c: zscore(F.col(f"__w_{c}"), by) for c in columns}).drop(*[f"__w_{c}" for c in columns])


def group_percentiles(df: DataFrame, x: str, by: Sequence[str], points: Sequence[float], name: str, hot: int | None = None) -> DataFrame:
    """Interpolated percentiles per group: one row a group, to be joined back (small).

    ``percentile`` ends with a group's distinct values in one task.  With ``hot`` the groups are counted first, and
    those of more values are selected from by counting (``selection``); the result is the same.
    """
    if hot is not None:
        return selection.exact_quantiles(df, x, by, points, name, hot)
    return df.groupBy(*by).agg(F.percentile(x, F.array(*map(F.lit, points))).alias(name))


def winsorize_percentiles(df: DataFrame, x: str, by: Sequence[str], low: float = 0.01, high: float = 0.99, out: str | None = None, hot: int | None = None) -> DataFrame:
    """Clip x to its group's interpolated percentiles, also where the two are equal. hot: see ``group_percentiles``."""
    p = F.col("__p")
    edges = group_percentiles(df, x, by, (low, high), "__p", hot)
    clipped = F.greatest(F.least(F.col(x), p[1]), p[0])
    return df.join(edges, list(by), "left").withColumn(out or x, F.when(F.col(x).isNotNull(), clipped)).drop("__p")


def quantile_labels(df: DataFrame, x: str, by: Sequence[str], n: int = 5, out: str = "q", least: int | None = None, need_all: bool = False, hot: int | None = None) -> DataFrame:
    """Labels 1..n by right-closed bins on interpolated quantile edges, duplicate edges dropped.

    The label is 1 plus the number of distinct interior edges below the value.  Groups with fewer
    than ``least`` values or fewer than n distinct values get no labels; with ``need_all`` also
    those whose edges collapse to fewer than n bins.  Not ntile, which would split ties.  hot: see
    ``group_percentiles``.
    """
    least = n if least is None else least
    points = [i / n for i in range(n + 1)]
    if hot is None:
        rows = _with_sorted_edges(df, x, by, points)
    else:
        df = written(df, "label-rows")  # the edges must come from the very values that are labelled
        edges = group_percentiles(df, x, by, points, "__e", hot).join(df.groupBy(*by).agg(F.count(x).alias("__n"), F.count_distinct(x).alias("__d")), list(by))
        rows = df.join(edges, list(by), "left")
    rows = rows.withColumn("__e", F.array_sort(F.array_distinct("__e")))
    good = (F.col("__n") >= least) & (F.col("__d") >= n)
    if need_all:
        good = good & (F.size("__e") == n + 1)
    for c in by:  # rows without a group have no edges
        good = good & F.col(c).isNotNull()
    interior = F.slice("__e", F.lit(2), F.greatest(F.size("__e") - 2, F.lit(0)))
    label = 1 + F.size(F.filter(interior, lambda e: e < F.col(x)))
    return rows.withColumn(out, F.when(F.col(x).isNotNull() & good, label.cast("int"))).drop("__e", "__n", "__d")


def _with_sorted_edges(df: DataFrame, x: str, by: Sequence[str], points: Sequence[float]) -> DataFrame:
    """Adds __e, the interpolated percentiles of x in the row's group, __n values and __d distinct values of it.

    All from one sort of the rows themselves: edges aggregated beside the rows would come from another run of the plan,
    whose float sums may differ in the last bit, and then all rows tied at an edge change sides.
    """
    whole, order = _over(by), _over(by).orderBy(F.asc_nulls_last(x))
    rows = df.withColumns({"__i": F.row_number().over(order), "__d": F.dense_rank().over(order), "__n": F.count(x).over(whole)})
    at = [F.lit(p) * (F.col("__n") - 1) for p in points]
    low, high = ([F.max(F.when(F.col("__i") == f(a) + 1, F.col(x).cast("double"))).over(whole) for a in at] for f in (F.floor, F.ceil))
    rows = rows.withColumns({"__d": F.max(F.when(F.col(x).isNotNull(), F.col("__d"))).over(whole)} | {f"__{k}{i}": c for k, cs in (("l", low), ("h", high)) for i, c in enumerate(cs)})
    edges = []
    for i, a in enumerate(at):
        lo, hi = F.col(f"__l{i}"), F.col(f"__h{i}")
        edges.append(F.when(lo == hi, lo).otherwise((F.ceil(a) - a) * lo + (a - F.floor(a)) * hi))
    return rows.withColumn("__e", F.array(*edges)).drop("__i", *[f"__{k}{i}" for k in "lh" for i in range(len(points))])


def average_rank(x: str, by: Sequence[str]) -> Column:
    """Rank with ties at their mean rank. Nulls must have been dropped. A group is ranked in one task: ``operators.ranges`` splits large ones."""
    w = _over(by).orderBy(x)  # the first and the last place of a run of ties, from one sort
    return (F.rank().over(w) + F.count(F.lit(1)).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))) / F.lit(2.0)


def least_rank(x: str | Column, by: Sequence[str]) -> Column:
    """1 for the largest; ties share the least rank."""
    return F.rank().over(_over(by).orderBy(F.desc(x) if isinstance(x, str) else x.desc()))


def first_rank(x: str, by: Sequence[str], tie: str) -> Column:
    """1 for the largest; ties in order of ``tie``."""
    return F.row_number().over(_over(by).orderBy(F.desc(x), tie))


def impute_group_median(x: Column, by: Sequence[str]) -> Column:
    return F.coalesce(x, F.median(x).over(_over(by)))


def with_group_median(df: DataFrame, x: str, by: Sequence[str], out: str | None = None) -> DataFrame:
    """x with its group's median where it is null: one aggregation and a join, so no group is sorted in one task."""
    medians = df.groupBy(*[F.col(b).alias(f"__{b}") for b in by]).agg(F.median(x).alias("__m"))
    same = [F.col(b).eqNullSafe(F.col(f"__{b}")) for b in by]
    return df.join(medians, same, "left").withColumn(out or x, F.coalesce(F.col(x), F.col("__m"))).drop("__m", *[f"__{b}" for b in by])
