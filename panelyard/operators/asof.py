"""As-of joins of slowly changing vintages onto observations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import scan


def latest_vintages(vintages: DataFrame, key: str, time: str, order: Sequence[Column] = ()) -> DataFrame:
    """One row per (key, time): the first in ``order``. Rows without a time never become known."""
    w = Window.partitionBy(key, time).orderBy(*(order or [F.lit(1)]))
    return vintages.filter(F.col(time).isNotNull()).withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def asof_backward(left: DataFrame, vintages: DataFrame, key: str, left_time: str, right_time: str, columns: Sequence[str], order: Sequence[Column] = (), strict: bool = False, parts: int | None = None) -> DataFrame:
    """Left rows with the columns of the latest vintage known at their time (inclusive unless strict).

    Union and one window instead of a range join: both sides are sorted once by (key, time), vintages
    first, and the last vintage's struct is carried forward.  The struct is taken whole, so a NULL in
    the chosen vintage stays NULL.  One exchange by key; no row ever meets more than its predecessor.

    With ``parts`` the rows go to so many ranges of (key, time) instead of a task for each key, for keys
    that hold a large share of all rows; the vintage known at a range's beginning is carried into it.
    """
    right = latest_vintages(vintages, key, right_time, order)
    known = F.struct(*[F.col(c) for c in columns])
    a = left.select(F.col(key).alias("__k"), F.col(left_time).alias("__t"), F.lit(0 if strict else 1).alias("__side"), F.struct("*").alias("__row"), F.lit(None).cast(right.select(known).schema[0].dataType).alias("__v"))
    b = right.select(F.col(key).alias("__k"), F.col(right_time).alias("__t"), F.lit(1 if strict else 0).alias("__side"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), known.alias("__v"))
    both = a.unionByName(b)
    if parts is None:
        w = Window.partitionBy("__k").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
        out = both.withColumn("__v", F.last("__v", ignorenulls=True).over(w))
    else:  # rows of one time and side see the same vintage, whatever their order
        out = scan(both, ["__k"], ["__t", "__side"], {"__known": ("last", "__v")}, parts).drop("__v").withColumnRenamed("__known", "__v")
    out = out.filter(F.col("__row").isNotNull())
    return out.select("__row.*", *[F.col(f"__v.{c}").alias(c) for c in columns])
