"""Null-safe arithmetic. NULL is the only missing marker: scans turn NaN into it, divisions give it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN -> NULL in every floating column; one projection at the scan boundary."""
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def number(c: str | Column) -> Column:
    """Coerce to double: unparseable text and NaN become NULL (under ANSI mode too)."""
    c = F.col(c) if isinstance(c, str) else c
    d = c.try_cast("double")
    return F.when(~F.isnan(d), d)


def safe_div(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def covariance_corr(x: str, y: str) -> Column:
    """Pearson correlation of complete pairs; NULL where a side is constant (corr() would raise)."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    return F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))


def row_mean(cols: Sequence[str | Column]) -> Column:
    """Mean over the non-null of several columns; NULL if there is none."""
    cs = [F.col(c) if isinstance(c, str) else c for c in cols]
    if not cs:
        return F.lit(None).cast("double")
    total, n = F.lit(0.0), F.lit(0)
    for c in cs:
        total, n = total + F.coalesce(c, F.lit(0.0)), n + c.isNotNull().cast("int")
    return F.try_divide(total, n)
