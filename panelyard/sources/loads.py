"""Loads that count what they do while they write: one scan, one job, one report.

Good rows, superseded duplicates and every reason of quarantine are written by the same job, in a
folder each (``status=ok``, ``status=duplicate``, ``status=bad_date``, ...), and counted on their way into the
files by an ``Observation``.  The counters sit in the last stage, whose tasks count once however often a lost
executor makes an earlier stage run again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..operators import clean

OK, DUPLICATE, SKIPPED = "ok", "duplicate", "skipped_period"
#: The reasons a price, or a vintage, can be quarantined for.
PRICE_REASONS, VINTAGE_REASONS = ("bad_date", "missing_ticker", "bad_adj_close"), ("no_availability",)
#: Parts over which rows that no key brings together are dealt.
SALTS = 4096
#: Names of skipped periods that are counted, and the sketch's room: it counts exactly up to three quarters of it.
NAMES, ROOM = 1000, 4000


def mark_duplicates(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows of status ok that share the keys: all but the first in ``order`` become duplicates.

    Other rows take part in no group; they are dealt by their hash, not by the nulls in their keys.
    """
    ok = F.col("status") == OK
    salt = F.when(~ok, 1 + F.pmod(F.xxhash64(*df.columns), F.lit(SALTS))).otherwise(0)
    w = Window.partitionBy("__salt", *[f"__k{i}" for i in range(len(keys))]).orderBy(*order)
    marked = df.withColumns({"__salt": salt, **{f"__k{i}": F.when(ok, F.col(k)) for i, k in enumerate(keys)}})
    marked = marked.withColumn("status", F.when(ok & (F.row_number().over(w) > 1), DUPLICATE).otherwise(F.col("status")))
    return marked.drop("__salt", *[f"__k{i}" for i in range(len(keys))])


def write_counted(df: DataFrame, path: str, reasons: Sequence[str], skipped: Column | None = None) -> dict[str, int | dict[str, int]]:
    """Writes rows with a ``status``, a folder for each, and returns rows_in, rows_out and the count of every other status.

    skipped: a name for each row of status ``skipped_period``; their counts per name come as a map. The names
    are few (a frequent-items sketch counts them exactly as long as it has room); ValueError if not.
    """
    seen = Observation("load")
    counts = [F.count_if(F.col("status") == s).alias(s) for s in (OK, DUPLICATE, *reasons)]
    if skipped is not None:
        counts.append(F.call_function("approx_top_k", F.when(F.col("status") == SKIPPED, skipped), F.lit(NAMES), F.lit(ROOM)).alias("names"))
    df.observe(seen, F.count(F.lit(1)).alias("rows_in"), *counts).write.mode("overwrite").partitionBy("status").parquet(path)
    got = seen.get
    report = {"rows_in": got["rows_in"], "rows_out": got[OK], "duplicates": got[DUPLICATE], **{r: got[r] for r in reasons}}
    if skipped is not None:
        report["skipped_periods"] = {x["item"]: x["count"] for x in got["names"] or [] if x["item"] is not None}  # rows of other statuses count as null
        if sum(report["skipped_periods"].values()) != got[SKIPPED]:
            raise ValueError(f"more than {NAMES} names of periods")
    return report


def load_prices(raw: DataFrame, path: str, order: Sequence[Column] = (), **columns: str) -> dict[str, int]:
    """Cleans, deduplicates by (date, ticker) and writes prices; the report. ``order``: which of several rows is kept (default: the highest price)."""
    df = clean.clean_prices(raw, **columns)
    df = df.withColumn("status", F.coalesce("quarantine_reason", F.lit(OK))).drop("quarantine_reason")
    rest = [F.col(c) for c in df.columns if c not in ("date", "ticker", "adj_close", "status")]
    return write_counted(mark_duplicates(df, ["date", "ticker"], list(order) or [F.desc("adj_close"), *rest]), path, PRICE_REASONS)


def load_vintages(raw: DataFrame, path: str, key: str = "ticker", period: str = "fiscal_period", order: Sequence[Column] = ()) -> dict[str, int | dict[str, int]]:
    """Writes trailing-period vintages with their availability date, one row for each key, date and period; the report, with the rows skipped per period."""
    known = F.coalesce(F.col(period).isin(*clean.TTM_PERIODS), F.lit(False))
    df = raw.withColumn("available_date", clean.available_date())
    df = df.withColumn("status", F.when(~known, SKIPPED).when(F.col("available_date").isNull(), VINTAGE_REASONS[0]).otherwise(OK))
    rest = [F.col(c) for c in df.columns if c not in (key, "available_date", "status")]
    df = mark_duplicates(df, [key, "available_date", period], list(order) or rest)
    return write_counted(df, path, (SKIPPED, *VINTAGE_REASONS), F.coalesce(F.col(period), F.lit("")))
