"""Trading calendars: distinct dates with positions, month ends, trade dates, offsets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def local(df: DataFrame) -> DataFrame:
    """A small table as literal rows: plans that join it often don't compute it again each time.

    Only for tables whose size is bounded by the calendar (dates, periods), never by entities.  The rows go through
    Arrow, which makes them a part of the plan; a list would become an RDD and cost a job at every use.
    """
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)


def literal(spark: SparkSession, rows: Sequence[Mapping], schema: StructType) -> DataFrame:
    """Rows made on the driver as a part of the plan."""
    return spark.createDataFrame(pa.Table.from_pylist(list(rows), to_arrow_schema(schema)), schema)


def calendar(df: DataFrame, date: str = "date") -> DataFrame:
    """date, pos: distinct dates and their 0-based positions (thousands of rows at most)."""
    return df.select(F.col(date).alias("date")).distinct().withColumn("pos", F.row_number().over(Window.orderBy("date")) - 1)


def month_ends(df: DataFrame, date: str = "date") -> DataFrame:
    """The last date present in each calendar month."""
    return df.groupBy(F.trunc(F.col(date), "month").alias("__m")).agg(F.max(date).alias("date")).select("date")


def trade_calendar(cal: DataFrame, ends: DataFrame) -> DataFrame:
    """month_end, trade_date: the first date after each month end; skipped without a date after it."""
    last = cal.agg(F.max("pos").alias("last"))
    at = ends.join(cal, "date").select(F.col("date").alias("month_end"), F.col("pos").alias("at"))
    nxt = cal.select(F.col("date").alias("trade_date"), (F.col("pos") - 1).alias("at"))
    return at.crossJoin(F.broadcast(last)).filter(F.col("at") + 2 <= F.col("last")).join(nxt, "at").select("month_end", "trade_date")


def base_dates(ends: DataFrame, cal: DataFrame, every: int = 6, first: int = 2, ahead: int = 252) -> DataFrame:
    """Every ``every``-th month end from number ``first`` on that has ``ahead`` dates after it."""
    last = cal.agg(F.max("pos").alias("last"))
    n = ends.withColumn("i", F.row_number().over(Window.orderBy("date")) - 1).join(cal, "date").crossJoin(F.broadcast(last))
    return n.filter((F.col("i") % every == first % every) & (F.col("i") >= first) & (F.col("pos") + ahead <= F.col("last"))).select("date", "pos")


def last_dates(ends: DataFrame, n: int) -> DataFrame:
    return ends.orderBy(F.desc("date")).limit(n)
