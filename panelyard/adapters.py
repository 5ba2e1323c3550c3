"""Adapters from star-schema tables to the roles of a panel (entity, date, group, price, size)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.nulls import safe_div
from .operators.panel import row_returns

PANEL_COLUMNS = ("date", "ticker", "sector", "px", "volume", "cap", "disc")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def monthly(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """date (month), ticker, px, volume, cap, disc per entity and month; partial sums before the shuffle."""
    li = read(spark, sf_dir, "lineitem").select(key, "l_shipdate", "l_quantity", "l_extendedprice", "l_discount")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")  # integer sums do not depend on order
    g = li.groupBy(F.trunc("l_shipdate", "month").alias("date"), F.col(key).alias("ticker")).agg(
        F.sum(F.col("l_quantity").cast("long")).alias("volume"), F.sum(cents).alias("cents"), F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("d"), F.count(F.lit(1)).alias("n")
    )
    return g.select("date", "ticker", safe_div(F.col("cents").cast("double"), (F.col("volume") * 100).cast("double")).alias("px"), F.col("volume").cast("double").alias("volume"), (F.col("cents").cast("double") / 100.0).alias("cap"), (F.col("d").cast("double") / (F.col("n") * 100).cast("double")).alias("disc"))


def supplier_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers by month, sector = region of the supplier's nation."""
    s = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return monthly(spark, sf_dir, "l_suppkey").join(s.select(F.col("s_suppkey").alias("ticker"), F.col("r_name").alias("sector")), "ticker").select(*PANEL_COLUMNS)


def part_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by month (sparse: gaps and disappearances), sector = brand."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("ticker"), F.col("p_brand").alias("sector"))
    return monthly(spark, sf_dir, "l_partkey").join(p, "ticker").select(*PANEL_COLUMNS)


def with_returns(panel: DataFrame, trailing=(1, 3, 12), forward=(1, 3)) -> DataFrame:
    return row_returns(panel, "px", trailing, forward)
