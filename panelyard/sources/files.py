"""Sources and sinks: zipped CSV, block-structured sheets, validated lists, partitioned Parquet, small files."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.nulls import number
from ..operators.ranges import scan
from . import zips

#: Sheet columns by position, numeric ones among them, and sector names.
SHEET_COLUMNS = ["n", "i", "company", "ticker", "currency", "last_qtr", "price", "market_cap", "high_52w", "low_52w", "pct_below_52w_high", "pct_above_52w_low", "ps_ratio", "pe_ratio", "sales_growth_q", "peg_ratio", "trailing_beta"]
SHEET_TEXT = ("company", "ticker", "currency", "last_qtr")
SECTOR_SLUGS = {
    "Consumer Discretionary": "consumer_discretionary", "Consumer Staples": "consumer_staples", "Energy": "energy", "Financials": "financials", "Health Care": "health_care", "Industrials": "industrials",
    "Materials": "materials", "Real Estate": "real_estate", "Technology": "technology", "Telecommunication": "telecommunication", "Utilities": "utilities",
}
#: Rows of a result that may come to the driver.
SMALL_ROWS = 1_000_000
#: Indexes a universe list may name, and its size.
INDEXES, UNIVERSE_SIZE = ("SP500", "NASDAQ100", "DOW"), (515, 525)


def zip_csv(spark: SparkSession, folder: str, prefix: str, contains: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """All CSV members of the folder's zip files as text columns, plus file_no (the name's last number).

    Files whose name has ``key`` in it, or lacks ``contains`` (case ignored), are left out.  Members are
    read by byte range, many tasks to an archive (``sources.zips``); the columns are those given, or the first
    file's.  A column that a file lacks is null there.
    """
    return zips.read_zips(spark, folder, prefix, contains, columns)


def read_sheet(spark: SparkSession, path: str, sheet: str = "UNIVERSE") -> DataFrame:
    """row, cells of a workbook's sheet, for ``load_sheet``; a workbook is a few hundred rows, read on the driver."""
    try:
        from openpyxl import load_workbook
    except ImportError as e:
        raise RuntimeError("reading workbooks needs openpyxl") from e
    rows = load_workbook(path, read_only=True, data_only=True)[sheet].iter_rows(values_only=True)
    return spark.createDataFrame([(i, [None if c is None else str(c) for c in r]) for i, r in enumerate(rows)], "row int, cells array<string>")


def sheet_blocks(rows: DataFrame, cells: str = "cells", row: str = "row", parts: int | None = None) -> DataFrame:
    """Rows of stacked blocks: a header has (n) in cell 0 and the sector in cell 2; a block ends at a blank.

    rows: a row number and an array of cells.  Ragged rows are padded, extra cells ignored.  A workbook's
    few hundred rows are one window; with ``parts`` the block that is open is carried over so many ranges of rows.
    """
    head, blank = F.col(cells)[0] == "(n)", F.coalesce(F.trim(F.col(cells)[0]), F.lit("")) == ""
    mark = F.when(head, F.struct(F.lit(True).alias("open"), F.get(cells, F.lit(2)).alias("sector"))).when(blank, F.struct(F.lit(False).alias("open"), F.lit(None).cast("string").alias("sector")))
    if parts is None:
        m = rows.withColumn("__m", F.last(mark, ignorenulls=True).over(Window.orderBy(row).rowsBetween(Window.unboundedPreceding, 0)))
    else:
        m = scan(rows.withColumn("__mark", mark), [], [row], {"__m": ("last", "__mark")}, parts).drop("__mark")
    m = m.filter(F.col("__m.open") & ~head & ~blank)
    return m.select(F.col(row).alias("row"), *[F.get(cells, F.lit(i)).alias(c) for i, c in enumerate(SHEET_COLUMNS)], F.col("__m.sector").alias("sector_raw"))


def load_sheet(rows: DataFrame) -> DataFrame:
    """Normalized sheet: trimmed text, numbers, sector slugs; ValueError for an unknown sector or no block."""
    b = sheet_blocks(rows)
    if b.isEmpty():
        raise ValueError("no sector blocks")
    slug = F.create_map(*[F.lit(x) for kv in SECTOR_SLUGS.items() for x in kv])
    out = b.select(*[(F.trim(c) if c in SHEET_TEXT else number(c)).alias(c) for c in SHEET_COLUMNS], "sector_raw", F.try_element_at(slug, F.trim("sector_raw")).alias("sector"))
    if lost := [r[0] for r in out.filter(F.col("sector").isNull()).select("sector_raw").distinct().limit(20).collect()]:
        raise ValueError(f"unknown sectors: {lost}")
    return out


def read_universe(spark: SparkSession, path: str, size: tuple[int, int] = UNIVERSE_SIZE) -> DataFrame:
    """ticker, index_membership of a CSV; ValueError unless columns, size and index names are right."""
    df = spark.read.csv(path, header=True)
    if df.columns != ["ticker", "index_membership"]:
        raise ValueError(f"columns are {df.columns}")
    strange = F.size(F.array_except(F.split("index_membership", r"\|"), F.array(*map(F.lit, INDEXES)))) > 0
    row = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ticker").alias("d"), F.sum(strange.cast("int")).alias("bad")).first()
    if not size[0] <= row["n"] <= size[1] or row["d"] != row["n"] or row["bad"]:
        raise ValueError(f"{row['n']} rows, {row['d']} tickers, {row['bad']} with unknown indexes")
    return df


def read_config(path: str) -> dict:
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs PyYAML") from e
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


def write_panel(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Hive layout by year; ranges of tickers of a year are brought together, so a year has few files and many tasks write it."""
    df.repartitionByRange("year", "ticker").sortWithinPartitions("year", "ticker", "date").write.mode(mode).partitionBy("year").parquet(path)


def years_of(dates: Sequence) -> list[int]:
    """Partition values that cover the dates: a filter on date alone would not prune years."""
    return sorted({int(str(x)[:4]) for x in dates})


def read_panel(spark: SparkSession, path: str, columns: Sequence[str], dates: Sequence = ()) -> DataFrame:
    """Panel columns at the given dates; years are pruned, columns and dates pushed into the scan."""
    df = spark.read.parquet(path)
    if dates:
        df = df.filter(F.col("year").isin(years_of(dates)) & F.col("date").isin([F.lit(str(x)).cast("date") for x in dates]))
    return df.select(*[c for c in columns if c in df.columns])


def write_quarantine(bad: DataFrame, path: str) -> None:
    bad.write.mode("overwrite").partitionBy("quarantine_reason").parquet(path)


def reuse(spark: SparkSession, path: str, build: Callable[[], DataFrame], rebuild: bool = False) -> DataFrame:
    """The stage written at ``path`` if it is complete, else built and written first."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if rebuild or not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_small_csv(df: DataFrame, path: str, most: int = SMALL_ROWS) -> None:
    """A small result as one CSV file; ValueError if it has more than ``most`` rows, which belong into ``df.write.csv``."""
    rows = df.limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    rows.to_csv(path, index=False)


def write_json(value: Mapping, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2, default=str)
