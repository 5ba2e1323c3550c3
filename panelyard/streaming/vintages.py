"""Streaming ingest of vintages: deduplicated appends and as-of enrichment of price micro-batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.asof import asof_backward


def dedup_vintages(stream: DataFrame, key: str = "ticker", time: str = "available_at", delay: str = "7 days") -> DataFrame:
    """Drops repeated (key, time) within the watermark; state is bounded by ``delay``."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key, time])


def append_vintages(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends vintages to a Parquet table, partitioned by the month they became known in."""
    out = stream.withColumn("month", F.date_format("available_at", "yyyy-MM"))
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("month").outputMode("append").trigger(availableNow=True).start()


def enrich_prices(stream: DataFrame, vintages_path: str, out_path: str, checkpoint: str, columns: Sequence[str], key: str = "ticker", time: str = "ts") -> StreamingQuery:
    """Joins each micro-batch of prices as of its own times onto the vintages known so far.

    A batch writes to a folder named by its id, so a batch that runs again replaces its own rows.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        known = df.sparkSession.read.parquet(vintages_path)
        asof_backward(df, known, key, time, "available_at", columns).write.mode("overwrite").parquet(f"{out_path}/batch={epoch}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
