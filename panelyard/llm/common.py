"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents that are Python objects at a time; the rest of a batch stays in Arrow.
ROWS = 256
#: Bytes of a batch that goes from the JVM to a Python worker, which both hold; Spark's own bound is 64 MB.
BATCH_BYTES = 1 << 20
#: The session's setting for it, and Spark's default, which alone is replaced.
BATCH_CONF, DEFAULT_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
#: Rows of a few numbers up to which a table is broadcast; beyond it is shuffled.
BROADCAST_ROWS = 500_000


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share.

    The folder is the one named in ``spark.checkpoint.dir``; only where that is unset, in local
    tests, a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="llm-shared-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet into the shared folder and read it again.

    Unlike a cache or a local checkpoint the copy survives the loss of any executor.  ``forget``
    deletes it.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def forget(*written: DataFrame) -> None:
    """Deletes materialized tables from which nothing more is read."""
    for df in written:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small(written: DataFrame) -> DataFrame:
    """A written table of narrow rows, broadcast if their number allows."""
    return F.broadcast(written) if written.count() <= BROADCAST_ROWS else written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` in batches of bounded bytes, whatever the length of the texts.

    Spark reads the bound when it makes the physical plan, so a caller that has set one of its own keeps it.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_CONF, DEFAULT_BATCH) == DEFAULT_BATCH:
        conf.set(BATCH_CONF, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """A task's batches in small slices; afterwards its free memory goes back to the system.

    Python workers outlive their tasks, and what their allocators keep counts against the executor.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    release()


def release() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)
