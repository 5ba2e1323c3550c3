"""Stages that are built again only if something they depend on has changed.

A stage's key is a hash of its analyzed plan with the numbers of expressions made neutral, of the files it reads with
their sizes and times, and of parameters that the plan doesn't show.  It is kept beside the data and
compared before a stage is reused.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from .scratch import hadoop_path

KEY_FILE = "_stage_key"
#: Leaves of a plan whose rows come from the driver; the plan doesn't show them.
LOCAL = re.compile(r"\b(LogicalRDD|LocalRelation|ExternalRDD)\b")
FIELDS = 100_000


def normalized(df: DataFrame) -> str:
    """The analyzed plan as text, expression numbers replaced by the order they first appear in."""
    text = df._jdf.queryExecution().analyzed().treeString(True, False, FIELDS, False, False)
    numbers: dict[str, str] = {}
    return re.sub(r"#(\d+)", lambda m: "#" + numbers.setdefault(m[1], str(len(numbers))), text)


def inputs(df: DataFrame) -> list[tuple[str, int, int]]:
    """Path, size and time of every file that the plan reads."""
    spark, out = df.sparkSession, []
    for path in sorted(df.inputFiles()):
        where, p = hadoop_path(spark, path)
        status = where.getFileStatus(p)
        out.append((path, status.getLen(), status.getModificationTime()))
    return out


def stage_key(df: DataFrame, params: Mapping | None = None) -> str:
    """The hash; ValueError if rows come from the driver and no parameter stands for them."""
    plan = normalized(df)
    if LOCAL.search(plan) and not params:
        raise ValueError("rows made on the driver need a parameter that tells them apart")
    return hashlib.sha256(json.dumps([plan, inputs(df), params or {}], sort_keys=True, default=str).encode()).hexdigest()


def _kept(spark: SparkSession, path: str) -> str | None:
    where, done = hadoop_path(spark, f"{path}/_SUCCESS")
    _, key = hadoop_path(spark, f"{path}/{KEY_FILE}")
    if not where.exists(done) or not where.exists(key):
        return None
    stream = where.open(key)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def reuse(spark: SparkSession, path: str, build: Callable[[], DataFrame], params: Mapping | None = None, rebuild: bool = False, write: Callable[[DataFrame, str], None] | None = None) -> DataFrame:
    """The stage at ``path`` if it was completed for the same key, else built and written first.

    ``build`` only makes the plan.  Python functions in it show by name: their version belongs into ``params``.
    ``write`` writes another layout than plain Parquet.  The key is written last, so a stage that died half-way is built again.
    """
    df = build()
    key = stage_key(df, params)
    if rebuild or _kept(spark, path) != key:
        if write:
            write(df, path)
        else:
            df.write.mode("overwrite").parquet(path)
        where, p = hadoop_path(spark, f"{path}/{KEY_FILE}")
        out = where.create(p, True)
        out.write(bytearray(key.encode()))
        out.close()
    return spark.read.parquet(path)
