"""An incremental table: each input file owns a partition, and a manifest says which are committed.

New and changed files are transformed in one job and written by dynamic partition overwrite, so that a run
replaces just the partitions of its own inputs; then the manifest, a small JSON file for each run, is moved
into place.  A run that dies before the commit leaves partitions that no manifest names; the next run
writes the same ones again.  A run over unchanged inputs writes nothing.  Readers see the partitions of
committed inputs only.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import delete, hadoop_path

MANIFEST, DATA, INPUT = "_manifest", "data", "input"


@dataclass(frozen=True)
class Input:
    """An input file as it was when it was read."""

    path: str
    size: int
    modified: int

    @property
    def key(self) -> str:
        return "i" + hashlib.sha256(self.path.encode()).hexdigest()[:20]  # a letter first: never taken for a number


def listed(spark: SparkSession, pattern: str) -> list[Input]:
    """Files that match a path or pattern, in any file system of Hadoop; files in folders too."""
    where, p = hadoop_path(spark, pattern)
    out = []
    for status in where.globStatus(p) or []:
        files = where.listStatus(status.getPath()) if status.isDirectory() else [status]
        out += [Input(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files if not f.isDirectory() and f.getPath().getName()[0] not in "._"]
    return sorted(out, key=lambda i: i.path)


def _files(spark: SparkSession, folder: str) -> list[str]:
    where, p = hadoop_path(spark, folder)
    return sorted(f.getPath().getName() for f in where.listStatus(p)) if where.exists(p) else []


def _texts(spark: SparkSession, folder: str) -> list[str]:
    where, p = hadoop_path(spark, folder)
    if not where.exists(p):
        return []
    paths = sorted(f.getPath().toString() for f in where.listStatus(p) if f.getPath().getName().endswith(".json"))
    return ["\n".join(r[0] for r in spark.read.text(path).collect()) for path in paths]


def committed(spark: SparkSession, path: str) -> dict[str, Input]:
    """Key -> the input, of all committed runs, the later ones winning."""
    found: dict[str, Input] = {}
    for text in _texts(spark, f"{path}/{MANIFEST}"):
        run = json.loads(text)
        for x in run["inputs"]:
            found[Input(**x).key] = Input(**x)
        for key in run["gone"]:
            found.pop(key, None)
    return found


def _commit(spark: SparkSession, path: str, inputs: list[Input], gone: list[str]) -> None:
    """A manifest file under the next number; the move into place fails if another run has taken it."""
    where, folder = hadoop_path(spark, f"{path}/{MANIFEST}")
    where.mkdirs(folder)
    n = len([f for f in where.listStatus(folder) if f.getPath().getName().endswith(".json")])
    _, begun = hadoop_path(spark, f"{path}/{MANIFEST}/_{n:08d}.tmp")
    _, final = hadoop_path(spark, f"{path}/{MANIFEST}/{n:08d}.json")
    out = where.create(begun, True)
    out.write(bytearray(json.dumps({"inputs": [asdict(i) for i in inputs], "gone": gone}).encode()))
    out.close()
    if where.exists(final) or not where.rename(begun, final):
        raise RuntimeError(f"another run has committed to {path}")


def ingest(spark: SparkSession, path: str, pattern: str, build: Callable[[list[str]], DataFrame], drop_missing: bool = False) -> dict[str, int]:
    """Brings the table up to date with the input files; counts of new, changed, unchanged and dropped ones.

    build: the rows of a list of files, each with the path of its own file in the column ``input_path`` (``_metadata.file_path``
    of a file source).  drop_missing: inputs that are no longer there lose their partitions.
    """
    before, now = committed(spark, path), {i.key: i for i in listed(spark, pattern)}
    new = [i for k, i in now.items() if k not in before]
    changed = [i for k, i in now.items() if k in before and before[k] != i]
    gone = [k for k in before if k not in now] if drop_missing else []
    todo = new + changed
    if todo:
        keys = spark.createDataFrame([(i.path, i.key) for i in todo], "__path string, __key string")
        rows = build([i.path for i in todo])
        rows = rows.join(F.broadcast(keys), F.regexp_replace("input_path", "^file:/+", "/") == F.regexp_replace("__path", "^file:/+", "/"))
        rows = rows.drop("input_path", "__path").withColumnRenamed("__key", INPUT)
        old = {i.key: _files(spark, f"{path}/{DATA}/{INPUT}={i.key}") for i in changed}
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(INPUT).parquet(f"{path}/{DATA}")
        for k, files in old.items():  # a changed input without rows any more has overwritten nothing
            if files and _files(spark, f"{path}/{DATA}/{INPUT}={k}") == files:
                delete(spark, f"{path}/{DATA}/{INPUT}={k}")
    if todo or gone:
        _commit(spark, path, todo, gone)
    for k in gone:
        delete(spark, f"{path}/{DATA}/{INPUT}={k}")
    return {"new": len(new), "changed": len(changed), "unchanged": len(now) - len(todo), "dropped": len(gone)}


def read_committed(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all committed inputs, with the key of the input; other partitions are pruned."""
    return spark.read.option("basePath", f"{path}/{DATA}").parquet(f"{path}/{DATA}").filter(F.col(INPUT).isin(sorted(committed(spark, path))))
