from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructType

from panelyard.operators import asof
from panelyard.streaming import asof_state, vintages


def test_append_and_enrich(spark, tmp_path):
    s = spark.createDataFrame
    v = s([("A", 1.0, 1), ("A", 2.0, 5)], "ticker string, x double, d int").selectExpr("ticker", "x", "make_timestamp(2024, 1, d, 0, 0, 0) AS available_at")
    p = s([("A", 3), ("A", 6), ("B", 6)], "ticker string, d int").selectExpr("ticker", "make_timestamp(2024, 1, d, 0, 0, 0) AS ts")
    for name, df in (("v", v), ("p", p)):
        df.write.parquet(str(tmp_path / name))
    stream = spark.readStream.schema(v.schema).parquet(str(tmp_path / "v"))
    vintages.append_vintages(vintages.dedup_vintages(stream), str(tmp_path / "known"), str(tmp_path / "c1")).awaitTermination(120)
    prices = spark.readStream.schema(p.schema).parquet(str(tmp_path / "p"))
    vintages.enrich_prices(prices, str(tmp_path / "known"), str(tmp_path / "out"), str(tmp_path / "c2"), ["x"]).awaitTermination(120)
    out = {(r["ticker"], r["ts"].day): r["x"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert out == {("A", 3): 1.0, ("A", 6): 2.0, ("B", 6): None}


def test_stateful_asof_equals_the_batch_join(spark, tmp_path):
    rng = np.random.default_rng(0)
    start = dt.datetime(2024, 1, 1)
    at = lambda day: start + dt.timedelta(days=float(day))
    left = [(k, at(t), i) for i, (k, t) in enumerate(zip(rng.choice(["a", "b", "c"], 120), rng.integers(0, 60, 120), strict=True))]
    right = [(k, at(t), None if t % 4 == 0 else float(t), f"v{i}", i) for i, (k, t) in enumerate(zip(rng.choice(["a", "b"], 80), rng.integers(0, 60, 80), strict=True))]  # equal times and equal to prices'
    ls, rs = "k string, ts timestamp, i int", "k string, known timestamp, x double, name string, o int"
    want = asof.asof_backward(spark.createDataFrame(left, ls), spark.createDataFrame(right, rs), "k", "ts", "known", ["x", "name"], [F.desc("o")]).collect()
    for name, rows, schema, end in (("l", left, ls, ("~", at(500), -1)), ("r", right, rs, ("~", at(500), 0.0, "", 0))):
        rows = sorted(rows, key=lambda r: (r[1] - start).days // 15 * 15 - 14 * rng.random())  # up to 30 days out of order
        for part in range(4):
            own = rows[part * len(rows) // 4 : (part + 1) * len(rows) // 4]
            spark.createDataFrame(own, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}/{part}")
        spark.createDataFrame([end], schema).coalesce(1).write.parquet(f"{tmp_path}/{name}/4")
    stream = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}/*")
    joined = asof_state.asof_stream(stream("l", ls), stream("r", rs), "k", "ts", "known", ["x", "name"], "40 days", "o")
    query = asof_state.write_asof(joined, f"{tmp_path}/out", f"{tmp_path}/check")
    query.awaitTermination(300)
    assert query.exception() is None
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 120
    assert len(query.recentProgress) >= 5
    kept = query.recentProgress[-1].stateOperators[0]
    assert kept.numRowsTotal < 40  # a vintage for each key and the closing rows, of 200 rows


def test_state_is_written_by_lists():
    class Store:
        def __init__(self):
            self.rows, self.calls = [], 0

        def appendList(self, rows):
            self.rows, self.calls = self.rows + rows, self.calls + 1

        def get(self):
            return iter(self.rows)

        def put(self, rows):
            self.rows, self.calls = rows, self.calls + 1

        def clear(self):
            self.put([])

    class Handle(dict):
        def getListState(self, name, _):
            return self.setdefault(name, Store())

        def registerTimer(self, at):
            self["timer"] = at

    class Now:
        def getCurrentWatermarkInMs(self):
            return 500

    handle, join = Handle(), asof_state.AsOf(StructType().add("i", LongType()), StructType().add("x", DoubleType()))
    join.init(handle)
    rows = [(None, None, 1000 * t, 1, (t,), None, None) for t in range(1000)] + [(None, None, 10_000 * t, 0, None, (float(t + o),), o) for t in range(100) for o in (5, 0)]
    assert list(join.handleInputRows(("k",), iter(rows), None)) == [] and handle["timer"] == 1
    got = [(r["i"], r["x"]) for r in join.handleExpiredTimer(("k",), Now(), None)]
    assert got == [(t, float(t // 10 + 5)) for t in range(500)] and handle["timer"] == 501
    assert len(handle["open"].rows) == 500 and len(handle["vintages"].rows) == 51
    assert handle["open"].calls + handle["vintages"].calls == 4
