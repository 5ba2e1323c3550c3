"""Quantiles, ranks and running values of large groups against the plain windows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelyard.functions import selection, xsec
from panelyard.functions.stats import drawdowns
from panelyard.operators import asof, ranges
from panelyard.sources import files


def test_exact_quantiles_of_odd_distributions(spark):
    rng = np.random.default_rng(0)
    groups = {
        "normal": rng.normal(size=7000), "ties": rng.integers(0, 3, 6000).astype(float), "one": np.full(5000, 7.5), "two": np.repeat([0.0, 1.0], [2500, 2500]),
        "wild": np.concatenate([rng.normal(size=3000), [1e300, -1e300, 1e-300, 0.0, -0.0]]), "small": rng.normal(size=20), "none": np.array([np.nan]),
    }
    rows = [(g, None if np.isnan(v) else float(v)) for g, vs in groups.items() for v in vs] + [(None, float(v)) for v in range(3000)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(6)
    points = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    got = {r["g"]: r["p"] for r in selection.exact_quantiles(df, "x", ["g"], points, "p", hot=1000, few=50).collect()}
    want = {r["g"]: r["p"] for r in xsec.group_percentiles(df, "x", ["g"], points, "p").collect()}
    assert got == want and len(got) == 8


def test_two_million_values_of_one_date(spark):
    df = spark.range(0, 2_000_000, 1, 8).select("id", F.lit("d").alias("date"), F.when(F.col("id") % 3 > 0, F.sqrt(F.pmod(F.xxhash64("id"), F.lit(1 << 40)).cast("double"))).otherwise(5.0).alias("x"))
    points = [0.01, 0.2, 0.4, 0.6, 0.8, 0.99]
    got = selection.exact_quantiles(df, "x", ["date"], points, "p", hot=100_000).first()["p"]
    x = np.sort(df.select("x").toPandas()["x"].to_numpy())
    assert got == pytest.approx(np.quantile(x, points).tolist(), rel=1e-12)
    ranked = ranges.average_ranks(df, "x", ["date"], parts=8)
    sums = ranked.groupBy("date").agg(F.sum(F.col("rank")).alias("s"), F.max(F.when(F.col("x") == 5.0, F.col("rank"))).alias("tie"), F.count("rank").alias("n")).first()
    below, ties = int((x < 5.0).sum()), int((x == 5.0).sum())
    assert sums["n"] == 2_000_000 and sums["s"] == 2_000_000 * 2_000_001 / 2 and sums["tie"] == below + (ties + 1) / 2
    per_task = ranges.ranged(df, ["date"], ["x"], 8, spread_ties=True).groupBy("__range").count().collect()
    assert len(per_task) >= 7 and max(r["count"] for r in per_task) < 500_000  # also the run of one value, a third of all, is spread


def test_winsorizing_and_labels_by_selection(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(int(i % 2), float(v)) for i, v in enumerate(rng.normal(size=4000).round(2))], "g int, x double")
    for f in (lambda **o: xsec.winsorize_percentiles(df, "x", ["g"], **o), lambda **o: xsec.quantile_labels(df, "x", ["g"], **o)):
        assert sorted(map(tuple, f(hot=100).collect())) == sorted(map(tuple, f().collect()))


def test_average_ranks_equal_the_window(spark):
    rng = np.random.default_rng(2)
    rows = [(None if g == 3 else int(g), float(x), i) for i, (g, x) in enumerate(zip(rng.integers(0, 4, 3000), rng.integers(0, 30, 3000), strict=True))] + [(9, None, -1)]
    df = spark.createDataFrame(rows, "g int, x double, i int")
    want = df.filter("x is not null").withColumn("rank", xsec.average_rank("x", ["g"]))
    for parts in (1, 3, 16):
        got = ranges.average_ranks(df, "x", ["g"], parts=parts)
        assert got.columns == want.columns and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert ranges.average_ranks(df.filter("false"), "x", ["g"]).count() == 0


def test_average_ranks_put_only_distinct_values_in_order(spark, monkeypatch):
    counts, plain = [], ranges.ranged

    def counted(df, *args, **options):
        counts.append(df.count())
        return plain(df, *args, **options)

    monkeypatch.setattr(ranges, "ranged", counted)
    df = spark.range(20_000).select((F.col("id") % 2).alias("g"), (F.col("id") % 50).cast("double").alias("x"))
    ranks = {(r["g"], r["x"], r["rank"]) for r in ranges.average_ranks(df, "x", ["g"], parts=4).collect()}
    assert ranks == {(x % 2, float(x), x // 2 * 400 + 200.5) for x in range(50)} and counts == [50]


def test_scan_equals_the_window(spark):
    rng = np.random.default_rng(3)
    rows = [(["a", "b", None][int(g)], i, None if rng.random() < 0.6 else float(rng.normal())) for i, g in enumerate(rng.choice(3, 2000, p=[0.9, 0.05, 0.05]))]
    df = spark.createDataFrame(rows, "k string, t int, x double").withColumn("f", 1 + F.col("x") / 100).withColumn("s", F.when(F.col("x") > 0, F.struct("x", "t")))
    w = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumns({"last": F.last("s", ignorenulls=True).over(w), "grown": F.product("f").over(w), "peak": F.max("x").over(w), "total": F.sum("x").over(w)})
    got = ranges.scan(df, ["k"], ["t"], {"last": ("last", "s"), "grown": ("product", "f"), "peak": ("max", "x"), "total": ("sum", "x")}, parts=7)
    key = lambda r: (r["k"] or "", r["t"])
    for a, b in zip(sorted(got.collect(), key=key), sorted(want.collect(), key=key), strict=True):
        assert (a["last"], a["peak"]) == (b["last"], b["peak"]) and [a["grown"], a["total"]] == pytest.approx([b["grown"], b["total"]])


def test_one_long_series_in_several_tasks(spark):
    n = 1_000_000
    df = spark.range(0, n, 1, 8).select(F.lit("k").alias("k"), F.col("id").alias("t"), F.when(F.col("id") % 1000 == 0, F.col("id")).alias("x"))
    out = ranges.scan(df, ["k"], ["t"], {"filled": ("last", "x")}, parts=8)
    assert out.filter(F.col("filled") != F.col("t") - F.col("t") % 1000).isEmpty() and out.count() == n
    counts = [r["count"] for r in ranges.ranged(df, ["k"], ["t"], 8).groupBy("__range").count().collect()]
    assert len(counts) == 8 and max(counts) < 2 * n / 8


def test_asof_in_ranges_equals_the_window(spark):
    rng = np.random.default_rng(4)
    left = spark.createDataFrame([(["hot", "b", "c"][int(k)], int(t), i) for i, (k, t) in enumerate(zip(rng.choice(3, 3000, p=[0.9, 0.05, 0.05]), rng.integers(0, 400, 3000), strict=True))], "k string, t int, i int")
    right = spark.createDataFrame([(["hot", "b"][int(k)], int(t), None if t % 5 == 0 else float(t), int(k)) for k, t in zip(rng.integers(0, 2, 300), rng.integers(0, 400, 300), strict=True)], "k string, known int, v double, o int")
    for strict in (False, True):
        args = (left, right, "k", "t", "known", ["v"], [F.desc("v")], strict)
        want, got = asof.asof_backward(*args), asof.asof_backward(*args, parts=6)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_drawdowns_and_sheets_in_ranges(spark):
    rng = np.random.default_rng(6)
    legs = spark.createDataFrame([("q1" if i % 3 else "q2", i, float(r)) for i, r in enumerate(rng.normal(0, 0.05, 400))], "q string, k int, r double")
    plain, split = ({(x["q"], x["k"]): (x["cum"], x["dd"]) for x in drawdowns(legs, "r", "k", ("q",), parts=p).collect()} for p in (None, 5))
    assert plain.keys() == split.keys() and all(split[k] == pytest.approx(v) for k, v in plain.items())
    cells = [["x"], ["(n)", "", "Energy"], ["1", "", "A"], ["2", "", "B"], [""], ["3", "", "no block"], ["(n)", "", "Materials"], ["4"], [None], ["(n)", "", "Utilities"], *[[str(i), "", "C"] for i in range(60)]]
    rows = spark.createDataFrame(list(enumerate(cells)), "row int, cells array<string>")
    a, b = (sorted(map(str, files.sheet_blocks(rows, parts=p).collect())) for p in (None, 4))
    assert a == b and len(a) == 63
