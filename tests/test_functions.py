from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelyard.functions import nulls, stats, xsec


def one(df):
    return df.first()[0]


def test_number_and_division_never_raise(spark):
    df = spark.createDataFrame([("1.5",), ("x",), (None,), ("NaN",)], "c string")
    assert [r[0] for r in df.select(nulls.number("c")).collect()] == [1.5, None, None, None]
    assert one(spark.range(1).select(nulls.safe_div(F.lit(1.0), F.lit(0.0)))) is None


def test_nan_to_null_and_row_mean(spark):
    df = nulls.nan_to_null(spark.createDataFrame([(1.0, math.nan), (3.0, 5.0)], "a double, b double"))
    assert [r[0] for r in df.select(nulls.row_mean(["a", "b"])).collect()] == [1.0, 4.0]
    assert one(df.select(nulls.row_mean([]))) is None


def test_winsorize_clips_outlier_and_leaves_constants(spark):
    df = spark.createDataFrame([("a", 1.0)] * 10 + [("a", 1000.0)] + [("b", 5.0)] * 3, "g string, x double")
    out = df.select("g", xsec.winsorize_sigma(F.col("x"), ["g"], 3.0).alias("x")).groupBy("g").agg(F.max("x").alias("m")).collect()
    assert {r["g"]: r["m"] for r in out}["b"] == 5.0
    assert {r["g"]: r["m"] for r in out}["a"] < 1000.0


def test_zscore_is_centred_per_group(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(20)] + [("b", 100.0 + i) for i in range(20)], "g string, x double")
    out = xsec.add_group_z(df, ["x"], ["g"]).groupBy("g").agg(F.avg("z_x").alias("m"), F.stddev_samp("z_x").alias("s")).collect()
    assert all(abs(r["m"]) < 1e-12 and abs(r["s"] - 1) < 1e-12 for r in out)
    two = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "g string, x double")
    assert sorted(round(r["z_x"], 4) for r in xsec.add_group_z(two, ["x"], ["g"]).collect()) == [-0.7071, 0.7071]


@pytest.mark.parametrize("seed", range(6))
def test_quantile_labels_equal_qcut(spark, seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 12, 60).astype(float)
    want = pd.qcut(pd.Series(x), 5, labels=False, duplicates="drop") + 1
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "g int, i int, x double")
    got = {r["i"]: r["q"] for r in xsec.quantile_labels(df, "x", ["g"]).collect()}
    assert [got[i] for i in range(60)] == want.tolist()


def test_quantile_labels_with_collapsed_edges(spark):
    df = spark.createDataFrame([(1, float(v)) for v in [1, 1, 1, 2, 2, 2, 3, 3, 4, 5]], "g int, x double")
    assert {r["q"] for r in xsec.quantile_labels(df, "x", ["g"]).collect()} == {1, 3, 4}
    assert {r["q"] for r in xsec.quantile_labels(df, "x", ["g"], need_all=True).collect()} == {None}


@pytest.mark.parametrize("hot", [None, 100])
def test_quantile_labels_come_from_the_labelled_values(spark, hot):
    noise = F.udf(lambda v: v + float(np.random.default_rng().random()), "double").asNondeterministic()  # another draw in each run of the plan
    df = spark.range(0, 400, 1, 4).select("id", (F.col("id") % 2).alias("g"), noise(F.lit(0.0)).alias("x"))
    rows = pd.DataFrame([r.asDict() for r in xsec.quantile_labels(df, "x", ["g"], hot=hot).collect()])
    assert len(rows) == 400
    for _, own in rows.groupby("g"):
        assert own["q"].tolist() == (pd.qcut(own["x"], 5, labels=False) + 1).tolist()
    assert {r["q"] for r in xsec.quantile_labels(df.withColumn("g", F.lit(None).cast("int")), "x", ["g"], hot=hot).collect()} == {None}


def test_percentile_winsor(spark):
    df = spark.createDataFrame([(1, 0.01)] * 199 + [(1, 100.0)], "g int, x double")
    assert one(xsec.winsorize_percentiles(df, "x", ["g"]).agg(F.max("x"))) < 100.0


def test_average_rank_matches_pandas(spark):
    x = [3.0, 1.0, 3.0, 2.0, 2.0, 2.0]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(x)], "g int, i int, x double")
    got = {r["i"]: r["r"] for r in df.select("i", xsec.average_rank("x", ["g"]).alias("r")).collect()}
    assert [got[i] for i in range(6)] == pd.Series(x).rank().tolist()


def test_drawdown_survives_total_loss_and_tstat(spark):
    df = spark.createDataFrame([(1, 0.1), (2, -1.0), (3, 0.5)], "t int, r double")
    assert stats.drawdowns(df, "r", "t").agg(F.min("dd")).first()[0] == -1.0
    s = spark.createDataFrame([(v,) for v in [0.05, -0.02, 0.03, 0.08, -0.01, 0.04]], "x double").agg(*stats.series_summary("x")).first()
    x = pd.Series([0.05, -0.02, 0.03, 0.08, -0.01, 0.04])
    assert s["n"] == 6 and s["hit_rate"] == pytest.approx(4 / 6) and s["tstat"] == pytest.approx(x.mean() / (x.std() / 6**0.5))
