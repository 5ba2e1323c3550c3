from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelyard import __main__ as cli
from panelyard.operators import calendar, panel
from panelyard.plans import backtest, runs


def test_rank_snapshot(spark):
    rows = [(f"T{i}", "x" if i % 2 else "y", 10.0 + i, 5.0 + i, 0.1 * i, 0.2 + 0.01 * i, 100.0 + i) for i in range(20)]
    df = spark.createDataFrame(rows, "ticker string, sector string, price double, pe_ratio double, mom_12_1 double, vol_126d double, enterprise_value double")
    out = runs.rank_snapshot(df, {"value": 0.2, "momentum": 0.2, "lowvol": 0.1, "noise": 0.0}, "2024-01-31")
    assert out.count() == 20 and {"z_value", "z_noise", "composite", "rank"} <= set(out.columns)


def cached(spark):
    return {*spark.sparkContext._jsc.getPersistentRDDs()}


def test_lab_and_backtest(spark):
    before = cached(spark)
    rng = np.random.default_rng(2)
    dates = [dt.date(2024, 1, 1) + dt.timedelta(days=7 * i) for i in range(30)]
    rows = []
    for t in range(60):
        p = 20.0
        for d in dates:
            p *= 1 + 0.01 * (t / 60) + 0.02 * float(rng.normal())
            rows.append((d, f"T{t:02d}", "a" if t % 2 else "b", p, t + float(rng.normal()), float(rng.normal())))
    df = spark.createDataFrame(rows, "date date, ticker string, sector string, px double, roe double, ret_fwd_21d double")
    out = runs.factor_lab(df, ["roe"], ["ret_fwd_21d"], 30, {"quality": ["roe"]}, "px", df.groupBy("date").agg(F.avg("px").alias("adj_close")), (1, 2), (1, 3), every=3)
    names = {"z_roe", "z_noise_raw", "sleeve_quality"}
    for part in ("ic_ret_fwd_21d", "spreads", "annual", "decay", "half_life", "ic_horizons", "ic_half_life", "coverage"):
        assert {r["factor"] for r in out[part].collect()} == names, part
    assert out["correlations"].count() == 3 and out["quantiles"].count() == 3 * 30
    decay = {(r["factor"], r["lag"]): r["autocorr"] for r in out["decay"].collect()}
    assert decay["z_roe", 1] > 0.95 and decay["sleeve_quality", 2] == pytest.approx(decay["z_roe", 2])
    days = {r["factor"]: (r["days"], r["censored"]) for r in out["half_life"].collect()}
    assert days["z_roe"] == (2.0, "above-0.5-at-max-lag") and days["z_noise_raw"][1] == "below-threshold-at-first-lag"
    assert cached(spark) <= before
    sig = df.select("date", "ticker", F.col("roe").alias("z_composite"))
    rep = runs.backtest_report(df.select("date", "ticker", "px"), sig, "T30", df.select("date", "ticker", F.col("px").alias("cap")))
    assert rep["spread_gross"].first()["ann_return"] > rep["spread_net"].first()["ann_return"]
    assert cached(spark) <= before
    assert rep["leg_stats"].count() == 5 and rep["cap_weighted_vs_bench"].first()["periods"] > 0 and rep["spread_price_floor"].count() == 1


def test_gaps(spark):
    """A price that is missing at an exit, for a while or for good, and at a horizon."""
    days = [dt.date(2024, 1, d) for d in range(1, 9)]
    rows = [(d, t, 10.0) for d in days for t in ("a", "b", "c") if not (t == "b" and d == days[4]) and not (t == "c" and d >= days[4])]
    px = spark.createDataFrame(rows, "date date, ticker string, px double")
    cal = calendar.calendar(px)
    per = backtest.periods(cal, spark.createDataFrame([(days[1],), (days[4],)], "trade_date date"))
    assert {(r["k"], r["ticker"]): r["fill"] for r in backtest.exit_fills(px, per, cal).collect()} == {(0, "b"): 0.0, (0, "c"): -0.3}
    fwd = {(r["ticker"], r["date"]): r["fwd"] for r in panel.calendar_forward_returns(px, cal, "px", (1,)).collect()}
    assert fwd["a", days[3]] == 0.0 and fwd["b", days[3]] is None and ("b", days[4]) not in fwd


def test_commands(spark, tmp_path):
    rows = [(f"T{i}", "x" if i % 2 else "y", 10.0 + i, 5.0 + i, 0.1 * i, 0.2 + 0.01 * i, 100.0 + i) for i in range(20)]
    spark.createDataFrame(rows, "ticker string, sector string, price double, pe_ratio double, mom_12_1 double, vol_126d double, enterprise_value double").write.parquet(f"{tmp_path}/in")
    common = ["--input", f"{tmp_path}/in", "--out", f"{tmp_path}/out", "--weights", "value=0.6,momentum=0.4"]
    cli.main(["rank", *common, "--asof", "2024-01-31"], spark)
    assert "ticker" in (tmp_path / "out" / "top.md").read_text() and len((tmp_path / "out" / "scores.csv").read_text().splitlines()) == 21
    (tmp_path / "old.csv").write_text("ticker\nT0\n")
    cli.main(["shortlist", *common, "--top", "20", "--previous", f"{tmp_path}/old.csv"], spark)
    lines = (tmp_path / "out" / "shortlist.csv").read_text().splitlines()
    assert len(lines) == 21 and sum("False" in line for line in lines) == 1
    with pytest.raises(SystemExit):
        cli.main(["rank", "--input", "x"], spark)


def test_panel_command_builds_once(spark, tmp_path):
    days = [dt.date(2023, 12, 25) + dt.timedelta(days=i) for i in range(20)]
    spark.createDataFrame([(t, t, d, 10.0 + i) for t in ("A", "B") for i, d in enumerate(days)], "ticker string, company_id string, date date, adj_close double").write.parquet(f"{tmp_path}/prices")
    spark.createDataFrame([("A", days[3], "FY", "7.5")], "ticker string, available_date date, fiscal_period string, pricetoearnings string").write.parquet(f"{tmp_path}/funds")
    spark.createDataFrame([("A", days[5], "100")], "ticker string, available_date date, totalrevenue string").write.parquet(f"{tmp_path}/rev")
    spark.createDataFrame([("A", "x", 0), ("B", "y", 0)], "company_id string, sector string, row int").write.parquet(f"{tmp_path}/companies")
    args = ["panel", "--input", f"{tmp_path}/prices", "--fundamentals", f"{tmp_path}/funds", "--revenue", f"{tmp_path}/rev", "--companies", f"{tmp_path}/companies", "--out", f"{tmp_path}/out", "--factors", "pricetoearnings=pe", "--trailing", "1", "--forward", "1"]
    cli.main(args, spark)
    panel_rows = spark.read.parquet(f"{tmp_path}/out/panel")
    assert panel_rows.count() == 40 and panel_rows.filter("ticker = 'A' AND date = '2023-12-28'").first()["pe"] == 7.5
    assert (tmp_path / "out" / "years.csv").read_text().splitlines() == ["year,rows,tickers", "2023,14,2", "2024,26,2"]
    files = sorted(panel_rows.inputFiles())
    cli.main(args, spark)
    assert sorted(spark.read.parquet(f"{tmp_path}/out/panel").inputFiles()) == files  # equal inputs: kept
    cli.main([*args[:-1], "2"], spark)
    assert sorted(spark.read.parquet(f"{tmp_path}/out/panel").inputFiles()) != files
