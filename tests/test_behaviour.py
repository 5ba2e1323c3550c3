"""Results that follow from the definitions on small hand-made inputs: panel, live snapshot, lab."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelyard.operators import live, panel
from panelyard.operators.calendar import calendar
from panelyard.plans import lab

D = dt.date


def test_panel_knows_no_vintage_before_its_date(spark):
    days = [D(2024, 1, 2) + dt.timedelta(days=i) for i in range(40)]
    prices = spark.createDataFrame([(t, c, d, 10.0 + i) for t, c in (("AAA", 1), ("BBB", 2), ("CCC", 3)) for i, d in enumerate(days)], "ticker string, company_id int, date date, adj_close double")
    funds = spark.createDataFrame([("AAA", D(2024, 1, 10), "Q1TTM", "10"), ("AAA", D(2024, 2, 1), "Q2TTM", "20")], "ticker string, available_date date, fiscal_period string, pricetoearnings string")
    revenue = spark.createDataFrame([("AAA", D(2024, 1, 20), "5")], "ticker string, available_date date, totalrevenue string")
    companies = spark.createDataFrame([(1, "technology"), (2, "energy")], "company_id int, sector string")
    rows = panel.build_panel(prices, funds, revenue, companies, {"pricetoearnings": "pe"}, (1,), (1,)).collect()
    pe = {r["date"]: r["pe"] for r in rows if r["ticker"] == "AAA"}
    assert all(pe[d] == (None if d < D(2024, 1, 10) else 10.0 if d < D(2024, 2, 1) else 20.0) for d in days)
    assert {r["ticker"]: r["sector"] for r in rows} == {"AAA": "technology", "BBB": "energy", "CCC": "unknown"}
    assert {r["date"] for r in rows if r["revenue"] is not None} == {d for d in days if d >= D(2024, 1, 20)}


def test_live_metrics(spark):
    s = spark.createDataFrame
    universe = s([("AAA",), ("CCC",), ("NOPRICE",)], "ticker string")
    prices = s([("AAA", D(2026, 1, 2), 50.0, 50.0, 60.0, 40.0), ("CCC", D(2026, 1, 2), 198.0, 198.0, 250.0, 160.0), ("CCC", D(2026, 1, 5), 200.0, 200.0, 250.0, 160.0)], "ticker string, date date, close double, adj_close double, high_52w double, low_52w double")
    calcs = s([("AAA", "FY", "2025-11-01", None, "12", "1e8", "0.5"), ("CCC", "FY", "2025-08-01", None, "30", "7", None), ("CCC", "FY", "2025-11-01", None, "28", "7", None)], "ticker string, fiscal_period string, filing_date string, first_calculable_at string, pricetoearnings string, freecashflow string, debttoequity string")
    quarters = [("AAA", "2026", "Q2", "1.2e8"), ("AAA", "2026", "Q1", "1.0e8"), ("AAA", "2025", "Q4", "1.2e8"), ("AAA", "2025", "Q3", "1.1e8"), ("AAA", "2025", "Q2", "1.0e8"), ("CCC", "2026", "Q1", "3.0"), ("CCC", "2025", "Q1", "2.9")]
    income = s([(*q, "") for q in quarters], "ticker string, fiscal_year string, fiscal_period string, totalrevenue string, filing_date string")
    companies = s([("AAA", "A Inc", "Computers"), ("CCC", "C Inc", "Phones")], "ticker string, name string, industry_group_name string")
    sectors = s([("Computers", "technology"), ("Phones", "telecommunication")], "group string, sector string")
    frame, excluded = live.build_live(universe, companies, prices, calcs, income, sectors, bench=None)
    out = {r["ticker"]: r for r in frame.collect()}
    assert set(out) == {"AAA", "CCC"} and [r[0] for r in excluded.collect()] == ["NOPRICE"]
    a, c = out["AAA"], out["CCC"]
    assert a["fcf_margin"] == pytest.approx(1e8 / 4.5e8) and a["sales_growth_q"] == pytest.approx(0.2) and a["debt_to_equity"] == 0.5
    assert (a["last_qtr"], a["currency"], a["sector"], a["sector_raw"]) == ("Q2 2026", "USD", "technology", "Computers")
    assert c["pe_ratio"] == 28.0 and c["price"] == 200.0 and c["pct_below_52w_high"] == pytest.approx(200 / 250 - 1) and c["pct_above_52w_low"] == pytest.approx(200 / 160 - 1)
    assert c["sector"] == "telecommunication" and c["fcf_margin"] is None and c["sales_growth_q"] == pytest.approx(3.0 / 2.9 - 1)


def frame(spark, rows):
    return spark.createDataFrame([("2020-01-31", f"T{i:03d}", float(z), float(r)) for i, (z, r) in enumerate(rows)], "date string, ticker string, z double, ret double")


def test_quintiles_of_two_levels_of_ties_and_of_one_lottery_ticket(spark):
    two = lab.quantile_returns(frame(spark, [(i, i >= 50) for i in range(100)]), "z", "ret").collect()
    assert [(r["q1"], r["q5"], r["spread"]) for r in two] == [(0.0, 1.0, 1.0)]
    assert lab.quantile_returns(frame(spark, [(1, i) for i in range(100)]), "z", "ret").count() == 0  # fewer than five bins
    ticket = lab.quantile_returns(frame(spark, [(i, 100.0 if i == 199 else 0.01) for i in range(200)]), "z", "ret").first()
    assert ticket["q5"] < 1.0


def test_spread_summary(spark):
    df = spark.createDataFrame([(D(2020, 1, 31), 0.01, 0.05, 0.04), (D(2020, 2, 29), 0.02, 0.06, 0.04)], "date date, q1 double, q5 double, spread double")
    out = lab.spread_summary(df).first()
    assert out["mean"] == pytest.approx(0.04) and out["hit_rate"] == 1.0
    assert {k: pytest.approx(v) for k, v in out.asDict().items() if k in ("q1_mean", "q5_mean", "cumulative")} == {k: v for k, v in {"q1_mean": 0.015, "q5_mean": 0.055, "cumulative": 0.08}.items() if k in out.asDict()}


def test_half_lives_of_known_curves():
    assert lab.half_life({5: 0.9, 21: 0.7, 42: 0.4, 63: 0.2}) == {"days": pytest.approx(35.0), "censored": None}
    assert lab.half_life({5: 0.3, 21: 0.1})["censored"] == "below-threshold-at-first-lag"
    assert lab.half_life({5: 0.9, 21: 0.8}) == {"days": 21.0, "censored": "above-0.5-at-max-lag"}
    assert lab.half_life({5: float("nan")})["days"] is None
    between = lab.ic_half_life({21: 0.08, 63: 0.05, 126: 0.03, 252: 0.02})
    assert between["censored"] is None and 63 < between["days"] < 126
    assert lab.ic_half_life({21: 0.08, 63: 0.07, 126: 0.06, 252: 0.05}) == {"days": 252.0, "censored": "above-half-at-max-horizon"}
    assert lab.ic_half_life({21: -0.01, 63: 0.02})["days"] is None and lab.ic_half_life({21: 0.08, 63: 0.04}) == {"days": 63.0, "censored": None}


def test_forward_returns_and_ic_at_horizons(spark):
    rng = np.random.default_rng(0)
    steps = np.exp(np.cumsum(rng.normal(0, 0.02, (260, 40)), 0)) * 50
    days = [D(2023, 1, 1) + dt.timedelta(days=i) for i in range(260)]
    px = spark.createDataFrame([(d, f"T{t:03d}", float(steps[i, t])) for i, d in enumerate(days) for t in range(40)], "date date, ticker string, px double")
    cal = calendar(px)
    fwd = panel.calendar_forward_returns(px, cal, "px", (21, 63)).persist()
    one = fwd.filter((F.col("ticker") == "T007") & (F.col("date") == F.lit(days[100])) & (F.col("h") == 21)).first()["fwd"]
    assert one == pytest.approx(steps[121, 7] / steps[100, 7] - 1)
    assert fwd.filter((F.col("date") > F.lit(days[238])) & F.col("fwd").isNotNull() & (F.col("h") == 21)).isEmpty()  # no price so far ahead
    at = [days[i] for i in range(0, 190, 21)]
    best = fwd.filter((F.col("h") == 21) & F.col("date").isin(at)).select("date", "ticker", F.rank().over(Window.partitionBy("date").orderBy("fwd")).cast("double").alias("x"))
    out = {r["h"]: r for r in lab.ic_at_horizons(best, fwd, ["x"]).collect()}
    assert out[21]["mean"] > 0.99 and out[21]["n"] == len(at) and out[63]["mean"] < 0.99
    fwd.unpersist()
