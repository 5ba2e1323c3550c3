from __future__ import annotations

import datetime as dt
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelyard.operators.calendar import calendar
from panelyard.plans import backtest, correlation, lab, reports, scoring

D = dt.date


def month(i):
    return D(2024 + i // 12, i % 12 + 1, 1)


def prices_of(spark, table):
    return spark.createDataFrame([(month(i), t, float(p)) for t, ps in table.items() for i, p in enumerate(ps) if p is not None], "date date, ticker string, px double")


def signals_of(spark, at, z):
    return spark.createDataFrame([(month(at), t, float(v)) for t, v in z.items()], "date date, ticker string, z double")


def trades_of(spark, *at):
    return spark.createDataFrame([(month(i),) for i in at], "trade_date date")


ABCDE = {"A": 1, "B": 2, "C": 3, "D": 4, "E": 5}
PLAIN = backtest.Rules(clip=None, gone_fill=None, delist_fill=None)


def legs(df, field="gross"):
    return {(r["q"], r["trade_date"].month): r[field] for r in df.collect()}


def test_lag_defends_against_lookahead(spark):
    px = prices_of(spark, {t: [10, 15, 15, 15] if t == "E" else [10] * 4 for t in ABCDE})
    for lag, want in ((0, 0.5), (1, 0.0)):
        out = backtest.run_backtest(px, signals_of(spark, 0, ABCDE), trades_of(spark, lag, 3), backtest.Rules(lag=lag, clip=None, gone_fill=None, delist_fill=None))
        assert legs(out)[(5, month(lag).month)] == pytest.approx(0.5 if lag == 0 else want)


def test_first_turnover_is_half_and_cost_is_linear(spark):
    px = prices_of(spark, {t: [10, 10, 11, 12] for t in ABCDE})
    out = backtest.net(backtest.run_backtest(px, signals_of(spark, 0, ABCDE), trades_of(spark, 1, 2), PLAIN), 100.0)
    r = {(x["q"], x["k"]): x for x in out.collect()}
    assert r[(5, 0)]["turnover"] == 0.5 and r[(5, 1)]["turnover"] == 0.0
    assert r[(5, 0)]["net"] == pytest.approx(0.1 - 0.005)


def test_exit_fills_tell_gaps_from_delistings(spark):
    table = {t: [10, 10, 10, 10] for t in ABCDE} | {"D": [10, 10, None, None], "E": [10, 10, None, 12]}
    px = prices_of(spark, table)
    trades = trades_of(spark, 1, 2)
    out = legs(backtest.run_backtest(px, signals_of(spark, 0, ABCDE), trades, backtest.Rules(clip=None)))
    assert out[(4, 2)] == pytest.approx(-0.3) and out[(5, 2)] == 0.0
    gone = legs(backtest.run_backtest(px, signals_of(spark, 0, ABCDE), trades, backtest.Rules(clip=None, gone_fill=None, delist_fill=-1.0)))
    assert gone[(5, 2)] == -1.0
    none = legs(backtest.run_backtest(px, signals_of(spark, 0, ABCDE), trades, PLAIN))
    assert none[(5, 2)] == 0.0
    cal = calendar(px)
    fills = {r["ticker"]: r["fill"] for r in backtest.exit_fills(px, backtest.periods(cal, trades), cal).filter("k = 0").collect()}
    assert fills == {"D": pytest.approx(-0.3), "E": 0.0}


def test_signals_carry_unless_strict(spark):
    px = prices_of(spark, {t: [10] * 4 for t in ABCDE})
    for staleness, n in (("carry", 2), ("strict", 1)):
        out = backtest.run_backtest(px, signals_of(spark, 0, ABCDE), trades_of(spark, 1, 2), backtest.Rules(clip=None, staleness=staleness))
        assert out.select("k").distinct().count() == n


def test_unknown_trade_date_raises(spark):
    px = prices_of(spark, {t: [10] * 3 for t in ABCDE})
    with pytest.raises(ValueError, match="calendar"):
        backtest.run_backtest(px, signals_of(spark, 0, ABCDE), trades_of(spark, 9), PLAIN)


def test_cap_weights(spark):
    z = {f"T{i}": i for i in range(10)}
    px = prices_of(spark, {t: [10, 10, 11 if t == "T8" else 12, 12] for t in z})

    def run(caps):
        c = spark.createDataFrame([(month(0), t, v) for t, v in caps.items()], "date date, ticker string, cap double")
        return backtest.cap_weighted_top(px, signals_of(spark, 0, z), c, trades_of(spark, 1, 2), PLAIN).filter("k = 0").first()

    assert run({"T8": 1.0, "T9": 1.0})["gross"] == pytest.approx(0.15)
    assert run({"T8": 1.0, "T9": 3.0})["gross"] == pytest.approx(0.175)
    assert run({"T8": None, "T9": 3.0})["gross"] == pytest.approx(0.20)
    assert run({"T8": None, "T9": -1.0})["gross"] == pytest.approx(0.15)
    assert run({"T8": 1.0, "T9": 3.0})["turnover"] == 0.5


def test_spread_pays_both_legs(spark):
    z = {f"S{i}": i for i in range(10)}
    path = {"S9": [10, 10, 11, 12.1], "S0": [10, 10, 9, 8.1]}
    px = prices_of(spark, {t: path.get(t, [10] * 4) for t in z})
    two = {t: v for t, v in z.items() if t in ("S9", "S0", "S2", "S4", "S6")}
    s = backtest.spread_series(backtest.run_backtest(px, signals_of(spark, 0, two), trades_of(spark, 1, 2), PLAIN), 100.0).orderBy("trade_date").first()
    assert s["spread"] == pytest.approx(0.2 - 0.01)


def test_benchmarks(spark):
    px = prices_of(spark, {"SPY": [400, 404, 400, 408], "A": [10, 11, 12, 13]})
    r = [x["ret"] for x in backtest.benchmark_returns(px, trades_of(spark, 0, 1, 2, 3), "SPY").orderBy("trade_date").collect()]
    assert r == pytest.approx([0.01, 400 / 404 - 1, 0.02])
    with pytest.raises(ValueError):
        backtest.benchmark_returns(px, trades_of(spark, 0), "QQQ")


def test_long_only_report(spark):
    rows = [(D(2024, 1, 31), 0.02), (D(2024, 2, 29), -0.01), (D(2024, 3, 31), 0.03), (D(2024, 4, 30), 0.01)]
    leg = spark.createDataFrame([(d, r, 0.1) for d, r in rows], "trade_date date, net double, turnover double")
    bench = spark.createDataFrame([(d, 0.0) for d, _ in rows], "trade_date date, ret double")
    x = backtest.long_only_report(leg, bench).first()
    assert (x["dd_peak"], x["dd_trough"], x["dd_recovered"], x["hit_rate"]) == (D(2024, 1, 31), D(2024, 2, 29), D(2024, 3, 31), 0.75)


def test_caps_and_turnover(spark):
    w = spark.createDataFrame([("A", "x", 0.5), ("B", "x", 0.3), ("C", "y", 0.2)], "ticker string, sector string, w double")
    out = {r["ticker"]: r["w"] for r in backtest.apply_caps(w, 0.05, 0.3).collect()}
    assert sum(out.values()) == pytest.approx(1.0) and out["A"] == pytest.approx(out["B"])
    old = spark.createDataFrame([("A", 1.0)], "ticker string, w double")
    new = spark.createDataFrame([("B", 1.0)], "ticker string, w double")
    assert backtest.turnover_between(old, new).first()["turnover"] == 1.0


def test_rank_ic(spark):
    def ic(x, y, least=30):
        df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, y)], "date int, x double, y double")
        return lab.ic_series(df, "x", "y", least=least).first()["ic"]

    n = range(40)
    assert ic(n, n) == pytest.approx(1) and ic(n, [-i for i in n]) == pytest.approx(-1)
    assert ic(n, [1] * 40) is None and ic(range(3), range(3)) is None


def test_sensitivities_label_once(spark, monkeypatch):
    runs, plain = [], backtest.label_periods
    monkeypatch.setattr(backtest, "label_periods", lambda *args: runs.append(args) or plain(*args))
    px = prices_of(spark, {t: [10, 10, 11, 12] for t in ABCDE} | {"E": [10, 10, None, None]})
    out = backtest.sensitivities(px, signals_of(spark, 0, ABCDE), trades_of(spark, 1, 2), backtest.Rules(clip=None), cost_bps=0.0, floor=None)
    found = {r["run"]: r for r in out.collect()}
    assert len(runs) == 1 and set(found) == {"full", "delist100"}
    assert found["full"]["ann_return"] - found["delist100"]["ann_return"] == pytest.approx(12 * 0.7 / found["full"]["periods"])


def test_a_rank_correlation_of_nothing_is_zero(spark):
    pairs = [(p // 7 + 0.0, (p * 3) % 7 + 0.0) for p in range(49)]  # every x with every y
    df = spark.createDataFrame([(d, *p) for d in range(20) for p in (pairs if d % 2 else pairs[::-1])], "date int, x double, y double").repartition(5)
    ics = lab.ic_series(df, "x", "y", least=30)
    assert {r["ic"] for r in ics.collect()} == {0.0} and lab.ic_summary(ics).first()["hit_rate"] == 0.0
    one = lab.ic_series(df.withColumn("y", F.lit(1.1)), "x", "y", least=30)
    assert {r["ic"] for r in one.collect()} == {None}


def test_quantile_returns_and_skips(spark):
    df = spark.createDataFrame([(1, float(i), float(i >= 50)) for i in range(100)] + [(2, 1.0, 0.5)] * 100, "date int, z double, r double")
    out = lab.quantile_returns(df, "z", "r").collect()
    assert len(out) == 1 and out[0]["q1"] == 0 and out[0]["q5"] == 1 and out[0]["spread"] == 1


def test_half_lives():
    assert lab.half_life({5: 0.9, 21: 0.7, 42: 0.4, 63: 0.2})["days"] == pytest.approx(35.0)
    assert lab.half_life({5: 0.3})["censored"] == "below-threshold-at-first-lag"
    assert lab.half_life({5: 0.9, 21: 0.8}) == {"days": 21.0, "censored": "above-0.5-at-max-lag"}
    assert lab.half_life({})["censored"] == "no-data"
    assert lab.ic_half_life({21: 0.08, 63: 0.04})["days"] == 63
    assert lab.ic_half_life({21: -0.01, 63: 0.04})["days"] is None


def test_correlation_structure(spark):
    rng = np.random.default_rng(0)
    a, c = rng.normal(size=300), rng.normal(size=300)
    b = 0.95 * a + 0.3 * rng.normal(size=300)
    rows = [(1, float(x), float(y), float(z)) for x, y, z in zip(a, b, c)] + [(2, 1.0, 2.0, 3.0)] * 50
    df = spark.createDataFrame(rows, "date int, a double, b double, c double")
    for method in ("pearson", "spearman"):
        corr = correlation.pair_correlations(df, ["a", "b", "c"], method)
        assert {r["date"] for r in corr.collect()} == {1}
        cols, m = correlation.matrix(correlation.fisher_mean(corr), ["a", "b", "c"])
        assert m[0, 1] > 0.9 and abs(m[0, 2]) < 0.15
    p = correlation.pca(m)
    assert p["explained"].sum() == pytest.approx(1) and np.allclose(p["vectors"].T @ p["vectors"], np.eye(3))
    assert correlation.redundancy_clusters(cols, m)[0]["keep"] == "a"
    assert correlation.redundancy_clusters(cols, m, priority={"b": 2.0})[0]["keep"] == "b"
    assert correlation.effective_dimensions(p)["kaiser_gt1"] >= 1


def test_composites(spark):
    df = spark.createDataFrame([("A", 2.0, None), ("B", None, None), ("C", 1.0, 3.0)], "ticker string, z_a double, z_b double")
    out = {r["ticker"]: r["z_composite"] for r in scoring.panel_composite(df, {"s1": ["a"], "s2": ["b"]}, {"s1": 0.6, "s2": 0.4}).collect()}
    assert out["A"] == pytest.approx(2.0) and out["B"] is None and out["C"] == pytest.approx(1.8)
    with pytest.raises(KeyError):
        scoring.panel_composite(df, {"s1": ["a"]}, {"nope": 1.0})
    live = spark.createDataFrame([("A", "x", 1.0, None), ("B", "x", 2.0, None), ("C", "x", 3.0, None)], "ticker string, sector string, value double, growth double")
    ranked = scoring.snapshot_composite(live, {"value": 0.5, "growth": 0.5})
    assert "z_growth" not in ranked.columns and {r["ticker"]: r["rank"] for r in ranked.collect()} == {"A": 3, "B": 2, "C": 1}
    with pytest.raises(ValueError):
        scoring.snapshot_composite(live, {"growth": 1.0})


def test_factor_scores(spark):
    df = spark.createDataFrame([("A", "x", -5.0), ("B", "x", 5.0), ("C", "x", 50.0)], "ticker string, sector string, pe_ratio double")
    s = {r["ticker"]: r["v"] for r in df.select("ticker", scoring.value_score(df).alias("v")).collect()}
    assert s["B"] > s["C"] and s["A"] < s["B"]
    with pytest.warns(UserWarning):
        scoring.quality_score(df)
    with pytest.raises(KeyError):
        scoring.oriented("nonsense")


def test_noise_is_deterministic_and_null(spark):
    df = spark.range(2000).select(F.lit("2024-01-31").alias("date"), F.col("id").cast("string").alias("ticker"))
    a, b = (df.select(scoring.noise().alias("n")).agg(F.sum("n"), F.avg("n"), F.stddev("n")).first() for _ in range(2))
    assert a == b and abs(a[1]) < 0.1 and abs(a[2] - 1) < 0.1
    s = scoring.noise_sequence(df.limit(5))
    assert [r["noise_raw"] for r in s.orderBy("ticker").collect()] == [r["noise_raw"] for r in s.orderBy("ticker").collect()]


def test_reports(spark):
    df = spark.createDataFrame([("A", "tech", 1.0, 1, 1.0), ("B", "tech", 0.5, 2, -1.0), ("C", "bank", None, None, None)], "ticker string, sector string, composite double, rank int, z_value double")
    assert "Tech" in reports.tear_sheet(df, 1) and " B" not in reports.tear_sheet(df, 1)
    top = reports.shortlist(df, 2, {"value": 0.5}, previous=df.filter("ticker = 'A'"))
    assert {r["ticker"]: r["is_new"] for r in top.collect()} == {"A": False, "B": True}
    assert reports.markdown([{"a": 1.0, "b": None}]) == "| a | b |\n|---|---|\n| 1.0000 | - |"


def test_names_without_a_group_are_not_capped_as_one(spark):
    rows = [(f"t{i}", "a" if i < 10 else None, 0.05) for i in range(20)]
    out = backtest.apply_caps(spark.createDataFrame(rows, "ticker string, sector string, w double")).collect()
    by = {r["ticker"]: r["w"] for r in out}
    assert abs(by["t0"] - 0.03 / 0.8) < 1e-12 and abs(by["t15"] - 0.05 / 0.8) < 1e-12


def test_efficacy_of_two_universes(spark):
    rng = np.random.default_rng(11)
    rows = [(d, f"T{t}", float(t), float(t) + float(rng.normal()), float(rng.normal()) if t % 2 else None) for d in range(14) for t in range(60)]
    df = spark.createDataFrame(rows, "date int, ticker string, a double, r double, b double")
    big = df.filter("a >= 30").select("date", "ticker")
    flagged = lab.flag_members(df, big.unionByName(big))
    assert flagged.count() == df.count() and flagged.filter("is_lc").count() == big.count()
    out = {x["factor"]: x for x in lab.universe_efficacy(flagged, ["a", "b"], ["r"], least=25).collect()}
    assert out["a"]["cov_broad"] == 1.0 and out["b"]["cov_broad"] == out["b"]["cov_lc"] == 0.5
    assert out["a"]["ic_r_broad"] > out["a"]["ic_r_lc"] > 0.8 and out["a"]["t_r_lc"] > 2
    assert out["b"]["ic_r_broad"] is not None and out["b"]["ic_r_lc"] is None  # 30 rows, 15 of them with a value: no date has enough
    assert out["b"]["t_r_lc"] is None


def test_scores_from_medians_equal_the_windows(spark):
    rng = np.random.default_rng(12)
    rows = [(f"T{i}", "xyz"[i % 3] if i % 11 else None, *[None if rng.random() < 0.3 else float(rng.normal() * 10) for _ in range(5)]) for i in range(90)]
    df = spark.createDataFrame(rows, "ticker string, sector string, pe_ratio double, ps_ratio double, roe double, vol_126d double, mom_12_1 double")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        a = scoring.add_scores(df).select("ticker", *scoring.FACTORS)
        b = df.select("ticker", *[f(df).alias(n) for n, f in scoring.FACTORS.items()])
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_sensitivities_and_caps(spark):
    days = list(range(40))
    rows = [(d, f"T{t}", 10.0 * (1 + 0.001 * t) ** d) for d in days for t in range(30) if not (t == 29 and d >= 20)]  # one of the best is gone for good
    px = spark.createDataFrame(rows, "date int, ticker string, px double")
    sig = px.select("date", "ticker", F.substring("ticker", 2, 2).cast("double").alias("z"))
    trades = spark.createDataFrame([(d,) for d in range(5, 40, 7)], "trade_date int")
    out = {r["run"]: r for r in backtest.sensitivities(px, sig, trades, floor=10.2).collect()}
    assert set(out) == {"full", "px10.2", "delist100"} and out["delist100"]["cumulative"] < out["full"]["cumulative"]
    panel = spark.createDataFrame([(1, "A", "5"), (1, "A", "7"), (1, "B", "x"), (2, "A", "9")], "date int, ticker string, market_cap string")
    caps = backtest.cap_frame(panel, spark.createDataFrame([(1,)], "date int"))
    assert sorted(map(tuple, caps.collect())) == [(1, "A", 7.0), (1, "B", None)]
