"""End-to-end runs: rank a snapshot, evaluate factors on a panel, backtest the panel composite."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import calendar as cal_ops
from ..operators import clean
from ..operators import panel as panel_ops
from . import backtest, correlation, lab, scoring

REQUIRED = ("ticker", "sector", "price")


def rank_snapshot(frame: DataFrame, weights: Mapping[str, float], date: str | None = None, sigma: float = 3.0) -> DataFrame:
    """Validated snapshot with sleeve scores, z-scores, composite and rank within the sector."""
    clean.validate(frame, REQUIRED)
    scored = scoring.add_scores(frame).withColumn("noise", scoring.noise(F.lit(date or "snapshot")))
    return scoring.snapshot_composite(scored, weights, sigma=sigma)


def factor_lab(
    panel: DataFrame, factors: Sequence[str], returns: Sequence[str] = ("ret_fwd_21d", "ret_fwd_63d"), least: int = lab.MIN_PER_DATE, sleeves: Mapping[str, Sequence[str]] | None = None,
    price: str | None = None, bench: DataFrame | None = None, lags: Sequence[int] = lab.LAGS, horizons: Sequence[int] = lab.HORIZONS, every: int = 6,
) -> dict[str, DataFrame]:
    """Efficacy of factors and sleeves on a panel of signal dates: every result has a column ``factor``.

    coverage; ic_<return>; quantiles (by date), spreads and annual for the first return; decay (base
    dates: every ``every``-th) and half_life; correlations.  With ``price``, also ic_horizons over
    calendar returns of the panel's dates and ic_half_life; with ``bench`` (date, adj_close), also
    spreads by regime.  Factors are oriented and z-scored once; IC of all is one plan over the
    unpivoted z.  All results are small and computed here, so the cached scores are released.
    """
    frame = scoring.add_panel_z(panel.withColumn("noise_raw", scoring.noise()), [*factors, "noise_raw"])
    names = [f"z_{f}" for f in [*factors, "noise_raw"]]
    for s, members in (sleeves or {}).items():
        frame = frame.withColumn(f"sleeve_{s}", scoring.sleeve_column(frame, members))
        names.append(f"sleeve_{s}")
    z = frame.persist()
    local, out = cal_ops.local, {"coverage": cal_ops.local(clean.coverage(z, names))}
    for ret in returns:
        long = z.select("date", ret, *names).unpivot(["date", ret], names, "factor", "z")
        dense = lab.ic_series(long, "z", ret, ["factor", "date"], max(least, lab.MIN_IC)).filter(F.col("n") >= least)
        out[f"ic_{ret}"] = local(lab.ic_summary(dense, ["factor"]))
    cal = local(cal_ops.calendar(z))
    bases = local(cal_ops.base_dates(cal.select("date"), cal, every, ahead=max(lags)))

    def each(run) -> DataFrame:
        return local(reduce(DataFrame.unionByName, [run(n).withColumn("factor", F.lit(n)) for n in names]))

    out["quantiles"] = each(lambda n: lab.quantile_returns(lab.dense_dates(z, n, least), n, returns[0]))
    out["spreads"], out["annual"] = local(lab.spread_summary(out["quantiles"], by=["factor"])), local(lab.annual_spreads(out["quantiles"], by=["factor"]))
    out["decay"] = each(lambda n: lab.decay_curve(z, n, cal, bases, lags, least=min(least, lab.MIN_IC)))
    out["half_life"] = _half_lives(out["decay"], names, "lag", "autocorr", lab.half_life)
    out["correlations"] = local(correlation.fisher_mean(correlation.pair_correlations(z, names, "spearman", least=least)))
    if price:
        forward = panel_ops.calendar_forward_returns(z, cal, price, horizons)
        out["ic_horizons"] = local(lab.ic_at_horizons(z.select("date", "ticker", *names), forward, names))
        out["ic_half_life"] = _half_lives(out["ic_horizons"], names, "h", "mean", lambda means: lab.ic_half_life(means, horizons))
    if bench is not None:
        regime = local(lab.regimes(bench, cal.select("date")))
        out["regimes"] = local(lab.by_regime(out["quantiles"].select("factor", "date", "spread"), regime, "spread", by=["factor"]))
    z.unpersist()
    return out


def _half_lives(curves: DataFrame, names: Sequence[str], x: str, y: str, half_life) -> DataFrame:
    points: dict[str, dict] = {n: {} for n in names}
    for row in curves.collect():
        points[row["factor"]][row[x]] = row[y]
    found = [(n, half_life(p)) for n, p in points.items()]
    return curves.sparkSession.createDataFrame([(n, h["days"], h["censored"]) for n, h in found], "factor string, days double, censored string")


def backtest_report(prices: DataFrame, signals: DataFrame, bench: str, caps: DataFrame | None = None, cost_bps: float = 10.0, rules: backtest.Rules = backtest.Rules(), floor: float | None = 5.0) -> dict[str, DataFrame]:
    """Month-end backtest of ``z_composite``: legs, spread at no and full cost, bounds, benchmark comparison.

    prices: date, ticker, px. signals: date, ticker, z_composite. caps: date, ticker, cap.
    The sensitivities are the same plan with other rules: entities that are gone for good a total loss, and no
    scores below a price.
    """
    cal = cal_ops.local(cal_ops.calendar(prices))
    trades = cal_ops.local(cal_ops.trade_calendar(cal, cal_ops.month_ends(cal)).select("trade_date"))
    z = signals.select("date", "ticker", F.col("z_composite").alias("z"))
    legs = backtest.run_backtest(prices, z, trades, rules)
    out = {
        "legs": backtest.net(legs, cost_bps),
        "leg_stats": backtest.leg_stats(backtest.net(legs, cost_bps)),
        "spread_gross": backtest.spread_report(legs, 0.0, rules.n),
        "spread_net": backtest.spread_report(legs, cost_bps, rules.n),
        "spread_total_loss": backtest.spread_report(backtest.run_backtest(prices, z, trades, replace(rules, gone_fill=-1.0, delist_fill=-1.0)), cost_bps, rules.n),
        "incidence": backtest.delist_incidence(prices, z, trades),
        "equal_weight": backtest.equal_weight_benchmark(prices, trades, z, rules),
    }
    if floor is not None:
        priced = z.join(prices, ["date", "ticker"], "left").select("date", "ticker", clean.price_floor("z", "px", floor).alias("z"))
        out["spread_price_floor"] = backtest.spread_report(backtest.run_backtest(prices, priced, trades, rules), cost_bps, rules.n)
    market = backtest.benchmark_returns(prices, trades, bench)
    top = backtest.net(legs.filter(F.col("q") == rules.n), cost_bps)
    out["top_vs_bench"] = backtest.long_only_report(cal_ops.local(top), market)
    if caps is not None:
        weighted = backtest.net(backtest.cap_weighted_top(prices, z, caps, trades, rules), cost_bps)
        out["cap_weighted_vs_bench"] = backtest.long_only_report(cal_ops.local(weighted), market)
    return out
