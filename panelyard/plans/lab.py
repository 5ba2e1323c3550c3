"""Signal diagnostics: rank IC, quantile spreads, decay, horizons, regimes."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import covariance_corr, safe_div
from ..functions.stats import annualized, series_summary, tstat
from ..functions.xsec import average_rank, quantile_labels, winsorize_percentiles

MIN_IC, MIN_PER_DATE = 30, 200
HORIZONS = (21, 63, 126, 252)
LAGS, HALF = (5, 21, 42, 63, 126, 189, 252), 0.5


def dense_dates(df: DataFrame, x: str, least: int = MIN_PER_DATE, date: str = "date") -> DataFrame:
    """Rows of the dates on which x has at least ``least`` values: counts per date, and a semi-join with the dates, which are few."""
    dense = df.groupBy(date).agg(F.count(x).alias("__n")).filter(F.col("__n") >= least).select(date)
    return df.join(F.broadcast(dense), date, "left_semi")


def ic_series(df: DataFrame, x: str, y: str, by: Sequence[str] = ("date",), least: int = MIN_IC) -> DataFrame:
    """ic per group: Pearson correlation of average ranks of complete pairs.

    NULL with fewer than ``least`` pairs or a constant side.  One exchange by the group serves ranks
    and correlation.  Twice a rank is a whole number and twice the mean rank is n + 1, so the sums are exact (up to some 200,000
    pairs) whatever the order of rows: a correlation of 0 is 0, not a trifle on either side of it.
    """
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("__x"), F.col(y).alias("__y"))
    ranked = pairs.withColumn("__rx", average_rank("__x", by)).withColumn("__ry", average_rank("__y", by))
    ranked = ranked.withColumns({"__rx": F.col("__rx") * 2.0, "__ry": F.col("__ry") * 2.0})
    n = F.count(F.lit(1)).cast("double")
    xy, xx, yy = (F.sum(F.col(a) * F.col(b)) - n * (n + 1) * (n + 1) for a, b in (("__rx", "__ry"), ("__rx", "__rx"), ("__ry", "__ry")))
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.when((F.count(F.lit(1)) >= least) & (F.min("__rx") < F.max("__rx")) & (F.min("__ry") < F.max("__ry")), F.try_divide(xy, F.sqrt(xx) * F.sqrt(yy))).alias("ic"))


def composite_ic(df: DataFrame, z: str = "z_composite", ret: str = "ret_fwd_1", by: Sequence[str] = ("date",)) -> DataFrame:
    """IC of a composite on every date that has two complete pairs or more."""
    return ic_series(df, z, ret, by, least=2)


def ic_summary(ics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return ics.filter(F.col("ic").isNotNull()).groupBy(*by).agg(*series_summary("ic"))


def quantile_returns(df: DataFrame, z: str, ret: str, n: int = 5, date: str = "date", limits: tuple[float, float] | None = (0.01, 0.99), least: int | None = None) -> DataFrame:
    """date, q1..qn, spread: equal-weighted mean returns of the quantiles.

    Returns are clipped to the date's percentiles over all rows first; a date needs ``least`` (10 n)
    scores in n distinct bins and as many rows with a return.
    """
    least = n * 10 if least is None else least
    rows = winsorize_percentiles(df.select(date, z, ret), ret, [date], *limits) if limits else df.select(date, z, ret)
    rows = quantile_labels(rows, z, [date], n, "__q", least, need_all=True).filter(F.col("__q").isNotNull() & F.col(ret).isNotNull())
    legs = rows.groupBy(date).agg(F.count(F.lit(1)).alias("__n"), *[F.avg(F.when(F.col("__q") == q, F.col(ret))).alias(f"q{q}") for q in range(1, n + 1)])
    full = F.col("__n") >= least
    for q in range(1, n + 1):
        full = full & F.col(f"q{q}").isNotNull()
    return legs.filter(full).drop("__n").withColumn("spread", F.col(f"q{n}") - F.col("q1"))


def spread_summary(returns: DataFrame, n: int = 5, by: Sequence[str] = ()) -> DataFrame:
    return returns.groupBy(*by).agg(*series_summary("spread"), F.avg("q1").alias("q1_mean"), F.avg(f"q{n}").alias(f"q{n}_mean"), F.sum("spread").alias("cumulative"))


def annual_spreads(returns: DataFrame, date: str = "date", by: Sequence[str] = ()) -> DataFrame:
    return returns.groupBy(*by, F.year(date).alias("year")).agg(F.avg("spread").alias("mean_spread"), F.count(F.lit(1)).alias("n"))


def decay_curve(df: DataFrame, x: str, cal: DataFrame, bases: DataFrame, lags: Sequence[int], entity: str = "ticker", date: str = "date", least: int = MIN_IC) -> DataFrame:
    """lag, autocorr, n: mean over base dates of the correlation of ranks at t and t + lag.

    Ranks are over the whole cross-section of each date and not taken again on the common entities.
    The offset is on the calendar.  Base rows are spread over the lags, then joined on (entity, position).
    """
    ranks = df.filter(F.col(x).isNotNull()).select(entity, date, x).withColumn("__r", average_rank(x, [date]))
    ranks = ranks.join(F.broadcast(cal.withColumnRenamed("date", date)), date).select(entity, "pos", "__r")
    start = ranks.join(F.broadcast(bases.select("pos")), "pos", "left_semi")
    start = start.withColumn("lag", F.explode(F.array(*map(F.lit, lags)))).select(entity, F.col("pos").alias("base"), "lag", (F.col("pos") + F.col("lag")).alias("pos"), F.col("__r").alias("r0"))
    both = start.join(ranks.withColumnRenamed("__r", "r1"), [entity, "pos"])
    per = both.groupBy("lag", "base").agg(F.when(F.count(F.lit(1)) >= least, covariance_corr("r0", "r1")).alias("c"))
    return per.groupBy("lag").agg(F.avg("c").alias("autocorr"), F.count("c").alias("n"))


def comparison(broad: DataFrame, large: DataFrame, key: str = "sleeve", least: int = 10) -> DataFrame:
    """IC summaries of the broad and the large-cap universe side by side; NULL where one has fewer than ``least`` dates."""
    side = lambda df, name: df.select(key, *[F.when(F.col("n") >= least, F.col(c)).alias(f"{name}_{c}") for c in ("mean", "tstat")], F.col("n").alias(f"{name}_n"))
    return side(broad, "broad").join(side(large, "large"), key, "full").withColumn("delta", F.col("large_mean") - F.col("broad_mean"))


def flag_members(df: DataFrame, members: DataFrame, flag: str = "is_lc", keys: Sequence[str] = ("date", "ticker")) -> DataFrame:
    """Adds whether the row's keys are in ``members`` (which may repeat them)."""
    there = members.select(*keys).distinct().withColumn(flag, F.lit(True))
    return df.join(there, list(keys), "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def universe_efficacy(df: DataFrame, factors: Sequence[str], returns: Sequence[str], flag: str = "is_lc", least: int = MIN_PER_DATE, dates: int = 10, names: tuple[str, str] = ("broad", "lc")) -> DataFrame:
    """A row for each factor: its coverage in all rows and in the flagged ones, and mean and t-statistic of its rank IC with each return in both.

    Coverage counts every row of a universe, IC only dates with ``least`` complete pairs, and a universe with
    fewer than ``dates`` such dates has no IC.  All factors, returns and universes are ranked in one plan: a row for each of
    them, so the work is their number times the rows.
    """
    every, some = names
    cover = df.agg(*[f(c) for c in factors for f in (lambda c: F.avg(F.col(c).isNotNull().cast("double")).alias(f"{every}|{c}"), lambda c: F.avg(F.when(F.col(flag), F.col(c).isNotNull().cast("double"))).alias(f"{some}|{c}"))])
    cover = cover.select(F.explode(F.array(*[F.struct(F.lit(c).alias("factor"), F.col(f"{every}|{c}").alias(f"cov_{every}"), F.col(f"{some}|{c}").alias(f"cov_{some}")) for c in factors])).alias("x")).select("x.*")
    long = df.select("date", flag, *returns, *factors).unpivot(["date", flag, *returns], list(factors), "factor", "__z").unpivot(["date", flag, "factor", "__z"], list(returns), "ret", "__y")
    both = F.when(F.col(flag), F.array(F.lit(every), F.lit(some))).otherwise(F.array(F.lit(every)))
    long = long.filter(F.col("__z").isNotNull() & F.col("__y").isNotNull()).withColumn("universe", F.explode(both))
    ics = ic_series(long, "__z", "__y", ["factor", "ret", "universe", "date"], least).filter(F.col("n") >= least)
    found = ics.groupBy("factor", "ret", "universe").agg(F.count(F.lit(1)).alias("__dates"), F.avg("ic").alias("ic"), tstat(F.col("ic")).alias("t")).filter(F.col("__dates") >= dates)
    wide = found.groupBy("factor").agg(*[F.max(F.when((F.col("ret") == y) & (F.col("universe") == u), F.col(v))).alias(f"{v}_{y}_{u}") for y in returns for u in names for v in ("ic", "t")])
    return cover.join(wide, "factor", "left")


def half_life(decay: Mapping[int, float | None], threshold: float = HALF) -> dict:
    """First lag at which the curve crosses the threshold, interpolated; a handful of numbers."""
    pts = [(k, v) for k, v in sorted(decay.items()) if v is not None and not math.isnan(v)]
    if not pts:
        return {"days": None, "censored": "no-data"}
    return _crossing(pts, threshold, pts[0][1] < threshold, "below-threshold-at-first-lag", f"above-{threshold}-at-max-lag")


def ic_half_life(means: Mapping[int, float | None], horizons: Sequence[int] = HORIZONS) -> dict:
    """Horizon at which the mean IC first falls to half of its first value."""
    pts = [(h, means[h]) for h in horizons if means.get(h) is not None and math.isfinite(means[h])]
    if not pts:
        return {"days": None, "censored": "no-data"}
    if pts[0][1] <= 0:
        return {"days": None, "censored": "nonpositive-base-ic"}
    return _crossing(pts, pts[0][1] / 2, False, "below-half-at-first-horizon", "above-half-at-max-horizon")


def _crossing(pts: list[tuple[int, float]], level: float, below: bool, at_first: str, at_last: str) -> dict:
    if below:
        return {"days": float(pts[0][0]), "censored": at_first}
    for i in range(1, len(pts)):
        (a, va), (b, vb) = pts[i - 1], pts[i]
        if vb <= level <= va and va != vb:
            return {"days": float(a + (va - level) / (va - vb) * (b - a)), "censored": None}
    return {"days": float(pts[-1][0]), "censored": at_last}


def ic_at_horizons(signals: DataFrame, forward: DataFrame, columns: Sequence[str], entity: str = "ticker", date: str = "date", least: int = MIN_IC) -> DataFrame:
    """factor, h and the IC summary. forward: entity, date, h, fwd."""
    long = signals.unpivot([date, entity], list(columns), "factor", "z").filter(F.col("z").isNotNull())
    return ic_summary(ic_series(long.join(forward, [entity, date]), "z", "fwd", ["factor", "h", date], least), ["factor", "h"])


def regimes(bench: DataFrame, dates: DataFrame, price: str = "adj_close", date: str = "date", look: int = 21, vol: int = 63) -> DataFrame:
    """date, trail_ret, vol, mkt_up, high_vol at the given dates, from one entity's price series.

    high_vol is strictly above the median over the dates; a date needs ``vol`` earlier rows.
    The windows run over a single series.
    """
    w = Window.orderBy(date)
    s = bench.filter(F.col(price).isNotNull()).select(date, F.col(price).alias("p")).withColumn("i", F.row_number().over(w) - 1)
    s = s.withColumn("r", safe_div(F.col("p"), F.lag("p").over(w)) - 1)
    s = s.withColumn("trail_ret", safe_div(F.col("p"), F.lag("p", look).over(w)) - 1).withColumn("vol", F.stddev_samp("r").over(w.rowsBetween(1 - vol, 0)))
    at = s.filter(F.col("i") >= vol).join(F.broadcast(dates.select(date)), date, "left_semi").select(date, "trail_ret", "vol")
    return at.crossJoin(F.broadcast(at.agg(F.median("vol").alias("mid")))).select(date, "trail_ret", "vol", (F.col("trail_ret") > 0).alias("mkt_up"), (F.col("vol") > F.col("mid")).alias("high_vol"))


def by_regime(series: DataFrame, regime: DataFrame, x: str, date: str = "date", periods: int = 12, by: Sequence[str] = ()) -> DataFrame:
    """by..., flag, state, n, ann_mean of a per-date series under each regime."""
    rows = series.join(F.broadcast(regime), date).unpivot([*by, date, x], ["mkt_up", "high_vol"], "flag", "state")
    return rows.groupBy(*by, "flag", "state").agg(F.count(x).alias("n"), annualized(x, periods)[0].alias("ann_mean"))


def panel_sleeve_stats(df: DataFrame, sleeves: Mapping[str, Sequence[str]], ret: str, date: str = "date", least: int = MIN_IC) -> DataFrame:
    """IC summary and coverage of arbitrary member lists, one row per sleeve."""
    from .scoring import sleeve_column

    wide = df.withColumns({f"__s_{s}": sleeve_column(df, m) for s, m in sleeves.items()})
    long = wide.select(date, ret, *[F.col(f"__s_{s}").alias(s) for s in sleeves]).unpivot([date, ret], list(sleeves), "sleeve", "z")
    cover = long.groupBy("sleeve").agg(F.avg(F.col("z").isNotNull().cast("double")).alias("coverage"))
    return ic_summary(ic_series(long, "z", ret, ["sleeve", date], least), ["sleeve"]).join(cover, "sleeve")

