"""Lagged, costed quantile backtests in long form.

There is no date x ticker matrix: periods are a small table, signals and prices stay long, and all
quantiles, sleeves and cost levels come out of one plan.  Costs are linear in turnover, so net
returns are a projection of gross returns and turnover and nothing is run again per cost.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructType

from ..functions.nulls import number, safe_div
from ..functions.stats import annualized, drawdowns, ratio_or_zero
from ..functions.xsec import quantile_labels
from ..operators.calendar import calendar, literal, local
from ..operators.clean import price_floor


@dataclass(frozen=True)
class Rules:
    """n quantiles; signal lag in dates; clip of observed holding returns; returns booked without an
    exit price: ``gap_fill`` if the entity trades again, ``gone_fill`` if never (None: no such
    distinction), ``delist_fill`` otherwise (None: 0). staleness: ``carry`` keeps an entity's last
    score, ``strict`` takes the signal date's only."""

    n: int = 5
    lag: int = 1
    clip: tuple[float, float] | None = (0.01, 0.99)
    gap_fill: float | None = 0.0
    gone_fill: float | None = -0.3
    delist_fill: float | None = -0.3
    staleness: str = "carry"


class _Cached:
    """Tables that several steps of one call read; released when it ends."""

    def __init__(self):
        self.tables: list[DataFrame] = []

    def __enter__(self) -> _Cached:
        return self

    def __call__(self, df: DataFrame) -> DataFrame:
        self.tables.append(df.persist())
        return self.tables[-1]

    def __exit__(self, *_) -> None:
        for df in self.tables:
            df.unpersist()


def periods(cal: DataFrame, trades: DataFrame, lag: int = 1) -> DataFrame:
    """k, trade_date, entry, exit, signal (positions), last: one row per rebalance.

    The exit is the next rebalance, for the final one the last date; periods that end where they
    begin, or have no signal date, are left out.  A trade date off the calendar is an error.
    """
    days = trades.select("trade_date")
    pos = {r["date"]: r["pos"] for r in cal.collect()}
    at = [r["trade_date"] for r in days.collect()]
    if not all(t in pos for t in at):
        raise ValueError("a trade date is not on the calendar")
    at.sort(key=lambda t: pos[t])
    rows = []
    for k, t in enumerate(at):
        last = k + 1 == len(at)
        end = max(pos.values()) if last else pos[at[k + 1]]
        if end > pos[t] and pos[t] >= lag:
            rows.append({"k": k, "trade_date": t, "entry": pos[t], "exit": end, "signal": pos[t] - lag, "last": last})
    kind = cal.schema["pos"].dataType
    schema = StructType().add("k", IntegerType()).add("trade_date", days.schema[0].dataType).add("entry", kind).add("exit", kind).add("signal", kind).add("last", BooleanType())
    return literal(cal.sparkSession, rows, schema)


def period_signals(signals: DataFrame, per: DataFrame, cal: DataFrame, staleness: str = "carry", by: Sequence[str] = ()) -> DataFrame:
    """by..., k, ticker, z: each entity's score at every period's signal date.

    Carried scores are intervals: a score holds from its date to the entity's next one.  The periods
    within an interval are listed through two small lookups by position and exploded, so the work is
    the number of results.
    """
    s = signals.filter(F.col("z").isNotNull()).join(F.broadcast(cal), "date").select(*by, "ticker", "pos", "z")
    if staleness == "strict":
        return s.join(F.broadcast(per.select("k", F.col("signal").alias("pos"))), "pos").select(*by, "k", "ticker", "z")
    known = sorted((r["signal"], r["k"]) for r in per.collect())
    end = max((k for _, k in known), default=-1) + 1
    places = [r["pos"] for r in cal.select("pos").collect()]
    schema = StructType().add("pos", cal.schema["pos"].dataType).add("from_k", IntegerType())
    first = literal(cal.sparkSession, [{"pos": p, "from_k": known[i][1] if (i := bisect_left(known, (p, -1))) < len(known) else end} for p in places], schema)
    w = Window.partitionBy(*by, "ticker").orderBy("pos")
    s = s.join(F.broadcast(first), "pos")
    s = s.withColumn("to_k", F.coalesce(F.lead("from_k").over(w), F.lit(end))).filter(F.col("to_k") > F.col("from_k"))
    return s.select(*by, F.explode(F.sequence("from_k", F.col("to_k") - 1)).alias("k"), "ticker", "z").join(F.broadcast(per.select("k")), "k", "left_semi")


def holdings(prices: DataFrame, per: DataFrame, cal: DataFrame, rules: Rules, members: DataFrame | None = None) -> DataFrame:
    """k, ticker, hold: return of every entity with an entry price in each period.

    Observed returns are clipped to the percentiles of all entities of the period (or of
    ``members`` only, if given as k, ticker).  An entity's prices at the periods' borders meet in one row
    (a map of a few hundred at most), with its last date; one exchange by entity serves all periods.  prices: one row
    for each date and ticker.
    """
    rows = sorted(per.collect(), key=lambda r: r["k"])
    used = sorted({r[c] for r in rows for c in ("entry", "exit")})
    px = prices.filter(F.col("px").isNotNull()).join(F.broadcast(cal), "date").select("ticker", "pos", "px")
    of = px.groupBy("ticker").agg(F.max("pos").alias("__seen"), F.map_from_entries(F.collect_list(F.when(F.col("pos").isin(used), F.struct("pos", "px")))).alias("__px"))
    each = F.array(*[F.struct(F.lit(r["k"]).alias("k"), F.lit(r["entry"]).alias("entry"), F.lit(r["exit"]).alias("exit"), F.lit(r["last"]).alias("last")) for r in rows])
    if not rows:
        each = F.array().cast("array<struct<k:int,entry:int,exit:int,last:boolean>>")
    start = of.select("ticker", "__seen", "__px", F.explode(each).alias("p")).select("p.k", "ticker", "__seen", "p.exit", "p.last", F.try_element_at("__px", F.col("p.entry")).alias("p0"), F.try_element_at("__px", F.col("p.exit")).alias("p1"))
    h = start.filter(F.col("p0").isNotNull())
    if members is not None:
        h = h.join(members.select("k", "ticker"), ["k", "ticker"], "left_semi")
    h = h.withColumn("raw", safe_div(F.col("p1"), F.col("p0")) - 1)
    hold = F.col("raw")
    if rules.clip:
        edges = h.groupBy("k").agg(F.percentile("raw", F.array(*map(F.lit, rules.clip))).alias("__p"))
        h = h.join(F.broadcast(edges), "k", "left")
        p = F.col("__p")
        hold = F.when(p[1] > p[0], F.greatest(F.least(F.col("raw"), p[1]), p[0])).otherwise(F.col("raw"))
    other = F.lit(rules.delist_fill).cast("double")
    fill = other
    if rules.gone_fill is not None:
        fill = F.when(F.col("last"), other).when(F.col("__seen") > F.col("exit"), F.lit(rules.gap_fill).cast("double")).otherwise(F.lit(rules.gone_fill).cast("double"))
    return h.select("k", "ticker", F.when(F.col("p1").isNull(), fill).otherwise(hold).alias("hold"))


def exit_fills(prices: DataFrame, per: DataFrame, cal: DataFrame, gone_fill: float = -0.3) -> DataFrame:
    """k, ticker, fill of entities with an entry but no exit price: 0 if they trade later, else gone_fill."""
    h = holdings(prices, per.withColumn("last", F.lit(False)), cal, Rules(clip=None, gap_fill=0.0, gone_fill=gone_fill))
    px = prices.filter(F.col("px").isNotNull()).join(F.broadcast(cal), "date").select("ticker", "pos")
    there = px.join(F.broadcast(per.select("k", F.col("exit").alias("pos"))), "pos").select("k", "ticker")
    return h.join(there, ["k", "ticker"], "left_anti").select("k", "ticker", F.col("hold").alias("fill"))


def leg_returns(weights: DataFrame, hold: DataFrame, legs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by..., q, k, gross, turnover of every leg in every period that has legs.

    weights: by..., q, k, ticker, w. legs: by..., q, k, seq (consecutive per leg).  Turnover is half
    the sum of absolute weight changes since the leg's previous period; each weight appears once
    as new and once, in the next period, as old, and one aggregation nets them.
    """
    key = [*by, "q"]
    held = weights.join(hold, ["k", "ticker"], "left").groupBy(*key, "k").agg(F.sum(F.col("w") * F.coalesce("hold", F.lit(0.0))).alias("gross"))
    small = legs.select(*key, "k", "seq")
    seqs = weights.join(F.broadcast(small), [*key, "k"]).select(*key, "seq", "ticker", "w")
    moves = seqs.unionByName(seqs.select(*key, (F.col("seq") + 1).alias("seq"), "ticker", (-F.col("w")).alias("w")))
    turn = moves.groupBy(*key, "seq", "ticker").agg(F.abs(F.sum("w")).alias("d")).groupBy(*key, "seq").agg((F.sum("d") / 2).alias("turnover"))
    out = small.join(held, [*key, "k"], "left").join(turn, [*key, "seq"], "left")
    return out.select(*key, "k", F.coalesce("gross", F.lit(0.0)).alias("gross"), F.coalesce("turnover", F.lit(0.0)).alias("turnover"))


def label_periods(signals: DataFrame, prices: DataFrame, per: DataFrame, cal: DataFrame, rules: Rules, by: Sequence[str] = ()) -> DataFrame:
    """by..., k, ticker, z, q for the periods with at least n distinct scores."""
    traded = prices.select("ticker").distinct()
    z = period_signals(signals.join(traded, "ticker", "left_semi"), per, cal, rules.staleness, by)
    return quantile_labels(z, "z", [*by, "k"], rules.n).filter(F.col("q").isNotNull())


def _legs(counts: DataFrame, n: int, by: Sequence[str]) -> DataFrame:
    """by..., k, seq, q of the periods that have labels. counts: a row for each by..., k, q."""
    live = counts.select(*by, "k").distinct()
    w = Window.partitionBy(*by).orderBy("k")
    live = live.withColumn("seq", F.row_number().over(w))
    return local(live.withColumn("q", F.explode(F.array(*map(F.lit, range(1, n + 1))))))


def run_backtest(prices: DataFrame, signals: DataFrame, trades: DataFrame, rules: Rules = Rules(), by: Sequence[str] = ()) -> DataFrame:
    """by..., q, k, trade_date, gross, turnover: equal-weighted quantile legs.

    prices: date, ticker, px. signals: by..., date, ticker, z. trades: trade_date.  ``by`` runs
    several sleeves in one plan.  The result, n rows a period and sleeve, is computed at once, so that
    what is cached on the way is released here.
    """
    with _Cached() as keep:
        prices = keep(prices.select("date", "ticker", "px"))
        cal = local(calendar(prices))
        per = periods(cal, trades, rules.lag)
        return _label_returns(keep(label_periods(signals, prices, per, cal, rules, by)), prices, per, cal, rules, by)


def _label_returns(labels: DataFrame, prices: DataFrame, per: DataFrame, cal: DataFrame, rules: Rules, by: Sequence[str]) -> DataFrame:
    counts = local(labels.groupBy(*by, "k", "q").agg(F.count(F.lit(1)).alias("__n")))  # a row for each leg and period
    weights = labels.join(F.broadcast(counts), [*by, "k", "q"]).select(*by, "q", "k", "ticker", (F.lit(1.0) / F.col("__n")).alias("w"))
    legs = _legs(counts, rules.n, by)
    return local(leg_returns(weights, holdings(prices, per, cal, rules), legs, by).join(F.broadcast(per.select("k", "trade_date")), "k"))


def net(returns: DataFrame, cost_bps: float) -> DataFrame:
    """Adds net = gross - turnover * cost; one projection per cost level."""
    return returns.withColumn("net", F.col("gross") - F.col("turnover") * F.lit(cost_bps / 1e4))


def cap_frame(panel: DataFrame, ends: DataFrame, cap: str = "market_cap") -> DataFrame:
    """date, ticker, cap: market caps as known at the given dates (the panel is point-in-time), coerced to numbers.

    Only the dates' rows are read: the dates are few and broadcast, so a panel by year is pruned by them at run time.  Of
    several rows for a date and ticker the largest cap counts.
    """
    rows = panel.select("date", "ticker", number(cap).alias("cap")).join(F.broadcast(ends.select("date").distinct()), "date")
    return rows.groupBy("date", "ticker").agg(F.max("cap").alias("cap"))


def sensitivities(prices: DataFrame, signals: DataFrame, trades: DataFrame, rules: Rules = Rules(), cost_bps: float = 10.0, loss: float = -1.0, floor: float | None = 5.0) -> DataFrame:
    """run, and the net spread report of: ``full``, ``delist100`` (an entity that is gone for good loses ``loss``) and ``px5`` (no score at a price below ``floor``, or without one).

    Signals: date, ticker, z.  Scores and prices are read once for all; the first two have the same labels and
    differ in the fill of what is gone, the third is a sleeve with fewer scores.
    """
    hard = replace(rules, gone_fill=loss if rules.gone_fill is not None else None, delist_fill=loss)
    with _Cached() as keep:
        prices, z = keep(prices.select("date", "ticker", "px")), keep(signals.select("date", "ticker", "z"))
        runs = z.withColumn("run", F.lit("full"))
        if floor is not None:
            priced = z.join(prices, ["date", "ticker"], "left")
            runs = runs.unionByName(priced.select("date", "ticker", price_floor("z", "px", floor).alias("z"), F.lit(f"px{floor:g}").alias("run")))
        cal = local(calendar(prices))
        per = periods(cal, trades, rules.lag)
        labels = keep(label_periods(runs, prices, per, cal, rules, ("run",)))
        same = labels.filter(F.col("run") == "full").withColumn("run", F.lit(f"delist{-100 * loss:g}"))
        both = [_label_returns(x, prices, per, cal, r, ("run",)) for x, r in ((labels, rules), (same, hard))]
        return spread_report(both[0].unionByName(both[1]), cost_bps, rules.n, by=("run",))


def cap_weighted_top(prices: DataFrame, signals: DataFrame, caps: DataFrame, trades: DataFrame, rules: Rules = Rules(), by: Sequence[str] = ()) -> DataFrame:
    """The top quantile weighted by market cap at the signal date. caps: date, ticker, cap.

    Members without a positive cap are left out and the rest renormalized; if none has one the
    period is equal-weighted.
    """
    with _Cached() as keep:
        return local(_cap_weighted(keep(prices.select("date", "ticker", "px")), signals, caps, trades, rules, by, keep))


def _cap_weighted(prices: DataFrame, signals: DataFrame, caps: DataFrame, trades: DataFrame, rules: Rules, by: Sequence[str], keep: _Cached) -> DataFrame:
    cal = local(calendar(prices))
    per = periods(cal, trades, rules.lag)
    labels = keep(label_periods(signals, prices, per, cal, rules, by).filter(F.col("q") == rules.n))
    at = per.select("k", (F.col("entry") - 1).alias("pos")).join(cal, "pos").select("k", "date")
    cap = caps.join(F.broadcast(at), "date").select("k", "ticker", F.when(F.col("cap") > 0, F.col("cap")).alias("cap"))
    w = Window.partitionBy(*by, "k")
    rows = labels.join(cap, ["k", "ticker"], "left").withColumn("all", F.sum("cap").over(w)).withColumn("members", F.count(F.lit(1)).over(w))
    weight = F.when(F.col("all") > 0, F.coalesce(F.col("cap") / F.col("all"), F.lit(0.0))).otherwise(F.lit(1.0) / F.col("members"))
    weights = rows.select(*by, "q", "k", "ticker", weight.alias("w"))
    legs = local(labels.select(*by, "k").distinct()).withColumn("seq", F.row_number().over(Window.partitionBy(*by).orderBy("k"))).withColumn("q", F.lit(rules.n))
    return leg_returns(weights, holdings(prices, per, cal, rules), legs, by).join(F.broadcast(per.select("k", "trade_date")), "k")


def equal_weight_benchmark(prices: DataFrame, trades: DataFrame, universe: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """k, trade_date, ret: mean return of the entities with a score on the latest signal date.

    universe: date, ticker, z (null: not a member).  Unlike the engine scores aren't carried, returns
    are clipped over the members only, and an entity without an entry price earns 0.
    """
    with _Cached() as keep:
        return local(_equal_weight(keep(prices.select("date", "ticker", "px")), trades, universe, rules))


def _equal_weight(prices: DataFrame, trades: DataFrame, universe: DataFrame, rules: Rules) -> DataFrame:
    cal = local(calendar(prices))
    per = periods(cal, trades, 0)
    per = per.filter(~F.col("last"))
    dates = universe.select("date").distinct()
    latest = per.join(F.broadcast(dates), F.col("date") <= F.col("trade_date")).groupBy("k").agg(F.max("date").alias("date"))
    members = universe.filter(F.col("z").isNotNull()).join(F.broadcast(latest), "date").join(prices.select("ticker").distinct(), "ticker", "left_semi").select("k", "ticker").distinct()
    hold = holdings(prices, per, cal, rules, members)
    out = members.join(hold, ["k", "ticker"], "left").groupBy("k").agg(F.avg(F.coalesce("hold", F.lit(0.0))).alias("ret"))
    return per.select("k", "trade_date").join(out, "k", "left")


def benchmark_returns(prices: DataFrame, trades: DataFrame, ticker: str) -> DataFrame:
    """trade_date, ret of one entity between trade dates, prices carried over trade dates.

    One entity on at most some hundred dates: the window without partition sees those only.
    """
    one = prices.filter((F.col("ticker") == ticker) & F.col("px").isNotNull()).select(F.col("date").alias("trade_date"), "px")
    w = Window.orderBy("trade_date")
    p = trades.select("trade_date").join(one, "trade_date", "left").withColumn("px", F.last("px", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if not p.filter(F.col("px").isNull()).isEmpty():
        raise ValueError(f"{ticker} has no price on or before the first trade date")
    return p.select("trade_date", (safe_div(F.lead("px").over(w), F.col("px")) - 1).alias("ret")).filter(F.col("ret").isNotNull())


def leg_stats(returns: DataFrame, r: str = "net", by: Sequence[str] = ("q",), order: str = "trade_date", periods_per_year: int = 12) -> DataFrame:
    """by..., ann_return, ann_vol, sharpe, max_dd, avg_turnover."""
    dd = drawdowns(returns, r, order, tuple(by))
    mean, vol = annualized(r, periods_per_year)
    return dd.groupBy(*by).agg(mean.alias("ann_return"), vol.alias("ann_vol"), F.min("dd").alias("max_dd"), F.avg("turnover").alias("avg_turnover")).withColumn("sharpe", ratio_or_zero(F.col("ann_return"), F.col("ann_vol")))


def spread_series(returns: DataFrame, cost_bps: float = 0.0, n: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """by..., trade_date, spread, turnover: top minus bottom leg, costs paid on both."""
    top, low = F.col("q") == n, F.col("q") == 1
    s = returns.groupBy(*by, "trade_date").agg(
        F.sum(F.when(top, F.col("gross")).when(low, -F.col("gross"))).alias("g"), F.sum(F.when(top | low, F.col("turnover"))).alias("turnover")
    )
    return s.select(*by, "trade_date", (F.col("g") - F.col("turnover") * F.lit(cost_bps / 1e4)).alias("spread"), "turnover")


def spread_report(returns: DataFrame, cost_bps: float = 0.0, n: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """Long-short summary per ``by``: compounded growth, drawdown, hit rate, turnover of both legs."""
    s = drawdowns(spread_series(returns, cost_bps, n, by), "spread", "trade_date", tuple(by))
    mean, vol = annualized("spread")
    out = s.groupBy(*by).agg(
        F.count(F.lit(1)).alias("periods"), mean.alias("ann_return"), vol.alias("ann_vol"), F.min("dd").alias("max_drawdown"), F.avg("turnover").alias("avg_turnover_ls"),
        F.avg((F.col("spread") > 0).cast("double")).alias("hit_rate"), (F.max_by("cum", "trade_date") - 1).alias("cumulative"),
    )
    return out.withColumn("sharpe", ratio_or_zero(F.col("ann_return"), F.col("ann_vol")))


def sleeve_report(returns: DataFrame, cost_bps: float = 10.0, n: int = 5, by: Sequence[str] = ("sleeve",)) -> DataFrame:
    """Spread report plus annual means of legs 1, middle and n and the split into long and short side."""
    mid = (n + 1) // 2
    legs = net(returns, cost_bps).groupBy(*by).agg(*[(F.avg(F.when(F.col("q") == q, F.col("net"))) * 12).alias(f"q{q}_ann") for q in (1, mid, n)])
    legs = legs.withColumn("long_contrib", F.col(f"q{n}_ann") - F.col(f"q{mid}_ann")).withColumn("short_contrib", F.col(f"q{mid}_ann") - F.col("q1_ann"))
    total = F.col("long_contrib") + F.col("short_contrib")
    return spread_report(returns, cost_bps, n, by).join(legs.withColumn("short_share", F.when(F.abs(total) > 1e-12, safe_div(F.col("short_contrib"), total))), list(by))


def long_only_report(leg: DataFrame, bench: DataFrame) -> DataFrame:
    """One row: a leg (trade_date, net, turnover) against a benchmark (trade_date, ret)."""
    rows = leg.join(bench.select("trade_date", "ret"), "trade_date").withColumn("active", F.col("net") - F.col("ret"))
    d = drawdowns(rows, "net", "trade_date")
    trough = F.min_by("trade_date", F.struct("dd", "trade_date"))
    low = d.agg(trough.alias("trough"))
    d = d.crossJoin(F.broadcast(low))
    d = d.withColumn("__before", F.when(F.col("trade_date") <= F.col("trough"), F.struct(F.col("cum"), -F.datediff("trade_date", F.lit("1970-01-01").cast("date")))))
    (a_ret, a_vol), (x_ret, x_vol) = annualized("net"), annualized("active")
    out = d.agg(
        F.count(F.lit(1)).alias("periods"), a_ret.alias("ann_return"), a_vol.alias("ann_vol"), F.min("dd").alias("max_drawdown"),
        F.max_by("trade_date", "__before").alias("dd_peak"), F.max("trough").alias("dd_trough"),
        F.min(F.when((F.col("trade_date") >= F.col("trough")) & (F.col("dd") >= 0), F.col("trade_date"))).alias("dd_recovered"),
        F.avg("turnover").alias("avg_turnover"), F.avg((F.col("net") > 0).cast("double")).alias("hit_rate"),
        (F.avg("ret") * 12).alias("bench_ann_return"), x_ret.alias("ann_active_return"), x_vol.alias("ann_tracking_error"),
        F.avg((F.col("active") > 0).cast("double")).alias("hit_rate_vs_bench"), (F.product(1 + F.col("net")) - 1).alias("cumulative"), (F.product(1 + F.col("active")) - 1).alias("cumulative_active"),
    )
    return out.withColumn("sharpe", ratio_or_zero(F.col("ann_return"), F.col("ann_vol"))).withColumn("information_ratio", ratio_or_zero(F.col("ann_active_return"), F.col("ann_tracking_error")))


def delist_incidence(prices: DataFrame, universe: DataFrame, trades: DataFrame) -> DataFrame:
    """One row: held, no_exit, share of held names without a price at the period's end.

    Held: a score on the month end before the trade date (not carried) and an entry price.
    """
    cal = local(calendar(prices))
    per = periods(cal, trades, 1).filter(~F.col("last"))
    sig = per.join(cal.withColumnRenamed("pos", "signal"), "signal").select("k", "date")
    members = universe.filter(F.col("z").isNotNull()).join(F.broadcast(sig), "date").select("k", "ticker")
    px = prices.filter(F.col("px").isNotNull()).join(F.broadcast(cal), "date").select("ticker", "pos")
    entry = px.join(F.broadcast(per.select("k", F.col("entry").alias("pos"))), "pos").select("k", "ticker")
    end = px.join(F.broadcast(per.select("k", F.col("exit").alias("pos"))), "pos").select("k", "ticker", F.lit(1).alias("there"))
    held = members.join(entry, ["k", "ticker"], "left_semi").join(end, ["k", "ticker"], "left")
    return held.agg(F.count(F.lit(1)).alias("held"), F.count(F.when(F.col("there").isNull(), 1)).alias("no_exit")).withColumn("share", safe_div(F.col("no_exit").cast("double"), F.col("held").cast("double")))


def turnover_between(old: DataFrame, new: DataFrame, key: str = "ticker", by: Sequence[str] = ()) -> DataFrame:
    """Half the sum of absolute weight changes; a name missing on a side has weight 0 there."""
    moves = new.select(*by, key, "w").unionByName(old.select(*by, key, (-F.col("w")).alias("w")))
    return moves.groupBy(*by, key).agg(F.sum("w").alias("d")).groupBy(*by).agg((F.sum(F.abs("d")) / 2).alias("turnover"))


def apply_caps(weights: DataFrame, max_position: float = 0.05, max_group: float = 0.30, group: str = "sector") -> DataFrame:
    """Clip single weights, scale groups above the limit down, then renormalize to 1.

    One scaling brings a group to its limit exactly and touches no other; the last step may exceed
    the caps again, by definition.  Names without a group are clipped but belong to none that is capped.
    """
    rows = weights.withColumn("w", F.least(F.col("w"), F.lit(max_position)))
    rows = rows.withColumn("__g", F.when(F.col(group).isNotNull(), F.sum("w").over(Window.partitionBy(group))))
    rows = rows.withColumn("w", F.when(F.col("__g") > max_group, F.col("w") * max_group / F.col("__g")).otherwise(F.col("w"))).drop("__g")
    total = rows.agg(F.sum("w").alias("__t"))
    return rows.crossJoin(F.broadcast(total)).withColumn("w", F.when(F.col("__t") != 0, F.col("w") / F.col("__t")).otherwise(F.col("w"))).drop("__t")
