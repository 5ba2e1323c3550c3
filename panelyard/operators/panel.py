"""Panel construction: returns by row offset and calendar offset, price-derived proxies, joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import number, safe_div
from .asof import asof_backward

#: Rank of period labels; of vintages known on the same day the highest wins.
PERIOD_RANK = {"Q1TTM": 1, "Q2TTM": 2, "Q3TTM": 3, "FY": 4}
UNKNOWN_SECTOR = "unknown"


def period_rank(period: str, other: int = 0) -> Column:
    c = F.lit(other)
    for name, rank in PERIOD_RANK.items():
        c = F.when(F.col(period) == name, rank).otherwise(c)
    return c


def row_returns(df: DataFrame, price: str, trailing: Sequence[int], forward: Sequence[int], entity: str = "ticker", date: str = "date") -> DataFrame:
    """ret_<k> over the k rows before, ret_fwd_<k> over the k rows after, per entity (one window)."""
    w = Window.partitionBy(entity).orderBy(date)
    p = F.col(price)
    new = {f"ret_{k}": safe_div(p, F.lag(price, k).over(w)) - 1 for k in trailing}
    new |= {f"ret_fwd_{k}": safe_div(F.lead(price, k).over(w), p) - 1 for k in forward}
    return df.withColumns(new)


def calendar_forward_returns(df: DataFrame, cal: DataFrame, price: str, horizons: Sequence[int], entity: str = "ticker", date: str = "date") -> DataFrame:
    """entity, date, h, fwd: return to the calendar position h later, by join on (entity, position).

    Unlike ``row_returns`` this counts calendar dates, so gaps in an entity's own rows matter.
    """
    at = df.select(entity, date, price).join(F.broadcast(cal.withColumnRenamed("date", date)), date)
    start = at.filter(F.col(price).isNotNull()).withColumn("h", F.explode(F.array(*map(F.lit, horizons)))).withColumn("__to", F.col("pos") + F.col("h"))
    end = at.select(entity, F.col("pos").alias("__to"), F.col(price).alias("__end"))
    return start.join(end, [entity, "__to"], "left").select(entity, date, "h", (safe_div(F.col("__end"), F.col(price)) - 1).alias("fwd"))


def momentum(price: str, skip: int, look: int, entity: str = "ticker", date: str = "date") -> Column:
    w = Window.partitionBy(entity).orderBy(date)
    return safe_div(F.lag(price, skip).over(w), F.lag(price, look).over(w)) - 1


def rolling_vol(ret: str, window: int, per_year: int = 252, entity: str = "ticker", date: str = "date") -> Column:
    """Annualized sample deviation of the last ``window`` returns; NULL with any missing."""
    w = Window.partitionBy(entity).orderBy(date).rowsBetween(1 - window, 0)
    return F.when(F.count(ret).over(w) == window, F.stddev_samp(ret).over(w) * F.sqrt(F.lit(float(per_year))))


def rolling_beta(ret: str, bench: str, window: int, entity: str = "ticker", date: str = "date") -> Column:
    """Sample covariance over variance of the last ``window`` complete pairs."""
    w = Window.partitionBy(entity).orderBy(date).rowsBetween(1 - window, 0)
    both = F.col(ret).isNotNull() & F.col(bench).isNotNull()
    a, b = F.when(both, F.col(ret)), F.when(both, F.col(bench))
    return F.when(F.count(a).over(w) == window, F.try_divide(F.covar_samp(a, b).over(w), F.var_samp(b).over(w)))


def live_price_stats(df: DataFrame, bench: str | None, price: str = "adj_close", entity: str = "ticker", date: str = "date", beta_n: int = 252, vol_n: int = 126, look: int = 252, skip: int = 21, jump: float = 1.0, min_beta: int = 60, per_year: int = 252) -> DataFrame:
    """entity, beta, vol, mom from the last rows of each entity, NULL where a bad tick is in the window.

    A bad tick is a log return above ``jump`` in size.  Beta uses log returns on dates shared with
    the benchmark entity, volatility simple returns, momentum prices.
    """
    back, fwd = Window.partitionBy(entity).orderBy(F.desc(date)), Window.partitionBy(entity).orderBy(date)
    rows = df.filter(F.col(price).isNotNull()).select(entity, date, F.col(price).alias("p"))
    prev = F.lag("p").over(fwd)
    rows = rows.withColumn("lr", F.ln(safe_div(F.col("p"), prev))).withColumn("sr", safe_div(F.col("p"), prev) - 1).withColumn("n", F.row_number().over(back))

    def bad(window: int) -> Column:
        return F.coalesce(F.max(F.when(F.col("n") <= window, F.abs("lr"))) > jump, F.lit(False))

    base, top = F.max(F.when(F.col("n") == look + 1, F.col("p"))), F.max(F.when(F.col("n") == skip + 1, F.col("p")))
    vols = F.when(F.col("n") <= vol_n, F.col("sr"))
    out = rows.groupBy(entity).agg(
        F.when(~bad(vol_n) & (F.count(vols) == vol_n), F.stddev_samp(vols) * F.sqrt(F.lit(float(per_year)))).alias("vol"),
        F.when(~bad(look) & (base > 0) & (top > 0), safe_div(top, base) - 1).alias("mom"),
        bad(beta_n).alias("__bad"),
    )
    if bench is None:
        return out.drop("__bad").withColumn("beta", F.lit(None).cast("double"))
    recent = rows.filter((F.col("n") <= beta_n) & F.col("lr").isNotNull())
    market = recent.filter(F.col(entity) == bench).select(date, F.col("lr").alias("m"))
    beta = recent.join(market, date).groupBy(entity).agg(F.when((F.count("lr") >= min_beta) & (F.var_samp("m") != 0), F.try_divide(F.covar_samp("lr", "m"), F.var_samp("m"))).alias("beta"))
    return out.join(beta, entity, "left").withColumn("beta", F.when(~F.col("__bad"), F.col("beta"))).drop("__bad")


def fcf_margin(fcf: str = "fcf", revenue: str = "revenue") -> Column:
    return F.when(F.col(revenue) != 0, safe_div(F.col(fcf), F.col(revenue)))


def earnings_yield(pe: str = "pe") -> Column:
    return F.when(F.col(pe) != 0, safe_div(F.lit(1.0), F.col(pe)))


def has_suffix(entity: str = "ticker") -> Column:
    return F.col(entity).rlike(r"[.\-]")


def with_sector(df: DataFrame, companies: DataFrame, key: str = "company_id") -> DataFrame:
    """Adds the sector of the first company row per key, ``unknown`` where there is none."""
    first = companies.groupBy(key).agg(F.min_by("sector", F.coalesce(F.col("row"), F.lit(0))).alias("sector") if "row" in companies.columns else F.min("sector").alias("sector"))
    return df.join(first, key, "left").withColumn("sector", F.coalesce("sector", F.lit(UNKNOWN_SECTOR)))


def build_panel(prices: DataFrame, fundamentals: DataFrame, revenue: DataFrame, companies: DataFrame, factor_names: dict[str, str], trailing=(21, 126, 252), forward=(21, 63)) -> DataFrame:
    """Prices with the fundamentals and revenue known on each date, sector, returns and margins.

    Two exchanges by ticker at most (each as-of join and the returns share their keys), one small
    join for sectors. Renaming follows ``factor_names`` (vendor name -> panel name).
    """
    have = [c for c in factor_names if c in fundamentals.columns]
    funds = fundamentals.select("ticker", "available_date", "fiscal_period", *[number(c).alias(c) for c in have])
    p = asof_backward(prices, funds, "ticker", "date", "available_date", have, [F.desc(period_rank("fiscal_period"))])
    p = asof_backward(p, revenue.select("ticker", "available_date", number("totalrevenue").alias("revenue")), "ticker", "date", "available_date", ["revenue"], [F.desc("revenue")])
    p = p.withColumnsRenamed({c: factor_names[c] for c in have})
    p = row_returns(with_sector(p, companies), "adj_close", trailing, forward).withColumn("has_suffix", has_suffix())
    margin = fcf_margin() if "fcf" in p.columns else F.lit(None).cast("double")
    return p.withColumn("fcf_margin", margin).withColumn("year", F.year("date"))
