"""The live snapshot: latest prices and vintages of a universe with derived metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import number, safe_div
from . import clean
from .dedup import latest, trailing_sum, year_over_year
from .panel import earnings_yield, fcf_margin, live_price_stats, period_rank

#: Candidate vendor tags per output column, first present wins.
TAGS: Mapping[str, Sequence[str]] = {
    "market_cap": ["marketcap"], "pe_ratio": ["pricetoearnings"], "ps_ratio": ["pricetorevenue"], "peg_ratio": ["peg_ratio", "pegratio"], "roe": ["roe"], "roa": ["roa"], "gross_margin": ["grossmargin"],
    "profit_margin": ["profitmargin"], "debt_to_ebitda": ["debttoebitda"], "interest_coverage": ["ebittointerestex"], "ev_to_ebitda": ["evtoebitda"], "pb_ratio": ["pricetobook"], "enterprise_value": ["enterprisevalue"],
    "ebit_growth": ["ebitgrowth"], "ebitda_growth": ["ebitdagrowth"], "rev_growth": ["revenuegrowth"], "freecashflow": ["freecashflow"], "beta": ["beta"], "debt_to_equity": ["debttoequity"],
}
#: What the vendor's prices are in.
CURRENCY = "USD"


def latest_prices(prices: DataFrame) -> DataFrame:
    return latest(prices.filter(F.col("date").isNotNull()), "ticker", ["date", "close"], ["date", "close", "high_52w", "low_52w"])


def latest_vintages(calcs: DataFrame, ttm_only: bool = True, nulls_last: bool = False) -> DataFrame:
    """Tag columns of each ticker's latest vintage by (available date, period).

    By default rows without an availability date or a trailing period are no vintages; with
    ``nulls_last`` an unknown date counts as the latest and every period is taken.
    """
    df = calcs.withColumn("available_date", clean.available_date()).withColumn("__p", period_rank("fiscal_period", -1))
    if ttm_only and not nulls_last:
        df = clean.keep_ttm(df)
    order = F.desc_nulls_first("available_date") if nulls_last else F.desc_nulls_last("available_date")
    if not nulls_last:
        df = df.filter(F.col("available_date").isNotNull())
    w = Window.partitionBy("ticker").orderBy(order, F.desc("__p"))
    df = df.withColumn("__n", F.row_number().over(w)).filter("__n = 1")
    tags = clean.resolve_tags(df.columns, TAGS)
    return df.select("ticker", *[(number(t) if t else F.lit(None).cast("double")).alias(c) for c, t in tags.items()])


def revenue_metrics(income: DataFrame) -> DataFrame:
    """ticker, ttm, yoy, last_qtr from quarterly statements (duplicate quarters: last filing wins)."""
    q = income.filter(F.col("fiscal_period").rlike("^Q[1-4]$")).select("ticker", F.col("fiscal_year").try_cast("int").alias("fy"), F.substring("fiscal_period", 2, 1).cast("int").alias("q"), number("totalrevenue").alias("x"), "filing_date" if "filing_date" in income.columns else F.lit("").alias("filing_date"))
    q = q.filter(F.col("x").isNotNull()).groupBy("ticker", "fy", "q").agg(F.max_by("x", F.struct("filing_date", "x")).alias("x"))
    yoy = year_over_year(q, ["ticker"], "fy", "q", "x")
    return trailing_sum(q, ["ticker"], ["fy", "q"], "x").join(yoy, "ticker", "full").select("ticker", "ttm", "yoy", F.concat(F.lit("Q"), F.col("q").cast("string"), F.lit(" "), F.col("fy").cast("string")).alias("last_qtr"))


def build_live(universe: DataFrame, companies: DataFrame, prices: DataFrame, calcs: DataFrame, income: DataFrame, sectors: DataFrame, bench: str | None = "SPY", currency: str = CURRENCY, **windows) -> tuple[DataFrame, DataFrame]:
    """(snapshot, excluded): one row per universe ticker with a price, and those without.

    prices: ticker, date, close, adj_close, high_52w, low_52w. sectors: group, sector.
    """
    now = latest_prices(prices)
    frame = universe.select("ticker").join(now, "ticker")
    excluded = universe.join(now, "ticker", "left_anti").select("ticker")
    fundamentals = clean.explode_aliases(universe, latest_vintages(calcs))
    revenue = clean.explode_aliases(universe, revenue_metrics(income))
    first = companies.groupBy("ticker").agg(F.min(F.struct("name", "industry_group_name")).alias("c")).select("ticker", F.col("c.name").alias("company"), F.col("c.industry_group_name").alias("sector_raw"))
    frame = frame.join(clean.explode_aliases(universe, first), "ticker", "left")
    frame = clean.map_groups(frame, "sector_raw", sectors)  # before the larger joins, which its check need not run
    frame = frame.join(fundamentals, "ticker", "left").join(revenue, "ticker", "left")
    stats = live_price_stats(prices.withColumn("adj_close", number("adj_close")), bench, **windows)
    frame = frame.join(stats.select("ticker", F.col("vol").alias("vol_126d"), F.col("mom").alias("mom_12_1"), F.col("beta").alias("__beta")), "ticker", "left")
    w = Window.partitionBy("sector").orderBy("ticker")
    frame = frame.select(
        "*", F.col("close").alias("price"), F.coalesce("beta", "__beta").alias("trailing_beta"), earnings_yield("pe_ratio").alias("earn_yield"), fcf_margin("freecashflow", "ttm").alias("fcf_margin"), F.col("yoy").alias("sales_growth_q"),
        (safe_div(F.col("close"), F.col("high_52w")) - 1).alias("pct_below_52w_high"), (safe_div(F.col("close"), F.col("low_52w")) - 1).alias("pct_above_52w_low"), F.row_number().over(w).alias("n"), F.lit(currency).alias("currency"),
    ).drop("close", "__beta", "beta", "freecashflow", "ttm", "yoy")
    return frame, excluded
