"""More registered queries: panel construction, signal frames, reports and correlation structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import adapters as ad
from .catalog import _LAB, _SP, _SUMMARY, RET, SUP, _ic, _lab, _sup, _sup_returns, _wide, _z, query, r
from .functions import xsec
from .functions.stats import series_summary
from .operators import calendar, clean, live, panel
from .plans import correlation, lab, reports, scoring

# ---------------------------------------------------------------- cleaning and panel construction


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 3 = 0 THEN 'no_availability' END AS quarantine_reason, NULL::DOUBLE AS grossmargin, CASE WHEN o_orderstatus = 'F' THEN 'FY' ELSE 'Q1TTM' END AS fiscal_period
  FROM orders WHERE o_orderstatus IN ('F', 'O')""")
def vintage_quarantine(spark, d):
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    raw = ad.read(spark, d, "orders").select(k, F.when(k % 5 != 0, day.cast("string")).alias("filing_date"), F.when(k % 3 != 0, day.cast("string")).alias("first_calculable_at"), F.when(F.col("o_orderstatus") == "F", "FY").when(F.col("o_orderstatus") == "O", "Q1TTM").otherwise("Q9").alias("fiscal_period"))
    return clean.clean_vintages(raw).select("o_orderkey", "quarantine_reason", "grossmargin", "fiscal_period")


@query("""SELECT period AS fiscal_period, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus = 'F' THEN 'FY' WHEN o_orderstatus = 'O' THEN 'Q1' ELSE NULL END AS period FROM orders) WHERE period IS NULL OR period <> 'FY' GROUP BY period""")
def skipped_periods(spark, d):
    raw = ad.read(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "F", "FY").when(F.col("o_orderstatus") == "O", "Q1").alias("fiscal_period"))
    return clean.skipped_periods(raw)


@query(f"SELECT p_partkey, {r('CASE WHEN p_size <> 25 THEN 1 / (p_size - 25)::DOUBLE END AS earn_yield', 'CASE WHEN p_size > 25 THEN (p_size - 25)::DOUBLE END AS positive')} FROM part")
def earnings_yield(spark, d):
    p = ad.read(spark, d, "part").select("p_partkey", (F.col("p_size") - 25).cast("double").alias("pe"))
    return p.select("p_partkey", panel.earnings_yield().alias("earn_yield"), clean.quarantine_nonpositive("pe").alias("positive"))


@query("SELECT 'p_retailprice' AS field, 0::BIGINT AS zeros UNION ALL SELECT 'size', (count(*) FILTER (p_size = 7))::BIGINT FROM part")
def validate_counts(spark, d):
    p = ad.read(spark, d, "part").select(F.col("p_partkey").alias("ticker"), F.col("p_retailprice"), (F.col("p_size") - 7).cast("double").alias("size"), F.lit("x").alias("price"))
    found = clean.validate(p, ["ticker", "price"])
    return spark.createDataFrame(sorted(found.items()), "field string, zeros bigint")


_FUNDS = """fu AS (SELECT l_suppkey AS ticker, date_trunc('quarter', l_shipdate)::DATE + 135 AS a, count(*)::DOUBLE AS pe, sum(l_quantity::BIGINT)::DOUBLE AS fcf, (sum(round(l_extendedprice * 100)::BIGINT) / 100.0)::DOUBLE AS rev FROM lineitem GROUP BY ALL)"""


@query(f"""WITH {SUP}, {_FUNDS}, p1 AS (SELECT s.ticker, s.date, s.px, f.pe, f.fcf FROM sup s ASOF LEFT JOIN fu f ON s.ticker = f.ticker AND s.date >= f.a),
  p2 AS (SELECT p1.*, f.rev FROM p1 ASOF LEFT JOIN (SELECT ticker, a + 20 AS a, rev FROM fu) f ON p1.ticker = f.ticker AND p1.date >= f.a)
  SELECT p2.ticker, p2.date, {r('pe', 'fcf', 'rev AS revenue', 'CASE WHEN rev <> 0 THEN fcf / rev END AS fcf_margin', 'px / lag(px) OVER w - 1 AS ret_1', 'lead(px) OVER w / px - 1 AS ret_fwd_1')},
    r_name AS sector, false AS has_suffix, year(p2.date)::INTEGER AS year
  FROM p2 JOIN supplier ON p2.ticker = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WINDOW w AS (PARTITION BY p2.ticker ORDER BY p2.date)""")
def point_in_time_panel(spark, d):
    prices = _sup(spark, d).select("ticker", F.col("ticker").alias("company_id"), "date", F.col("px").alias("adj_close"))
    li = ad.read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("ticker"), F.to_date(F.date_trunc("quarter", "l_shipdate")).alias("q"))
    f = li.agg(F.count(F.lit(1)).alias("pricetoearnings"), F.sum(F.col("l_quantity").cast("long")).alias("freecashflow"), (F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")) / 100.0).alias("totalrevenue"))
    f = f.withColumn("available_date", F.date_add("q", 135)).withColumn("fiscal_period", F.lit("FY"))
    s = ad.read(spark, d, "supplier").join(ad.read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(ad.read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    companies = s.select(F.col("s_suppkey").alias("company_id"), F.explode(F.array(F.struct(F.lit(1).alias("row"), F.lit("later").alias("sector")), F.struct(F.lit(0).alias("row"), F.col("r_name").alias("sector")))).alias("c")).select("company_id", "c.*")
    revenue = f.select("ticker", F.date_add("available_date", 20).alias("available_date"), "totalrevenue")
    out = panel.build_panel(prices, f, revenue, companies, {"pricetoearnings": "pe", "freecashflow": "fcf", "absent": "none"}, (1,), (1,))
    return out.select("ticker", "date", "pe", "fcf", "revenue", "fcf_margin", "ret_1", "ret_fwd_1", "sector", "has_suffix", "year")


_LIVE_TICKER = "CASE WHEN {0} = 1 THEN 'GOOG' ELSE 'T' || {0} END"


@query(f"""WITH {SUP}, {_FUNDS}, lp AS (SELECT ticker, max_by(px, date) AS price, max_by(px + volume, date) AS hi, max_by(px / 2, date) AS lo FROM sup GROUP BY ticker),
  lc AS (SELECT ticker, max_by(pe - 3, a) AS pe, max_by(fcf, a) AS fcf FROM fu GROUP BY ticker),
  iq AS (SELECT ticker, a, rev, row_number() OVER (PARTITION BY ticker ORDER BY a DESC) AS n FROM fu), tt AS (SELECT ticker, CASE WHEN count(*) = 4 THEN sum(rev) END AS ttm FROM iq WHERE n <= 4 GROUP BY ticker),
  nw AS (SELECT i.ticker, i.a - 135 AS qd, i.rev / b.rev - 1 AS yoy FROM iq i LEFT JOIN fu b ON b.ticker = i.ticker AND b.a - 135 = (i.a - 135) - INTERVAL 1 YEAR WHERE i.n = 1)
  SELECT {_LIVE_TICKER.format('s_suppkey')} AS ticker, s_name AS company, lower(r_name) AS sector, {r('price', 'price / hi - 1 AS pct_below_52w_high', 'price / lo - 1 AS pct_above_52w_low', 'CASE WHEN pe <> 0 THEN 1 / pe END AS earn_yield', 'CASE WHEN ttm <> 0 THEN fcf / ttm END AS fcf_margin', 'yoy AS sales_growth_q')},
    'Q' || quarter(qd) || ' ' || year(qd) AS last_qtr, row_number() OVER (PARTITION BY r_name ORDER BY {_LIVE_TICKER.format('s_suppkey')})::INTEGER AS n
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN lp ON lp.ticker = s_suppkey LEFT JOIN lc ON lc.ticker = s_suppkey LEFT JOIN tt ON tt.ticker = s_suppkey LEFT JOIN nw ON nw.ticker = s_suppkey""")
def live_snapshot(spark, d):
    def name(c, first):
        return F.when(F.col(c) == 1, first).otherwise(F.concat(F.lit("T"), F.col(c).cast("string")))

    s = ad.read(spark, d, "supplier").join(ad.read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(ad.read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    universe = s.select(name("s_suppkey", "GOOG").alias("ticker")).union(spark.createDataFrame([("NOPRICE",)], "ticker string"))
    companies = s.select(name("s_suppkey", "GOOGL").alias("ticker"), F.col("s_name").alias("name"), F.col("r_name").alias("industry_group_name"))
    sectors = ad.read(spark, d, "region").select(F.col("r_name").alias("group"), F.lower("r_name").alias("sector"))
    prices = _sup(spark, d).select(name("ticker", "GOOG").alias("ticker"), "date", F.col("px").alias("close"), F.col("px").alias("adj_close"), (F.col("px") + F.col("volume")).alias("high_52w"), (F.col("px") / 2).alias("low_52w"))
    q = ad.read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.to_date(F.date_trunc("quarter", "l_shipdate")).alias("q")).agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("l_quantity").cast("long")).alias("v"), (F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")) / 100.0).alias("rev"))
    q = q.withColumn("ticker", name("k", "GOOGL")).withColumn("filed", F.date_add("q", 135).cast("string"))
    calcs = q.select("ticker", F.lit("FY").alias("fiscal_period"), F.col("filed").alias("filing_date"), F.col("filed").alias("first_calculable_at"), (F.col("c") - 3).alias("PriceToEarnings"), F.col("v").alias("FreeCashFlow"))
    income = q.select("ticker", F.year("q").cast("string").alias("fiscal_year"), F.concat(F.lit("Q"), F.quarter("q")).alias("fiscal_period"), F.col("rev").alias("totalrevenue"), F.col("filed").alias("filing_date"))
    frame, _ = live.build_live(universe, companies, prices, calcs, income, sectors, bench=None, beta_n=12, vol_n=6, look=12, skip=1, min_beta=6, per_year=12)
    return frame.select("ticker", "company", "sector", "price", "pct_below_52w_high", "pct_above_52w_low", "earn_yield", "fcf_margin", "sales_growth_q", "last_qtr", "n")


# ---------------------------------------------------------------- signals and reports


@query(f"""WITH {SUP}, e AS (SELECT date, ticker, sector, volume AS roe, CASE WHEN ticker % 3 <> 0 THEN disc END AS mom, -px AS vol FROM sup WHERE px >= 900 AND month(date) % 3 = 0),
  {_z('roe', 'date, sector', 'e', 'z1')}, {_z('mom', 'date, sector', 'z1t', 'z2')}, {_z('vol', 'date, sector', 'z2t', 'z3')},
  w AS (SELECT *, CASE WHEN z2 IS NOT NULL THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN z3 IS NOT NULL THEN 0.1::DOUBLE ELSE 0 END AS b FROM z3t)
  SELECT date, ticker, {r('z1 AS sleeve_quality', 'z2 AS sleeve_momentum', 'z3 AS sleeve_lowvol', 'CASE WHEN b > 0 THEN (coalesce(z2 * 0.2::DOUBLE, 0) + coalesce(z3 * 0.1::DOUBLE, 0)) / b END AS z_composite')} FROM w""")
def signal_frame(spark, d):
    df = _sup(spark, d)
    rows = df.select("date", "ticker", "sector", F.col("volume").alias("roe"), F.when(F.col("ticker") % 3 != 0, F.col("disc")).alias("mom_12m1m"))
    proxies = df.select("ticker", "date", F.col("px").alias("vol_126d"))
    dates = df.filter("month(date) % 3 = 0").select("date").distinct()
    out = scoring.signal_frame(rows, dates, df.filter("px >= 900").select("date", "ticker"), proxies)
    return out.select("date", "ticker", "sleeve_quality", "sleeve_momentum", "sleeve_lowvol", "z_composite")


@query(f"""{_LAB}, rr AS (SELECT date, ticker, lead(px) OVER (PARTITION BY ticker ORDER BY date) / px - 1 AS y FROM sup), j AS (SELECT date, z_composite AS z, y FROM cm JOIN rr USING (date, ticker)), {_ic('j', 'z', 'y', least=2)} SELECT date, n, {r('ic')} FROM ics""")
def composite_ic(spark, d):
    return lab.composite_ic(_lab(spark, d))


@query(f"""{_LAB}, rr AS (SELECT date, ticker, cap, lead(px) OVER (PARTITION BY ticker ORDER BY date) / px - 1 AS y FROM sup), j AS (SELECT u, date, z_composite AS z, y FROM cm JOIN rr USING (date, ticker) CROSS JOIN (VALUES ('broad'), ('large')) t(u) WHERE u = 'broad' OR cap >= 200000),
  {_ic('j', 'z', 'y', 'u, date', 10)}, sm AS (SELECT u, count(ic) AS n, {_SUMMARY} FROM ics GROUP BY u)
  SELECT 'composite' AS sleeve, {r('CASE WHEN b.n >= 10 THEN b.mean END AS broad_mean', 'CASE WHEN b.n >= 10 THEN b.tstat END AS broad_tstat', 'CASE WHEN l.n >= 10 THEN l.mean END AS large_mean', 'CASE WHEN l.n >= 10 THEN l.tstat END AS large_tstat')}, b.n AS broad_n, l.n AS large_n, {r('CASE WHEN b.n >= 10 AND l.n >= 10 THEN l.mean - b.mean END AS delta')}
  FROM (SELECT * FROM sm WHERE u = 'broad') b, (SELECT * FROM sm WHERE u = 'large') l""")
def universe_comparison(spark, d):
    df = _lab(spark, d)

    def side(rows):
        return lab.ic_series(rows, "z_composite", "ret_fwd_1", least=10).filter(F.col("ic").isNotNull()).agg(*series_summary("ic")).withColumn("sleeve", F.lit("composite"))

    return lab.comparison(side(df), side(df.filter("cap >= 200000")))


@query(f"WITH {SUP} SELECT date, ticker FROM sup QUALIFY count(*) FILTER (volume > 60) OVER (PARTITION BY date) >= 50")
def dense_dates(spark, d):
    df = _sup(spark, d).withColumn("x", F.when(F.col("volume") > 60, F.col("volume")))
    return lab.dense_dates(df, "x", 50).select("date", "ticker")


@query(f"WITH {SUP} SELECT DISTINCT date FROM sup ORDER BY date DESC LIMIT 7")
def last_dates(spark, d):
    return calendar.last_dates(_sup(spark, d).select("date").distinct(), 7)


@query(f"WITH {SUP} SELECT date, ticker, sector, {r('px')} FROM sup WHERE date = (SELECT max(date) FROM sup) QUALIFY row_number() OVER (PARTITION BY sector ORDER BY px, ticker) <= 3")
def top_per_sector(spark, d):
    df = _sup(spark, d)
    return reports.top_per_group(df.join(F.broadcast(df.agg(F.max("date").alias("date"))), "date", "left_semi"), 3, rank="px").select("date", "ticker", "sector", "px")


@query(f"""{_LAB}, l AS (SELECT ticker, z1, z2, z_composite FROM cm WHERE date = (SELECT max(date) FROM cm))
  SELECT ticker, {r('z_composite')}, CASE WHEN coalesce(z1 * 0.6::DOUBLE, '-infinity'::DOUBLE) > coalesce(z2 * 0.4::DOUBLE, '-infinity'::DOUBLE) THEN 'volume' ELSE 'nd' END AS driver, ticker % 2 <> 0 AS is_new FROM l ORDER BY z_composite DESC NULLS LAST, ticker LIMIT 12""")
def shortlist(spark, d):
    df = _lab(spark, d)
    now = df.join(F.broadcast(df.agg(F.max("date").alias("date"))), "date", "left_semi").drop("z_p4")
    previous = ad.read(spark, d, "supplier").filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("ticker"))
    return reports.shortlist(now, 12, {"volume": 0.6, "nd": 0.4}, "z_composite", previous).select("ticker", "z_composite", "driver", "is_new")


# ---------------------------------------------------------------- correlation structure


@query(f"{_SP} SELECT factor_a, factor_b, {r('avg(corr) AS corr', 'abs(avg(corr)) AS abs_corr')} FROM c WHERE corr IS NOT NULL GROUP BY ALL")
def ranked_factor_pairs(spark, d):
    return correlation.ranked_pairs(correlation.plain_mean(correlation.pair_correlations(_wide(spark, d), ["volume", "nd", "p4"], "spearman", least=30)))


@query(f"""WITH {SUP}, {RET}, {_z('volume', 'date, sector', 'ret')}, {_ic('zt', 'z', 'ret_fwd_1')}, s AS (SELECT count(ic) AS n, {_SUMMARY} FROM ics) SELECT 'volume' AS factor, {r('abs(tstat) AS priority')} FROM s""")
def efficacy_priority(spark, d):
    df = _sup_returns(spark, d)
    row = lab.ic_summary(lab.ic_series(xsec.add_group_z(df, ["volume"], ["date", "sector"]), "z_volume", "ret_fwd_1")).first()
    return spark.createDataFrame(sorted(correlation.priority_from_efficacy({"volume": row.asDict(), "none": {}}).items()), "factor string, priority double")

