"""Registered queries: each library operator on the adapter panels, with its DuckDB counterpart.

Floating results are rounded on both sides, since sums in different orders differ in the last bits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import adapters as ad
from .functions import xsec
from .functions.nulls import safe_div
from .functions.stats import drawdowns, welch
from .operators import asof, calendar, clean, dedup, panel
from .plans import backtest, correlation, lab, reports, scoring

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 7


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    scale = F.lit(10.0**digits)
    return df.select(*[(F.floor(F.col(c) * scale + 0.5) / scale).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r(*names: str) -> str:
    """SQL that rounds as ``rounded`` does; "expression AS name" or a plain name."""
    out = []
    for n in names:
        expr, _, name = n.rpartition(" AS ")
        out.append(f"floor(({expr or name})::DOUBLE * 1e{DIGITS}::DOUBLE + 0.5::DOUBLE)::BIGINT / 1e{DIGITS}::DOUBLE AS {name}")
    return ", ".join(out)


def query(sql: str | None = None, name: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            ORACLES[key] = sql
        return f

    return add


def _monthly(key: str) -> str:
    return f"""
    SELECT date_trunc('month', l_shipdate)::DATE AS date, {key} AS ticker, sum(l_quantity::BIGINT)::DOUBLE AS volume,
      sum(round(l_extendedprice * 100)::BIGINT)::DOUBLE / (sum(l_quantity::BIGINT) * 100)::DOUBLE AS px,
      sum(round(l_extendedprice * 100)::BIGINT)::DOUBLE / 100.0::DOUBLE AS cap,
      sum(round(l_discount * 100)::BIGINT)::DOUBLE / (count(*) * 100)::DOUBLE AS disc
    FROM lineitem GROUP BY ALL"""


SUP = f"""sup AS (SELECT m.*, r_name AS sector FROM ({_monthly('l_suppkey')}) m JOIN supplier ON ticker = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
PRT = f"""prt AS (SELECT m.*, p_brand AS sector FROM ({_monthly('l_partkey')}) m JOIN part ON ticker = p_partkey)"""
RET = """ret AS (SELECT *, px / lag(px, 1) OVER w - 1 AS ret_1, px / lag(px, 3) OVER w - 1 AS ret_3, px / lag(px, 12) OVER w - 1 AS ret_12,
  lead(px, 1) OVER w / px - 1 AS ret_fwd_1, lead(px, 3) OVER w / px - 1 AS ret_fwd_3 FROM sup WINDOW w AS (PARTITION BY ticker ORDER BY date))"""
CAL = "cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM sup))"


def _z(x: str, by: str = "date, sector", src: str = "sup", name: str = "z") -> str:
    """CTEs clip_<name>, <name>t: winsorized z-score of x as column <name>."""
    return f"""st_{name} AS (SELECT *, avg({x}) OVER g AS m_, stddev_samp({x}) OVER g AS s_ FROM {src} WINDOW g AS (PARTITION BY {by})),
  cl_{name} AS (SELECT * EXCLUDE (m_, s_), CASE WHEN {x} IS NULL THEN NULL WHEN s_ > 0 THEN greatest(least({x}, m_ + 3.0 * s_), m_ - 3.0 * s_) ELSE {x} END AS c_ FROM st_{name}),
  {name}t AS (SELECT * EXCLUDE (c_), CASE WHEN stddev_samp(c_) OVER g > 0 THEN (c_ - avg(c_) OVER g) / stddev_samp(c_) OVER g END AS {name} FROM cl_{name} WINDOW g AS (PARTITION BY {by}))"""


def _ic(src: str, x: str, y: str, by: str = "date", least: int = 30) -> str:
    return f"""pr AS (SELECT {by}, {x} AS x, {y} AS y FROM {src} WHERE {x} IS NOT NULL AND {y} IS NOT NULL),
  rk AS (SELECT {by}, rank() OVER (PARTITION BY {by} ORDER BY x) + (count(*) OVER (PARTITION BY {by}, x) - 1) / 2.0::DOUBLE AS rx,
    rank() OVER (PARTITION BY {by} ORDER BY y) + (count(*) OVER (PARTITION BY {by}, y) - 1) / 2.0::DOUBLE AS ry FROM pr),
  ics AS (SELECT {by}, count(*) AS n, CASE WHEN count(*) >= {least} AND stddev_samp(rx) > 0 AND stddev_samp(ry) > 0 THEN covar_samp(rx, ry) / (stddev_samp(rx) * stddev_samp(ry)) END AS ic FROM rk GROUP BY {by})"""


_SUMMARY = r("avg(ic) AS mean", "stddev_samp(ic) AS std", "CASE WHEN count(ic) >= 2 AND stddev_samp(ic) > 0 THEN avg(ic) / (stddev_samp(ic) / sqrt(count(ic))) END AS tstat", "avg((ic > 0)::INTEGER) AS hit_rate")


def _sup(spark: SparkSession, d: str) -> DataFrame:
    return ad.supplier_panel(spark, d)


def _sup_returns(spark: SparkSession, d: str) -> DataFrame:
    return ad.with_returns(_sup(spark, d))


def _sup_z(spark: SparkSession, d: str) -> DataFrame:
    """z of volume (higher = better), z of discount (lower = better) and forward returns."""
    df = _sup_returns(spark, d).withColumn("nd", -F.col("disc"))
    return xsec.add_group_z(df, ["volume", "nd"], ["date", "sector"])


# ---------------------------------------------------------------- calendars


@query(f"WITH {SUP} SELECT max(date) AS date FROM sup GROUP BY date_trunc('quarter', date)")
def quarter_end_dates(spark, d):
    return _sup(spark, d).groupBy(F.trunc("date", "quarter")).agg(F.max("date").alias("date")).select("date")


@query("SELECT max(l_shipdate::DATE) AS date FROM lineitem GROUP BY date_trunc('month', l_shipdate)")
def month_end_dates(spark, d):
    return calendar.month_ends(ad.read(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct())


@query("""WITH c AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT l_shipdate::DATE AS date FROM lineitem)),
  e AS (SELECT max(date) AS date FROM c GROUP BY date_trunc('month', date))
  SELECT c.date AS month_end, n.date AS trade_date FROM e JOIN c USING (date) JOIN c n ON n.pos = c.pos + 1 WHERE c.pos + 2 <= (SELECT max(pos) FROM c)""")
def trade_calendar(spark, d):
    days = ad.read(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()
    cal = calendar.calendar(days)
    return calendar.trade_calendar(cal, calendar.month_ends(cal))


@query(f"""WITH {SUP}, {CAL}, e AS (SELECT date, pos, row_number() OVER (ORDER BY date) - 1 AS i FROM cal)
  SELECT date, pos FROM e WHERE i % 6 = 2 AND pos + 12 <= (SELECT max(pos) FROM cal)""")
def base_dates(spark, d):
    cal = calendar.calendar(_sup(spark, d))
    return calendar.base_dates(cal.select("date"), cal, ahead=12).withColumn("pos", F.col("pos").cast("long"))


# ---------------------------------------------------------------- panel and time series


@query(f"WITH {SUP} SELECT date, ticker, sector, {r('px', 'volume', 'cap', 'disc')} FROM sup")
def panel_build(spark, d):
    return _sup(spark, d)


@query(f"WITH {SUP}, {RET} SELECT date, ticker, {r('ret_1', 'ret_3', 'ret_12', 'ret_fwd_1', 'ret_fwd_3')} FROM ret")
def trailing_forward_returns(spark, d):
    return _sup_returns(spark, d).select("date", "ticker", "ret_1", "ret_3", "ret_12", "ret_fwd_1", "ret_fwd_3")


@query(f"WITH {SUP} SELECT date, ticker, {r('lag(px, 1) OVER w / lag(px, 12) OVER w - 1 AS mom')} FROM sup WINDOW w AS (PARTITION BY ticker ORDER BY date)")
def momentum_skip(spark, d):
    return _sup(spark, d).select("date", "ticker", panel.momentum("px", 1, 12).alias("mom"))


@query(f"""WITH {SUP}, {RET} SELECT date, ticker, {r('CASE WHEN count(ret_1) OVER w = 6 THEN stddev_samp(ret_1) OVER w * sqrt(12.0::DOUBLE) END AS vol')}
  FROM ret WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""")
def rolling_vol(spark, d):
    return _sup_returns(spark, d).withColumn("vol", panel.rolling_vol("ret_1", 6, 12)).select("date", "ticker", "vol")


@query(f"""WITH {SUP}, {RET}, b AS (SELECT date, avg(ret_1) AS m FROM ret GROUP BY date), j AS (SELECT ticker, date, CASE WHEN m IS NOT NULL THEN ret_1 END AS a, CASE WHEN ret_1 IS NOT NULL THEN m END AS b FROM ret LEFT JOIN b USING (date))
  SELECT date, ticker, {r('CASE WHEN count(a) OVER w = 12 AND var_samp(b) OVER w > 0 THEN covar_samp(a, b) OVER w / var_samp(b) OVER w END AS beta')}
  FROM j WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""")
def rolling_beta(spark, d):
    df = _sup_returns(spark, d)
    bench = df.groupBy("date").agg(F.avg("ret_1").alias("m"))
    return df.join(F.broadcast(bench), "date", "left").withColumn("beta", panel.rolling_beta("ret_1", "m", 12)).select("date", "ticker", "beta")


@query(f"""WITH {PRT}, s AS (SELECT ticker, date, px, ln(px / lag(px) OVER w) AS lr, px / lag(px) OVER w - 1 AS sr, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS n FROM prt WINDOW w AS (PARTITION BY ticker ORDER BY date)),
  a AS (SELECT ticker, coalesce(max(abs(lr)) FILTER (n <= 4) > 1.0, false) AS bad_v, coalesce(max(abs(lr)) FILTER (n <= 6) > 1.0, false) AS bad_m, count(sr) FILTER (n <= 4) AS nv, stddev_samp(sr) FILTER (n <= 4) AS sv, max(px) FILTER (n = 7) AS base, max(px) FILTER (n = 2) AS top FROM s GROUP BY ticker)
  SELECT ticker, {r('CASE WHEN NOT bad_v AND nv = 4 THEN sv * sqrt(12.0::DOUBLE) END AS vol', 'CASE WHEN NOT bad_m THEN top / base - 1 END AS mom')} FROM a""")
def bad_tick_quarantine(spark, d):
    return panel.live_price_stats(ad.part_panel(spark, d), None, "px", vol_n=4, look=6, skip=1, per_year=12).select("ticker", "vol", "mom")


@query(f"""WITH {SUP}, s AS (SELECT ticker, date, ln(px / lag(px) OVER w) AS lr, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS n FROM sup WINDOW w AS (PARTITION BY ticker ORDER BY date)),
  m AS (SELECT date, lr AS m FROM s WHERE ticker = 1 AND n <= 36 AND lr IS NOT NULL),
  b AS (SELECT ticker, CASE WHEN count(*) >= 12 AND var_samp(m) <> 0 THEN covar_samp(lr, m) / var_samp(m) END AS beta FROM s JOIN m USING (date) WHERE n <= 36 AND lr IS NOT NULL GROUP BY ticker),
  q AS (SELECT ticker, coalesce(max(abs(lr)) FILTER (n <= 36) > 2.0, false) AS bad FROM s GROUP BY ticker)
  SELECT ticker, {r('CASE WHEN NOT bad THEN beta END AS beta')} FROM q LEFT JOIN b USING (ticker)""")
def live_beta(spark, d):
    return panel.live_price_stats(_sup(spark, d), 1, "px", beta_n=36, min_beta=12, jump=2.0).select("ticker", "beta")


@query(f"""WITH {SUP}, {CAL}, p AS (SELECT ticker, pos, date, px FROM sup JOIN cal USING (date))
  SELECT a.ticker, a.date, h::INTEGER AS h, {r('b.px / a.px - 1 AS fwd')} FROM p a CROSS JOIN (VALUES (1), (3)) t(h) LEFT JOIN p b ON a.ticker = b.ticker AND b.pos = a.pos + h""")
def calendar_forward_returns(spark, d):
    df = _sup(spark, d)
    cal = calendar.calendar(df)
    return panel.calendar_forward_returns(df, cal, "px", (1, 3)).select("ticker", "date", "h", "fwd")


# ---------------------------------------------------------------- as-of joins, dedup, latest per key


@query(f"""WITH e AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type <> 'purchase'),
  v AS (SELECT user_id, ts, value, event_id FROM events WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) = 1)
  SELECT e.event_id, {r('CASE WHEN v.event_id % 7 <> 0 THEN v.value END AS known')} FROM e ASOF LEFT JOIN v ON e.user_id = v.user_id AND e.ts >= v.ts""")
def asof_vintage(spark, d):
    ev = ad.read(spark, d, "events")
    v = ev.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("vts"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("known"), "event_id")
    left = ev.filter("event_type <> 'purchase'").select("event_id", "user_id", "ts")
    return asof.asof_backward(left, v, "user_id", "ts", "vts", ["known"], [F.desc("event_id")]).select("event_id", "known")


@query(f"""WITH o AS (SELECT o_custkey, o_orderdate::DATE AS d, max(o_totalprice) AS rev FROM orders GROUP BY ALL),
  l AS (SELECT c_custkey, m.date FROM customer, (SELECT DISTINCT date_trunc('quarter', o_orderdate)::DATE AS date FROM orders) m)
  SELECT c_custkey, date, {r('rev')}, {r('CASE WHEN rev <> 0 THEN c_custkey / rev END AS margin')} FROM l ASOF LEFT JOIN o ON c_custkey = o_custkey AND date >= o.d""")
def asof_revenue(spark, d):
    o = ad.read(spark, d, "orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("d")).agg(F.max("o_totalprice").alias("rev"))
    dates = ad.read(spark, d, "orders").select(F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("date")).distinct()
    left = ad.read(spark, d, "customer").select("c_custkey").crossJoin(F.broadcast(dates))
    out = asof.asof_backward(left, o.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "date", "d", ["rev"])
    return out.withColumn("__key", F.col("c_custkey").cast("double")).withColumn("margin", panel.fcf_margin("__key", "rev")).select("c_custkey", "date", "rev", "margin")


@query("""WITH c AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL)
  SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem JOIN c USING (l_suppkey)
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY n DESC, l_suppkey, l_partkey, l_shipdate) = 1""")
def dedup_longest_series(spark, d):
    li = ad.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_shipdate")
    return dedup.longest_series(li, ["l_orderkey", "l_linenumber"], "l_suppkey", [F.col("l_partkey"), F.col("l_shipdate")]).select("l_orderkey", "l_linenumber", "l_suppkey")


@query(f"""SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderpriority, o_orderkey)) AS o_orderkey, {r('max_by(o_totalprice, (o_orderdate, o_orderpriority, o_orderkey)) AS o_totalprice')} FROM orders GROUP BY o_custkey""")
def latest_per_key(spark, d):
    return dedup.latest(ad.read(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderpriority", "o_orderkey"], ["o_orderkey", "o_totalprice"])


_QTR = "q AS (SELECT o_custkey % 50 AS k, year(o_orderdate)::INTEGER AS fy, quarter(o_orderdate)::INTEGER AS q, sum(round(o_totalprice * 100)::BIGINT)::DOUBLE AS x FROM orders GROUP BY ALL)"


@query(f"""WITH {_QTR}, t AS (SELECT k, CASE WHEN count(*) = 4 THEN sum(x) END AS ttm FROM (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY k ORDER BY fy DESC, q DESC) <= 4) GROUP BY k),
  n AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY k ORDER BY fy DESC, q DESC) = 1)
  SELECT k, n.fy, n.q, {r('ttm', 'n.x / b.x - 1 AS yoy')} FROM n JOIN t USING (k) LEFT JOIN q b ON b.k = n.k AND b.fy = n.fy - 1 AND b.q = n.q""")
def ttm_sum_and_yoy(spark, d):
    o = ad.read(spark, d, "orders")
    q = o.groupBy((F.col("o_custkey") % 50).alias("k"), F.year("o_orderdate").alias("fy"), F.quarter("o_orderdate").alias("q")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).cast("double").alias("x"))
    return dedup.trailing_sum(q, ["k"], ["fy", "q"], "x").join(dedup.year_over_year(q, ["k"], "fy", "q", "x"), "k").select("k", "fy", "q", "ttm", "yoy")


@query(f"""WITH {SUP}, k AS (SELECT *, coalesce(CASE WHEN volume - 150 > 0 THEN volume - 150 END, CASE WHEN cap > 0 THEN cap / 1000 END) AS key FROM sup)
  SELECT date, ticker FROM k WHERE key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY date ORDER BY key DESC, ticker) <= 10""")
def topn_per_date(spark, d):
    df = _sup(spark, d).withColumn("ev", F.col("volume") - 150).withColumn("mc", F.col("cap") / 1000)
    return dedup.top_n(df, ["date"], dedup.size_key("ev", "mc"), 10, "ticker").select("date", "ticker")


# ---------------------------------------------------------------- cleaning


_RAW = """raw AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN 'not-a-date' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS "DATE",
  CASE WHEN o_orderkey % 13 = 0 THEN ' ' ELSE ' T' || o_custkey END AS "TICKER", CASE WHEN o_orderkey % 17 = 0 THEN '0' WHEN o_orderkey % 19 = 0 THEN 'x' ELSE '5.5' END AS "ADJ_CLOSE" FROM orders)"""


def _raw_prices(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return ad.read(spark, d, "orders").select(
        k.alias("k"), F.when(k % 11 == 0, "not-a-date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("DATE"),
        F.when(k % 13 == 0, " ").otherwise(F.concat(F.lit(" T"), F.col("o_custkey").cast("string"))).alias("TICKER"), F.when(k % 17 == 0, "0").when(k % 19 == 0, "x").otherwise("5.5").alias("ADJ_CLOSE"),
    )


@query(f"""WITH {_RAW}, c AS (SELECT k, try_cast("DATE" AS DATE) AS date, nullif(trim("TICKER"), '') AS ticker, try_cast("ADJ_CLOSE" AS DOUBLE) AS adj_close FROM raw)
  SELECT k, date, ticker, {r('adj_close')}, CASE WHEN date IS NULL THEN 'bad_date' WHEN ticker IS NULL THEN 'missing_ticker' WHEN adj_close IS NULL OR adj_close <= 0 THEN 'bad_adj_close' END AS quarantine_reason FROM c""")
def quarantine_clean(spark, d):
    return clean.clean_prices(_raw_prices(spark, d)).select("k", "date", "ticker", "adj_close", "quarantine_reason")


@query(f"""WITH {_RAW}, c AS (SELECT CASE WHEN try_cast("DATE" AS DATE) IS NULL THEN 'bad_date' WHEN trim("TICKER") = '' THEN 'missing_ticker' WHEN coalesce(try_cast("ADJ_CLOSE" AS DOUBLE), 0) <= 0 THEN 'bad_adj_close' ELSE 'ok' END AS reason FROM raw)
  SELECT CASE WHEN reason = 'ok' THEN 'rows_out' ELSE reason END AS reason, count(*) AS n FROM c GROUP BY ALL UNION ALL SELECT 'rows_in', count(*) FROM c""")
def load_report(spark, d):
    raw = _raw_prices(spark, d)
    report = clean.load_report(raw, clean.clean_prices(raw))
    return spark.createDataFrame(sorted(report.items()), "reason string, n bigint")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN o_orderdate::DATE + 3 WHEN o_orderkey % 3 = 0 THEN o_orderdate::DATE ELSE o_orderdate::DATE + 3 END AS available,
  CASE WHEN o_orderstatus = 'F' THEN 'FY' WHEN o_orderstatus = 'O' THEN 'Q1TTM' ELSE 'Q1' END AS period FROM orders WHERE o_orderstatus IN ('F', 'O')""")
def pit_available_date(spark, d):
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    raw = ad.read(spark, d, "orders").select("o_orderkey", F.when(k % 5 != 0, day.cast("string")).alias("filing_date"), F.when(k % 3 != 0, F.concat(F.date_add(day, 3).cast("string"), F.lit(" 10:00:00"))).alias("first_calculable_at"), F.when(F.col("o_orderstatus") == "F", "FY").when(F.col("o_orderstatus") == "O", "Q1TTM").otherwise("Q1").alias("fiscal_period"))
    return clean.clean_vintages(raw).select("o_orderkey", F.col("available_date").alias("available"), F.col("fiscal_period").alias("period"))


@query("""SELECT p_partkey, coalesce(nullif(regexp_replace(regexp_replace(lower(trim(p_type)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'unknown') AS slug,
  regexp_matches(p_brand || CASE WHEN p_partkey % 4 = 0 THEN '.B' ELSE '' END, '[.\\-]') AS has_suffix, CASE WHEN p_partkey % 3 = 0 THEN 'GOOGL' ELSE replace(p_brand, '#', '-') END AS bulk FROM part""")
def slug_suffix_strings(spark, d):
    k = F.col("p_partkey")
    p = ad.read(spark, d, "part").select("p_partkey", "p_type", F.concat("p_brand", F.when(k % 4 == 0, ".B").otherwise("")).alias("ticker"), F.when(k % 3 == 0, F.lit("GOOG")).otherwise(F.replace("p_brand", F.lit("#"), F.lit("."))).alias("t"))
    return p.select("p_partkey", clean.slug("p_type").alias("slug"), panel.has_suffix().alias("has_suffix"), clean.bulk_ticker("t").alias("bulk"))


@query("""WITH v AS (SELECT p_partkey AS ticker, p_retailprice AS price, p_size * 10.0::DOUBLE AS pe_ratio, p_retailprice - 5 AS low_52w, CASE WHEN p_partkey % 9 = 0 THEN p_retailprice - 1 ELSE p_retailprice + 5 END AS high_52w, p_size / 10.0::DOUBLE - 2 AS trailing_beta FROM part)
  SELECT ticker, 'pe_ratio' AS field, floor(pe_ratio * 1e7::DOUBLE + 0.5::DOUBLE)::BIGINT / 1e7::DOUBLE AS value, 'P/E > 200' AS reason FROM v WHERE pe_ratio > 200
  UNION ALL SELECT ticker, 'trailing_beta', floor(trailing_beta * 1e7::DOUBLE + 0.5::DOUBLE)::BIGINT / 1e7::DOUBLE, '|beta| > 3' FROM v WHERE abs(trailing_beta) > 3
  UNION ALL SELECT ticker, 'price', floor(price * 1e7::DOUBLE + 0.5::DOUBLE)::BIGINT / 1e7::DOUBLE, 'outside 52-week range' FROM v WHERE price < low_52w OR price > high_52w""")
def validate_flags(spark, d):
    k, p = F.col("p_partkey"), F.col("p_retailprice")
    v = ad.read(spark, d, "part").select(k.alias("ticker"), p.alias("price"), (F.col("p_size") * 10.0).alias("pe_ratio"), (p - 5).alias("low_52w"), F.when(k % 9 == 0, p - 1).otherwise(p + 5).alias("high_52w"), (F.col("p_size") / 10.0 - 2).alias("trailing_beta"))
    return clean.suspicious(v)


@query(f"""WITH {PRT} SELECT factor, {r('c AS coverage')} FROM (SELECT avg((CASE WHEN ticker % 7 <> 0 THEN px END IS NOT NULL)::INTEGER) AS px, avg((CASE WHEN volume > 20 THEN volume END IS NOT NULL)::INTEGER) AS volume FROM prt) UNPIVOT (c FOR factor IN (px, volume))""")
def coverage_counts(spark, d):
    df = ad.part_panel(spark, d).select(F.when(F.col("ticker") % 7 != 0, F.col("px")).alias("px"), F.when(F.col("volume") > 20, F.col("volume")).alias("volume"))
    return clean.coverage(df, ["px", "volume"])


@query("""WITH m AS (SELECT 0 AS i, 'SP500' AS name, c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 1, 'NASDAQ100', c_custkey FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 2, 'DOW', c_custkey FROM customer WHERE c_acctbal > 5000)
  SELECT c_custkey, string_agg(name, '|' ORDER BY i) AS index_membership FROM m GROUP BY c_custkey""")
def index_membership(spark, d):
    c = ad.read(spark, d, "customer")
    return clean.membership([("SP500", c.filter("c_mktsegment = 'BUILDING'")), ("NASDAQ100", c.filter("c_custkey % 3 = 0")), ("DOW", c.filter("c_acctbal > 5000"))], "c_custkey")


@query("""SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1998 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1997)""")
def new_vs_previous(spark, d):
    o = ad.read(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("y"))
    return reports.newcomers(o.filter("y = 1998"), o.filter("y = 1997"), "o_custkey")


@query(f"WITH {SUP} SELECT date, ticker, {r('CASE WHEN px >= 900 THEN volume END AS z')} FROM sup")
def price_floor(spark, d):
    return _sup(spark, d).select("date", "ticker", clean.price_floor("volume", "px", 900.0).alias("z"))


# ---------------------------------------------------------------- cross-section and scoring


@query(f"WITH {SUP}, {_z('volume')} SELECT date, ticker, {r('z')} FROM zt")
def group_zscore(spark, d):
    return xsec.add_group_z(_sup(spark, d), ["volume"], ["date", "sector"]).select("date", "ticker", F.col("z_volume").alias("z"))


@query(f"""WITH {SUP}, s AS (SELECT *, avg(px) OVER g AS m, stddev_samp(px) OVER g AS s FROM sup WINDOW g AS (PARTITION BY date)) SELECT date, ticker, {r('CASE WHEN s > 0 THEN greatest(least(px, m + 1.5 * s), m - 1.5 * s) ELSE px END AS px')} FROM s""")
def winsorize_sigma(spark, d):
    return _sup(spark, d).select("date", "ticker", xsec.winsorize_sigma(F.col("px"), ["date"], 1.5).alias("px"))


@query(f"""WITH {SUP}, e AS (SELECT date, quantile_cont(px, [0.01, 0.99]) AS p FROM sup GROUP BY date) SELECT date, ticker, {r('greatest(least(px, p[2]), p[1]) AS px')} FROM sup JOIN e USING (date)""")
def pct_winsor_by_date(spark, d):
    return xsec.winsorize_percentiles(_sup(spark, d), "px", ["date"]).select("date", "ticker", "px")


def _labels_sql(src: str, x: str, by: str, least: int, n: int = 5, all_bins: bool = False) -> str:
    """CTEs ed, lb: label q of x per group."""
    points = ", ".join(f"{i / n}" for i in range(n + 1))
    return f"""ed AS (SELECT {by}, list_sort(list_distinct(quantile_cont({x}, [{points}]))) AS e, count({x}) AS n_, count(DISTINCT {x}) AS d_ FROM {src} GROUP BY {by}),
  lb AS (SELECT s.*, CASE WHEN {x} IS NOT NULL AND n_ >= {least} AND d_ >= {n} {f'AND len(e) = {n + 1}' if all_bins else ''} THEN (1 + len(list_filter(e[2:-2], lambda v: v < {x})))::INTEGER END AS q FROM {src} s LEFT JOIN ed USING ({by}))"""


@query(f"WITH {SUP}, t AS (SELECT date, ticker, floor(volume / 20) AS x FROM sup), {_labels_sql('t', 'x', 'date', 5)} SELECT date, ticker, q FROM lb")
def qcut_labels(spark, d):
    df = _sup(spark, d).select("date", "ticker", F.floor(F.col("volume") / 20).cast("double").alias("x"))
    return xsec.quantile_labels(df, "x", ["date"]).select("date", "ticker", "q")


@query(f"""WITH {SUP} SELECT date, ticker, {r("rank() OVER w + (count(*) OVER (PARTITION BY date, volume) - 1) / 2.0::DOUBLE AS average")}, rank() OVER (PARTITION BY date ORDER BY volume DESC)::INTEGER AS least, row_number() OVER (PARTITION BY date ORDER BY volume DESC, ticker)::INTEGER AS first FROM sup WINDOW w AS (PARTITION BY date ORDER BY volume)""")
def ranks(spark, d):
    return _sup(spark, d).select("date", "ticker", xsec.average_rank("volume", ["date"]).alias("average"), xsec.least_rank("volume", ["date"]).alias("least"), xsec.first_rank("volume", ["date"], "ticker").alias("first"))


@query(f"""WITH {PRT}, s AS (SELECT date, ticker, sector, CASE WHEN ticker % 5 <> 0 THEN px END AS px FROM prt) SELECT date, ticker, {r('coalesce(px, median(px) OVER (PARTITION BY sector)) AS px')} FROM s""")
def sector_median_impute(spark, d):
    df = ad.part_panel(spark, d).withColumn("px", F.when(F.col("ticker") % 5 != 0, F.col("px")))
    return xsec.with_group_median(df, "px", ["sector"]).select("date", "ticker", "px")


@query(f"""WITH {SUP} SELECT date, ticker, {r('-(CASE WHEN volume - 100 > 0 THEN volume - 100 END) AS pe', 'disc AS roe')} FROM sup""")
def orient_quarantine(spark, d):
    df = _sup(spark, d).select("date", "ticker", (F.col("volume") - 100).alias("pe"), F.col("disc").alias("roe"))
    return df.select("date", "ticker", scoring.oriented("pe").alias("pe"), scoring.oriented("roe").alias("roe"))


def _snapshot(spark: SparkSession, d: str) -> DataFrame:
    k, p, s = F.col("p_partkey"), F.col("p_retailprice"), F.col("p_size").cast("double")
    return ad.read(spark, d, "part").select(
        k.alias("ticker"), F.col("p_brand").alias("sector"), F.when(k % 6 != 0, (s - 10) / 100).alias("earn_yield"), F.when(k % 5 != 0, s - 3).alias("ps_ratio"), (p / 100 - 10).alias("pb_ratio"),
        F.when(k % 4 != 0, s / 50).alias("roe"), F.when(k % 3 != 0, p / 1000).alias("debt_to_equity"), F.when(k % 8 != 0, F.sin(k.cast("double"))).alias("mom_12_1"), (p - 1000).alias("enterprise_value"), F.lit(None).cast("double").alias("rev_growth"), F.when(k % 2 == 0, s).alias("sales_growth_q"), (s / 25).alias("vol_126d"),
    )


_SNAP = """sn AS (SELECT p_partkey AS ticker, p_brand AS sector, CASE WHEN p_partkey % 6 <> 0 THEN (p_size - 10)::DOUBLE / 100 END AS earn_yield, CASE WHEN p_partkey % 5 <> 0 THEN (p_size - 3)::DOUBLE END AS ps, p_retailprice / 100 - 10 AS pb,
  CASE WHEN p_partkey % 4 <> 0 THEN p_size::DOUBLE / 50 END AS roe, CASE WHEN p_partkey % 3 <> 0 THEN p_retailprice / 1000 END AS de, CASE WHEN p_partkey % 8 <> 0 THEN sin(p_partkey::DOUBLE) END AS mom, p_retailprice - 1000 AS ev, CASE WHEN p_partkey % 2 = 0 THEN p_size::DOUBLE END AS sg, p_size::DOUBLE / 25 AS vol FROM part),
  i1 AS (SELECT *, CASE WHEN ps > 0 THEN 1 / ps END AS ips, CASE WHEN pb > 0 THEN 1 / pb END AS ipb, -de AS nde FROM sn),
  i2 AS (SELECT ticker, sector, coalesce(earn_yield, median(earn_yield) OVER g) AS v1, coalesce(ips, median(ips) OVER g) AS v2, coalesce(ipb, median(ipb) OVER g) AS v3, coalesce(roe, median(roe) OVER g) AS q1, coalesce(nde, median(nde) OVER g) AS q2, mom, CASE WHEN ev > 0 THEN ln(ev) END AS size, coalesce(sg, median(sg) OVER g) AS growth, -vol AS lowvol FROM i1 WINDOW g AS (PARTITION BY sector)),
  fs AS (SELECT ticker, sector, list_avg(list_filter([v1, v2, v3], lambda x: x IS NOT NULL)) AS value, list_avg(list_filter([q1, q2], lambda x: x IS NOT NULL)) AS quality, growth, mom AS momentum, lowvol, size FROM i2)"""


@query(f"WITH {_SNAP} SELECT ticker, {r('value', 'quality', 'growth', 'momentum', 'lowvol', 'size')} FROM fs")
def factor_scores(spark, d):
    df = _snapshot(spark, d)
    return scoring.add_scores(df).select("ticker", *scoring.FACTORS)


@query(f"""WITH {_SNAP}, {_z('value', 'sector', 'fs', 'z1')}, {_z('momentum', 'sector', 'z1t', 'z2')}, {_z('lowvol', 'sector', 'z2t', 'z3')},
  c AS (SELECT ticker, sector, coalesce(z1, 0) * (0.2 / 0.5)::DOUBLE + coalesce(z2, 0) * (0.2 / 0.5)::DOUBLE + coalesce(z3, 0) * (0.1 / 0.5)::DOUBLE AS composite FROM z3t)
  SELECT ticker, {r('composite')}, rank() OVER (PARTITION BY sector ORDER BY round(composite, 9) DESC)::INTEGER AS rank FROM c""")
def live_composite(spark, d):
    df = _snapshot(spark, d)
    df = scoring.add_scores(df).select("ticker", "sector", *scoring.FACTORS)
    out = scoring.snapshot_composite(df, {"value": 0.2, "momentum": 0.2, "lowvol": 0.1, "absent": 0.3})
    return out.select("ticker", "composite", "rank")


_LAB = f"""WITH {SUP}, b AS (SELECT *, -disc AS nd, CASE WHEN ticker % 4 <> 0 THEN px END AS p4 FROM sup), {_z('volume', 'date, sector', 'b', 'z1')}, {_z('nd', 'date, sector', 'z1t', 'z2')}, {_z('p4', 'date, sector', 'z2t', 'z3')},
  sl AS (SELECT date, ticker, z1, z2, z3, list_avg(list_filter([z1, z2], lambda x: x IS NOT NULL)) AS a, z3 AS b FROM z3t),
  cm AS (SELECT *, CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN (coalesce(a * 0.6, 0) + coalesce(b * 0.4, 0)) / (CASE WHEN a IS NOT NULL THEN 0.6::DOUBLE ELSE 0 END + CASE WHEN b IS NOT NULL THEN 0.4::DOUBLE ELSE 0 END) END AS z_composite FROM sl)"""


def _lab(spark: SparkSession, d: str) -> DataFrame:
    df = _sup_returns(spark, d).withColumn("nd", -F.col("disc")).withColumn("p4", F.when(F.col("ticker") % 4 != 0, F.col("px")))
    df = xsec.add_group_z(df, ["volume", "nd", "p4"], ["date", "sector"])
    return scoring.panel_composite(df, {"a": ["volume", "nd"], "b": ["p4"], "c": ["none"]}, {"a": 0.6, "b": 0.4, "c": 0.0})


@query(f"{_LAB} SELECT date, ticker, {r('a AS sleeve_a', 'b AS sleeve_b', 'z_composite')} FROM cm")
def lab_composite(spark, d):
    return _lab(spark, d).select("date", "ticker", "sleeve_a", "sleeve_b", "z_composite")


@query(f"""{_LAB}, l AS (SELECT max(date) AS d FROM cm) SELECT ticker, factor, {r('z')} FROM (SELECT ticker, z1 AS volume, z2 AS nd, z3 AS p4 FROM cm, l WHERE date = d) UNPIVOT INCLUDE NULLS (z FOR factor IN (volume, nd, p4))""")
def attribution_unpivot(spark, d):
    df = _lab(spark, d)
    last = df.agg(F.max("date").alias("date"))
    return scoring.attributions(df.join(F.broadcast(last), "date", "left_semi"), {"z_volume": "volume", "z_nd": "nd", "z_p4": "p4"})


_U = "(('0x' || substr(h, {i}, 8))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4294967296.0::DOUBLE"


@query(f"""WITH {SUP}, h AS (SELECT date, ticker, sha256('{scoring.NOISE_SALT}|' || date::VARCHAR || '|' || ticker::VARCHAR) AS h FROM sup)
  SELECT date, ticker, {r(f"sqrt(-2.0::DOUBLE * ln({_U.format(i=1)})) * cos(6.283185307179586::DOUBLE * {_U.format(i=9)}) AS noise")} FROM h""")
def noise_control(spark, d):
    return _sup(spark, d).select("date", "ticker", scoring.noise().alias("noise"))


@query()
def noise_sequence(spark, d):
    return scoring.noise_sequence(_sup(spark, d).select("date", "ticker"))


# ---------------------------------------------------------------- lab


@query(f"WITH {SUP}, {RET}, {_z('volume', 'date, sector', 'ret')}, {_ic('zt', 'z', 'ret_fwd_1')} SELECT date, n, {r('ic')} FROM ics")
def rank_ic_series(spark, d):
    return lab.ic_series(_sup_z(spark, d), "z_volume", "ret_fwd_1")


@query(f"WITH {SUP}, {RET}, {_z('volume', 'date, sector', 'ret')}, {_ic('zt', 'z', 'ret_fwd_1')} SELECT count(ic) AS n, {_SUMMARY} FROM ics")
def ic_summary(spark, d):
    return lab.ic_summary(lab.ic_series(_sup_z(spark, d), "z_volume", "ret_fwd_1"))


_QR = f"""WITH {SUP}, {RET}, {_z('volume', 'date, sector', 'ret')}, w AS (SELECT date, quantile_cont(ret_fwd_1, [0.01, 0.99]) AS p FROM zt GROUP BY date),
  cl AS (SELECT date, z, CASE WHEN ret_fwd_1 IS NOT NULL THEN greatest(least(ret_fwd_1, p[2]), p[1]) END AS y, ret_fwd_1 FROM zt LEFT JOIN w USING (date)), {_labels_sql('cl', 'z', 'date', 50, 5, True)},
  qr AS (SELECT date, {', '.join(f'avg(y) FILTER (q = {i}) AS q{i}' for i in range(1, 6))} FROM lb WHERE q IS NOT NULL AND ret_fwd_1 IS NOT NULL GROUP BY date HAVING count(*) >= 50 AND count(DISTINCT q) = 5),
  sp AS (SELECT *, q5 - q1 AS spread FROM qr)"""


@query(f"{_QR} SELECT date, {r('q1', 'q2', 'q3', 'q4', 'q5', 'spread')} FROM sp")
def quintile_returns(spark, d):
    return lab.quantile_returns(_sup_z(spark, d), "z_volume", "ret_fwd_1")


@query(f"{_QR} SELECT count(*) AS n, {_SUMMARY.replace('ic', 'spread')}, {r('avg(q1) AS q1_mean', 'avg(q5) AS q5_mean', 'sum(spread) AS cumulative')} FROM sp")
def spread_summary(spark, d):
    return lab.spread_summary(lab.quantile_returns(_sup_z(spark, d), "z_volume", "ret_fwd_1"))


@query(f"{_QR} SELECT year(date)::INTEGER AS year, {r('avg(spread) AS mean_spread')}, count(*) AS n FROM sp GROUP BY year(date)")
def annual_spreads(spark, d):
    return lab.annual_spreads(lab.quantile_returns(_sup_z(spark, d), "z_volume", "ret_fwd_1"))


_DECAY = f"""WITH {SUP}, {CAL}, rk AS (SELECT ticker, pos, rank() OVER (PARTITION BY date ORDER BY volume) + (count(*) OVER (PARTITION BY date, volume) - 1) / 2.0::DOUBLE AS r FROM sup JOIN cal USING (date)),
  bs AS (SELECT pos FROM cal WHERE pos % 6 = 2 AND pos + 12 <= (SELECT max(pos) FROM cal)),
  pr AS (SELECT lag, a.pos AS base, CASE WHEN count(*) >= 30 AND stddev_samp(a.r) > 0 AND stddev_samp(b.r) > 0 THEN covar_samp(a.r, b.r) / (stddev_samp(a.r) * stddev_samp(b.r)) END AS c
    FROM rk a JOIN bs ON a.pos = bs.pos CROSS JOIN (VALUES (1), (3), (6), (12)) t(lag) JOIN rk b ON b.ticker = a.ticker AND b.pos = a.pos + lag GROUP BY ALL)"""


@query(f"{_DECAY} SELECT lag::INTEGER AS lag, {r('avg(c) AS autocorr')}, count(c) AS n FROM pr GROUP BY lag")
def decay_curve(spark, d):
    df = _sup(spark, d)
    cal = calendar.calendar(df)
    return lab.decay_curve(df, "volume", cal, calendar.base_dates(cal.select("date"), cal, ahead=12), (1, 3, 6, 12))


_HORIZONS = f"""WITH {SUP}, {CAL}, {_z('volume', 'date, sector', 'sup')}, fw AS (SELECT z.date, z.ticker, h, z.z, b.px / z.px - 1 AS y FROM (SELECT * FROM zt JOIN cal USING (date)) z CROSS JOIN (VALUES (1), (3), (6)) t(h) JOIN (SELECT * FROM sup JOIN cal USING (date)) b ON b.ticker = z.ticker AND b.pos = z.pos + h),
  {_ic('fw', 'z', 'y', 'h, date')}"""


@query(f"{_HORIZONS} SELECT 'z_volume' AS factor, h::INTEGER AS h, count(ic) AS n, {_SUMMARY} FROM ics GROUP BY h")
def ic_horizons(spark, d):
    df = _sup_z(spark, d)
    fwd = panel.calendar_forward_returns(df, calendar.calendar(df), "px", (1, 3, 6))
    return lab.ic_at_horizons(df.select("date", "ticker", "z_volume"), fwd, ["z_volume"])


@query(f"""WITH p AS (SELECT 'decay' AS curve, lag AS x, v FROM ({_DECAY} SELECT lag, avg(c) AS v FROM pr GROUP BY lag) WHERE v IS NOT NULL
    UNION ALL SELECT 'ic', h, v FROM ({_HORIZONS} SELECT h, avg(ic) AS v FROM ics GROUP BY h) WHERE v IS NOT NULL),
  q AS (SELECT *, first_value(v) OVER w AS v0, lag(x) OVER w AS xa, lag(v) OVER w AS va FROM p WINDOW w AS (PARTITION BY curve ORDER BY x)),
  l AS (SELECT *, CASE curve WHEN 'decay' THEN 0.5::DOUBLE ELSE v0 / 2 END AS level FROM q),
  s AS (SELECT curve, any_value(v0) AS v0, min(x)::DOUBLE AS x0, max(x)::DOUBLE AS x1, min_by(xa + (va - level) / (va - v) * (x - xa), x) FILTER (v <= level AND level <= va AND va <> v) AS days FROM l GROUP BY curve),
  h AS (SELECT c.curve, s.* EXCLUDE (curve), CASE WHEN v0 IS NULL THEN 'no-data' WHEN c.curve = 'ic' AND v0 <= 0 THEN 'nonpositive-base-ic' WHEN c.curve = 'decay' AND v0 < 0.5::DOUBLE THEN 'below-threshold-at-first-lag'
    WHEN days IS NULL THEN CASE c.curve WHEN 'decay' THEN 'above-0.5-at-max-lag' ELSE 'above-half-at-max-horizon' END END AS censored FROM (VALUES ('decay'), ('ic')) c(curve) LEFT JOIN s ON s.curve = c.curve)
  SELECT curve, censored, {r("CASE WHEN censored IN ('no-data', 'nonpositive-base-ic') THEN NULL WHEN censored LIKE 'below%' THEN x0 ELSE coalesce(days, x1) END AS days")} FROM h""")
def half_life(spark, d):
    curve = {x["lag"]: x["autocorr"] for x in decay_curve(spark, d).collect()}
    df = _sup_z(spark, d)
    ics = {x["h"]: x["mean"] for x in ic_horizons(spark, d).collect()}
    a, b = lab.half_life(curve), lab.ic_half_life(ics, (1, 3, 6))
    return df.sparkSession.createDataFrame([("decay", a["days"], a["censored"]), ("ic", b["days"], b["censored"])], "curve string, days double, censored string")


_RG = f"""b AS (SELECT date, avg(px) AS p FROM sup GROUP BY date), b1 AS (SELECT *, row_number() OVER (ORDER BY date) - 1 AS i, p / lag(p) OVER (ORDER BY date) - 1 AS r, p / lag(p, 3) OVER (ORDER BY date) - 1 AS tr FROM b),
  b2 AS (SELECT date, i, tr, stddev_samp(r) OVER (ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS v FROM b1), b3 AS (SELECT * FROM b2 WHERE i >= 6),
  rg AS (SELECT date, tr AS trail_ret, v AS vol, tr > 0 AS mkt_up, v > (SELECT median(v) FROM b3) AS high_vol FROM b3)"""


def _regimes(spark: SparkSession, d: str) -> DataFrame:
    b = _sup(spark, d).groupBy("date").agg(F.avg("px").alias("p"))
    return lab.regimes(b, b, "p", look=3, vol=6)


@query(f"WITH {SUP}, {_RG} SELECT date, {r('trail_ret', 'vol')}, mkt_up, high_vol FROM rg")
def regimes(spark, d):
    return _regimes(spark, d)


def _t(x: str) -> str:
    return f"CASE WHEN count({x}) >= 2 AND stddev_samp({x}) > 0 THEN avg({x}) / (stddev_samp({x}) / sqrt(count({x}))) END"


@query(f"""WITH {SUP}, {RET}, {_z('volume', 'date, sector', 'ret')}, {_ic('zt', 'z', 'ret_fwd_1')}, {_RG}, j AS (SELECT CASE WHEN mkt_up THEN ic END AS a, CASE WHEN NOT mkt_up THEN ic END AS b FROM ics JOIN rg USING (date))
  SELECT count(a) AS n_true, {r('avg(a) AS mean_true', _t('a') + ' AS t_true')}, count(b) AS n_false, {r('avg(b) AS mean_false', _t('b') + ' AS t_false', 'CASE WHEN count(a) > 1 AND count(b) > 1 THEN (avg(a) - avg(b)) / sqrt(var_samp(a) / count(a) + var_samp(b) / count(b)) END AS diff_tstat')} FROM j""")
def ic_by_regime(spark, d):
    ics = lab.ic_series(_sup_z(spark, d), "z_volume", "ret_fwd_1")
    return welch(ics.join(F.broadcast(_regimes(spark, d)), "date"), "ic", "mkt_up")


@query(f"""{_QR}, {_RG} SELECT flag, state, count(*) AS n, {r('avg(spread) * 12 AS ann_mean')} FROM (SELECT spread, mkt_up, high_vol FROM sp JOIN rg USING (date)) UNPIVOT (state FOR flag IN (mkt_up, high_vol)) GROUP BY ALL""")
def regime_spread(spark, d):
    return lab.by_regime(lab.quantile_returns(_sup_z(spark, d), "z_volume", "ret_fwd_1"), _regimes(spark, d), "spread")


@query(f"""{_LAB}, rr AS (SELECT date, ticker, lead(px) OVER (PARTITION BY ticker ORDER BY date) / px - 1 AS y FROM sup), lg AS (SELECT 'a' AS sleeve, date, a AS z, y FROM cm JOIN rr USING (date, ticker) UNION ALL SELECT 'b', date, b, y FROM cm JOIN rr USING (date, ticker)),
  {_ic('lg', 'z', 'y', 'sleeve, date')}, cv AS (SELECT sleeve, avg((z IS NOT NULL)::INTEGER) AS coverage FROM lg GROUP BY sleeve)
  SELECT sleeve, count(ic) AS n, {_SUMMARY}, {r('any_value(coverage) AS coverage')} FROM ics JOIN cv USING (sleeve) GROUP BY sleeve""")
def factor_comparison(spark, d):
    return lab.panel_sleeve_stats(_lab(spark, d), {"a": ["volume", "nd"], "b": ["p4"]}, "ret_fwd_1")


_COLS = {"nd": "z2", "p4": "z3", "volume": "z1"}
_PAIRS = [("nd", "p4"), ("nd", "volume"), ("p4", "volume")]
_CORR = "CASE WHEN count(*) >= 30 AND stddev_samp(x) > 0 AND stddev_samp(y) > 0 THEN covar_samp(x, y) / (stddev_samp(x) * stddev_samp(y)) END"
_LONG = "pl AS (" + " UNION ALL ".join(f"SELECT date, '{a}' AS factor_a, '{b}' AS factor_b, {_COLS[a]} AS x, {_COLS[b]} AS y FROM cm WHERE {_COLS[a]} IS NOT NULL AND {_COLS[b]} IS NOT NULL" for a, b in _PAIRS) + ")"


def _wide(spark: SparkSession, d: str) -> DataFrame:
    return _lab(spark, d).select("date", F.col("z_volume").alias("volume"), F.col("z_nd").alias("nd"), F.col("z_p4").alias("p4"))


@query(f"{_LAB}, {_LONG}, c AS (SELECT date, factor_a, factor_b, {_CORR} AS corr FROM pl GROUP BY ALL) SELECT date, factor_a, factor_b, {r('corr')} FROM c WHERE corr IS NOT NULL")
def pairwise_corr_pearson(spark, d):
    return correlation.pair_correlations(_wide(spark, d), ["volume", "nd", "p4"], least=30)


_SP = f"""{_LAB}, {_LONG}, rk AS (SELECT date, factor_a, factor_b, rank() OVER (PARTITION BY date, factor_a, factor_b ORDER BY x) + (count(*) OVER (PARTITION BY date, factor_a, factor_b, x) - 1) / 2.0::DOUBLE AS x,
  rank() OVER (PARTITION BY date, factor_a, factor_b ORDER BY y) + (count(*) OVER (PARTITION BY date, factor_a, factor_b, y) - 1) / 2.0::DOUBLE AS y FROM pl), c AS (SELECT date, factor_a, factor_b, {_CORR} AS corr FROM rk GROUP BY ALL)"""


@query(f"{_SP} SELECT date, factor_a, factor_b, {r('corr')} FROM c WHERE corr IS NOT NULL")
def pairwise_corr_spearman(spark, d):
    return correlation.pair_correlations(_wide(spark, d), ["volume", "nd", "p4"], "spearman", least=30)


@query(f"{_SP} SELECT factor_a, factor_b, {r('tanh(avg(atanh(greatest(least(corr, 0.9999999), -0.9999999)))) AS corr')} FROM c WHERE corr IS NOT NULL GROUP BY ALL")
def fisher_mean_corr(spark, d):
    return correlation.fisher_mean(correlation.pair_correlations(_wide(spark, d), ["volume", "nd", "p4"], "spearman", least=30))


def _matrix(spark: SparkSession, d: str):
    c = correlation.fisher_mean(correlation.pair_correlations(_wide(spark, d), ["volume", "nd", "p4"], "spearman", least=30))
    return correlation.matrix(c, ["volume", "nd", "p4"])


_FISHER = f"fi AS ({_SP} SELECT factor_a, factor_b, tanh(avg(atanh(greatest(least(corr, 0.9999999), -0.9999999)))) AS corr FROM c WHERE corr IS NOT NULL GROUP BY ALL)"


# The eigenvalues of a 3 x 3 correlation matrix in closed form.
@query(f"""WITH {_FISHER}, m AS (SELECT sum(corr * corr) AS q, product(corr) AS d FROM fi), a AS (SELECT sqrt(q / 3) AS s, acos(greatest(least(d * 3 * sqrt(3::DOUBLE) / (q * sqrt(q)), 1), -1)) / 3 AS t FROM m),
  e AS (SELECT pc, 1 + 2 * s * cos(t - turn * 2 * pi() / 3) AS eigenvalue FROM a CROSS JOIN (VALUES (1, 0), (2, 1), (3, -1)) v(pc, turn))
  SELECT pc, {r('eigenvalue', 'eigenvalue / 3 AS explained', 'sum(eigenvalue) OVER (ORDER BY pc) / 3 AS cumulative')} FROM e""")
def pca(spark, d):
    _, m = _matrix(spark, d)
    out = correlation.pca(m)
    return spark.createDataFrame([(i + 1, float(out["eigenvalues"][i]), float(out["explained"][i]), float(out["cumulative"][i])) for i in range(len(m))], "pc int, eigenvalue double, explained double, cumulative double")


# Three factors: two edges or more join all, one edge its two.
@query(f"""WITH {_FISHER}, e AS (SELECT * FROM fi WHERE abs(corr) >= 0.01::DOUBLE), g AS (SELECT f FROM (SELECT factor_a AS f FROM e UNION SELECT factor_b FROM e)),
  t AS (SELECT string_agg(f, ',' ORDER BY f) AS members, min(f) AS keep FROM g HAVING count(*) > 0)
  SELECT members, keep, {r('(SELECT max(abs(corr)) FROM e) AS max_abs_corr')} FROM t""")
def redundancy_clusters(spark, d):
    cols, m = _matrix(spark, d)
    rows = [(",".join(g["members"]), g["keep"], g["max_abs_corr"]) for g in correlation.redundancy_clusters(cols, m, 0.01)]
    return spark.createDataFrame(rows, "members string, keep string, max_abs_corr double")


# ---------------------------------------------------------------- backtest


_SIG = f"{SUP}, {CAL}, {_z('volume', 'date, sector', 'sup')}, sg AS (SELECT 'volume' AS sleeve, date, ticker, CASE WHEN ticker % 9 <> 0 OR month(date) % 2 = 0 THEN z END AS z FROM zt)"


def _bt_sql(signals: str = "sg", prices: str = "sup", every: int = 3) -> str:
    """CTEs up to hd (k, ticker, hold) and lb (sleeve, k, ticker, q): the engine spelled out."""
    return f"""pd AS (SELECT *, lead(entry) OVER (ORDER BY entry) IS NULL AS last, coalesce(lead(entry) OVER (ORDER BY entry), (SELECT max(pos) FROM cal)) AS exit, entry - 1 AS signal, row_number() OVER (ORDER BY entry) - 1 AS k FROM (SELECT date AS trade_date, pos AS entry FROM cal WHERE pos % {every} = 1)),
  pe AS (SELECT * FROM pd WHERE exit > entry AND signal >= 0),
  sv AS (SELECT sleeve, ticker, pos, z FROM {signals} JOIN cal USING (date) WHERE z IS NOT NULL),
  sk AS (SELECT sleeve, k, ticker, arg_max(z, pos) AS z FROM sv JOIN pe ON pos <= signal GROUP BY ALL),
  {_labels_sql('sk', 'z', 'sleeve, k', 5)},
  px AS (SELECT ticker, pos, px FROM {prices} JOIN cal USING (date)), seen AS (SELECT ticker, max(pos) AS seen FROM px GROUP BY ticker),
  h0 AS (SELECT k, a.ticker, last, seen > exit AS later, b.px IS NULL AS gone, b.px / a.px - 1 AS raw FROM px a JOIN pe ON a.pos = entry LEFT JOIN px b ON b.ticker = a.ticker AND b.pos = exit JOIN seen ON seen.ticker = a.ticker),
  hp AS (SELECT k, quantile_cont(raw, [0.01, 0.99]) AS p FROM h0 GROUP BY k),
  hd AS (SELECT k, ticker, CASE WHEN gone THEN CASE WHEN last THEN -0.3 WHEN later THEN 0.0 ELSE -0.3 END WHEN p[2] > p[1] THEN greatest(least(raw, p[2]), p[1]) ELSE raw END AS hold FROM h0 JOIN hp USING (k))"""


_LEGS = """wt AS (SELECT sleeve, k, q, ticker, 1.0::DOUBLE / count(*) OVER (PARTITION BY sleeve, k, q) AS w FROM lb WHERE q IS NOT NULL),
  lg AS (SELECT sleeve, k, q::INTEGER AS q, row_number() OVER (PARTITION BY sleeve, q ORDER BY k) AS seq FROM (SELECT DISTINCT sleeve, k FROM lb WHERE q IS NOT NULL) CROSS JOIN (VALUES (1), (2), (3), (4), (5)) v(q)),
  gr AS (SELECT sleeve, k, q, sum(w * coalesce(hold, 0)) AS gross FROM wt LEFT JOIN hd USING (k, ticker) GROUP BY ALL),
  ws AS (SELECT sleeve, q, seq, ticker, w FROM wt JOIN lg USING (sleeve, k, q)),
  tn AS (SELECT sleeve, q, seq, sum(abs(d)) / 2 AS turnover FROM (SELECT sleeve, q, seq, ticker, sum(w) AS d FROM (SELECT * FROM ws UNION ALL SELECT sleeve, q, seq + 1, ticker, -w FROM ws) GROUP BY ALL) GROUP BY ALL),
  bt AS (SELECT sleeve, lg.q, lg.k, trade_date, coalesce(gross, 0) AS gross, coalesce(turnover, 0) AS turnover FROM lg LEFT JOIN gr USING (sleeve, k, q) LEFT JOIN tn USING (sleeve, q, seq) JOIN pe ON pe.k = lg.k)"""


def _signals(spark: SparkSession, d: str) -> DataFrame:
    z = xsec.add_group_z(_sup(spark, d), ["volume"], ["date", "sector"])
    return z.select(F.lit("volume").alias("sleeve"), "date", "ticker", F.when((F.col("ticker") % 9 != 0) | (F.month("date") % 2 == 0), F.col("z_volume")).alias("z"))


def _trades(df: DataFrame, every: int = 3) -> DataFrame:
    return calendar.calendar(df).filter(F.col("pos") % every == 1).select(F.col("date").alias("trade_date"))


def _run(spark: SparkSession, d: str) -> DataFrame:
    p = _sup(spark, d).select("date", "ticker", "px")
    return backtest.run_backtest(p, _signals(spark, d), _trades(p), by=["sleeve"])


_BT = f"WITH {_SIG}, {_bt_sql()}, {_LEGS}"


@query(f"{_BT} SELECT q, k, trade_date, {r('gross', 'turnover')} FROM bt")
def quantile_backtest(spark, d):
    return _run(spark, d).select("q", "k", "trade_date", "gross", "turnover").withColumn("k", F.col("k").cast("long"))


def _dd_sql(src: str, x: str, by: str) -> str:
    part = f"PARTITION BY {by}" if by else ""
    return f"""c1 AS (SELECT *, product(1 + {x}) OVER ({part} ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS cum FROM {src}), c2 AS (SELECT *, cum / max(cum) OVER ({part} ORDER BY trade_date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM c1)"""


_ANN = "avg({x}) * 12"
_VOL = "CASE WHEN count(*) > 1 THEN stddev_samp({x}) * sqrt(12.0::DOUBLE) ELSE 0 END"


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) <> 0 THEN ({a}) / ({b}) ELSE 0 END"


@query(f"""{_BT}, nt AS (SELECT *, gross - turnover * 0.001::DOUBLE AS net FROM bt), {_dd_sql('nt', 'net', 'q')}
  SELECT q, {r(_ANN.format(x='net') + ' AS ann_return', _VOL.format(x='net') + ' AS ann_vol', 'min(dd) AS max_dd', 'avg(turnover) AS avg_turnover', _ratio(_ANN.format(x='net'), _VOL.format(x='net')) + ' AS sharpe')} FROM c2 GROUP BY q""")
def backtest_stats(spark, d):
    return backtest.leg_stats(backtest.net(_run(spark, d), 10.0))


_LS = "ls AS (SELECT sleeve, trade_date, sum(CASE q WHEN 5 THEN gross WHEN 1 THEN -gross END) - sum(turnover) FILTER (q IN (1, 5)) * 0.001::DOUBLE AS spread, sum(turnover) FILTER (q IN (1, 5)) AS turnover FROM bt GROUP BY ALL)"


@query(f"""{_BT}, {_LS}, {_dd_sql('ls', 'spread', 'sleeve')}
  SELECT sleeve, count(*) AS periods, {r(_ANN.format(x='spread') + ' AS ann_return', _VOL.format(x='spread') + ' AS ann_vol', 'min(dd) AS max_drawdown', 'avg(turnover) AS avg_turnover_ls', 'avg((spread > 0)::INTEGER) AS hit_rate', 'arg_max(cum, trade_date) - 1 AS cumulative', _ratio(_ANN.format(x='spread'), _VOL.format(x='spread')) + ' AS sharpe')} FROM c2 GROUP BY sleeve""")
def ls_summary(spark, d):
    return backtest.spread_report(_run(spark, d), 10.0, by=["sleeve"])


@query(f"""{_BT}, a AS (SELECT sleeve, avg(gross - turnover * 0.001::DOUBLE) FILTER (q = 1) * 12 AS q1_ann, avg(gross - turnover * 0.001::DOUBLE) FILTER (q = 3) * 12 AS q3_ann, avg(gross - turnover * 0.001::DOUBLE) FILTER (q = 5) * 12 AS q5_ann FROM bt GROUP BY sleeve)
  SELECT sleeve, {r('q1_ann', 'q3_ann', 'q5_ann', 'q5_ann - q3_ann AS long_contrib', 'q3_ann - q1_ann AS short_contrib', 'CASE WHEN abs(q5_ann - q1_ann) > 1e-12 THEN (q3_ann - q1_ann) / (q5_ann - q1_ann) END AS short_share')} FROM a""")
def sleeve_report(spark, d):
    return backtest.sleeve_report(_run(spark, d), 10.0).select("sleeve", "q1_ann", "q3_ann", "q5_ann", "long_contrib", "short_contrib", "short_share")


@query(f"""WITH {SUP}, {CAL}, b AS (SELECT date AS trade_date, px FROM sup WHERE ticker = 3), t AS (SELECT c.date AS trade_date, last_value(px IGNORE NULLS) OVER (ORDER BY c.date ROWS UNBOUNDED PRECEDING) AS px FROM cal c LEFT JOIN b ON b.trade_date = c.date WHERE pos % 3 = 1)
  SELECT trade_date, {r('lead(px) OVER (ORDER BY trade_date) / px - 1 AS ret')} FROM t QUALIFY lead(px) OVER (ORDER BY trade_date) IS NOT NULL""")
def benchmark_returns(spark, d):
    p = _sup(spark, d).select("date", "ticker", "px")
    return backtest.benchmark_returns(p, _trades(p), 3)


@query(f"""{_BT}, b AS (SELECT c.date AS trade_date, last_value(px IGNORE NULLS) OVER (ORDER BY c.date ROWS UNBOUNDED PRECEDING) AS px FROM cal c LEFT JOIN (SELECT date, px FROM sup WHERE ticker = 3) s ON s.date = c.date WHERE pos % 3 = 1), bm AS (SELECT trade_date, lead(px) OVER (ORDER BY trade_date) / px - 1 AS ret FROM b QUALIFY lead(px) OVER (ORDER BY trade_date) IS NOT NULL),
  jn AS (SELECT trade_date, gross - turnover * 0.001::DOUBLE AS net, turnover, ret, gross - turnover * 0.001::DOUBLE - ret AS active FROM bt JOIN bm USING (trade_date) WHERE q = 5), {_dd_sql('jn', 'net', '')},
  tr AS (SELECT arg_min(trade_date, (dd, trade_date)) AS trough FROM c2)
  SELECT count(*) AS periods, {r('min(dd) AS max_drawdown')}, arg_max(trade_date, cum) FILTER (trade_date <= trough) AS dd_peak, any_value(trough) AS dd_trough, min(trade_date) FILTER (trade_date >= trough AND dd >= 0) AS dd_recovered,
    {r(_ANN.format(x='net') + ' AS ann_return', _VOL.format(x='net') + ' AS ann_vol', 'avg(turnover) AS avg_turnover', 'avg((net > 0)::INTEGER) AS hit_rate', 'avg(ret) * 12 AS bench_ann_return', _ANN.format(x='active') + ' AS ann_active_return', _VOL.format(x='active') + ' AS ann_tracking_error', 'avg((active > 0)::INTEGER) AS hit_rate_vs_bench', 'product(1 + net) - 1 AS cumulative', 'product(1 + active) - 1 AS cumulative_active', _ratio(_ANN.format(x='net'), _VOL.format(x='net')) + ' AS sharpe', _ratio(_ANN.format(x='active'), _VOL.format(x='active')) + ' AS information_ratio')}
  FROM c2, tr""")
def longonly_summary(spark, d):
    p = _sup(spark, d).select("date", "ticker", "px")
    leg = calendar.local(backtest.net(_run(spark, d).filter("q = 5"), 10.0))
    return backtest.long_only_report(leg, backtest.benchmark_returns(p, _trades(p), 3))


@query(f"""{_BT}, {_dd_sql("(SELECT * FROM bt WHERE q = 5)", 'gross', '')} SELECT trade_date, {r('cum', 'dd')} FROM c2""")
def max_drawdown(spark, d):
    return drawdowns(calendar.local(_run(spark, d).filter("q = 5")), "gross", "trade_date").select("trade_date", "cum", "dd")


_CAPW = """cw AS (SELECT sleeve, k, lb.ticker, CASE WHEN c.cap > 100000 THEN c.cap END AS cap FROM lb JOIN pe USING (k) JOIN cal ON cal.pos = pe.entry - 1 LEFT JOIN sup c ON c.ticker = lb.ticker AND c.date = cal.date WHERE q = 5),
  wt AS (SELECT sleeve, k, ticker, CASE WHEN sum(cap) OVER g > 0 THEN coalesce(cap / sum(cap) OVER g, 0) ELSE 1.0::DOUBLE / count(*) OVER g END AS w FROM cw WINDOW g AS (PARTITION BY sleeve, k)),
  sq AS (SELECT k, row_number() OVER (ORDER BY k) AS seq FROM (SELECT DISTINCT k FROM lb WHERE q IS NOT NULL)), ws AS (SELECT seq, ticker, w FROM wt JOIN sq USING (k)),
  tn AS (SELECT seq, sum(abs(d)) / 2 AS turnover FROM (SELECT seq, ticker, sum(w) AS d FROM (SELECT * FROM ws UNION ALL SELECT seq + 1, ticker, -w FROM ws) GROUP BY ALL) GROUP BY seq)"""


@query(f"""WITH {_SIG}, {_bt_sql()}, {_CAPW}, gr AS (SELECT k, sum(w * coalesce(hold, 0)) AS gross FROM wt LEFT JOIN hd USING (k, ticker) GROUP BY k)
  SELECT trade_date, {r('gross', 'turnover')} FROM gr JOIN sq USING (k) JOIN tn USING (seq) JOIN pe USING (k)""")
def cap_weighted_top(spark, d):
    df = _sup(spark, d)
    caps = df.select("date", "ticker", F.when(F.col("cap") > 100000, F.col("cap")).alias("cap"))
    p = df.select("date", "ticker", "px")
    return backtest.cap_weighted_top(p, _signals(spark, d), caps, _trades(p), by=["sleeve"]).select("trade_date", "gross", "turnover")


_PCAL = f"{PRT}, cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM prt)), pr2 AS (SELECT * FROM prt)"


@query(f"""WITH {_PCAL}, pe AS (SELECT k, entry, exit FROM (SELECT pos AS entry, coalesce(lead(pos) OVER (ORDER BY pos), (SELECT max(pos) FROM cal)) AS exit, row_number() OVER (ORDER BY pos) - 1 AS k FROM cal WHERE pos % 6 = 1) WHERE exit > entry),
  px AS (SELECT ticker, pos FROM pr2 JOIN cal USING (date)), seen AS (SELECT ticker, max(pos) AS seen FROM px GROUP BY ticker)
  SELECT k, a.ticker, CASE WHEN seen > exit THEN 0.0::DOUBLE ELSE -0.3::DOUBLE END AS fill FROM px a JOIN pe ON a.pos = entry JOIN seen ON seen.ticker = a.ticker LEFT JOIN px b ON b.ticker = a.ticker AND b.pos = exit WHERE b.pos IS NULL""")
def exit_fill(spark, d):
    p = ad.part_panel(spark, d).select("date", "ticker", "px")
    cal = calendar.calendar(p)
    return backtest.exit_fills(p, backtest.periods(cal, _trades(p, 6)), cal).withColumn("k", F.col("k").cast("long"))


@query(f"""WITH {_PCAL}, pe AS (SELECT k, trade_date, entry, exit FROM (SELECT date AS trade_date, pos AS entry, lead(pos) OVER (ORDER BY pos) AS exit, row_number() OVER (ORDER BY pos) - 1 AS k FROM cal WHERE pos % 6 = 1) WHERE exit > entry),
  un AS (SELECT date, ticker, CASE WHEN volume > 30 THEN volume END AS z FROM pr2), la AS (SELECT k, max(date) AS date FROM pe JOIN (SELECT DISTINCT date FROM un) ON date <= trade_date GROUP BY k),
  mb AS (SELECT k, ticker FROM un JOIN la USING (date) WHERE z IS NOT NULL), px AS (SELECT ticker, pos, px FROM pr2 JOIN cal USING (date)), seen AS (SELECT ticker, max(pos) AS seen FROM px GROUP BY ticker),
  h AS (SELECT k, mb.ticker, seen > exit AS later, a.px AS p0, b.px AS p1, b.px / a.px - 1 AS raw FROM mb JOIN pe USING (k) LEFT JOIN px a ON a.ticker = mb.ticker AND a.pos = entry LEFT JOIN px b ON b.ticker = mb.ticker AND b.pos = exit LEFT JOIN seen ON seen.ticker = mb.ticker),
  p AS (SELECT k, quantile_cont(raw, [0.01, 0.99]) AS p FROM h GROUP BY k)
  SELECT k, any_value(trade_date) AS trade_date, {r('avg(CASE WHEN p0 IS NULL THEN 0 WHEN p1 IS NULL THEN CASE WHEN later THEN 0 ELSE -0.3 END WHEN p[2] > p[1] THEN greatest(least(raw, p[2]), p[1]) ELSE raw END) AS ret')} FROM h JOIN p USING (k) JOIN pe USING (k) GROUP BY k""")
def equal_weight_benchmark(spark, d):
    df = ad.part_panel(spark, d)
    universe = df.select("date", "ticker", F.when(F.col("volume") > 30, F.col("volume")).alias("z"))
    p = df.select("date", "ticker", "px")
    return backtest.equal_weight_benchmark(p, _trades(p, 6), universe).withColumn("k", F.col("k").cast("long"))


@query(f"""WITH {_PCAL}, pe AS (SELECT k, entry, exit FROM (SELECT pos AS entry, lead(pos) OVER (ORDER BY pos) AS exit, row_number() OVER (ORDER BY pos) - 1 AS k FROM cal WHERE pos % 6 = 1) WHERE exit > entry),
  px AS (SELECT ticker, pos FROM pr2 JOIN cal USING (date)), mb AS (SELECT k, ticker FROM pr2 JOIN cal USING (date) JOIN pe ON pos = entry - 1 WHERE volume > 10)
  SELECT count(*) AS held, count(*) FILTER (b.pos IS NULL) AS no_exit, {r('count(*) FILTER (b.pos IS NULL) / count(*)::DOUBLE AS share')} FROM mb JOIN pe USING (k) JOIN px a ON a.ticker = mb.ticker AND a.pos = entry LEFT JOIN px b ON b.ticker = mb.ticker AND b.pos = exit""")
def delist_incidence(spark, d):
    df = ad.part_panel(spark, d)
    p = df.select("date", "ticker", "px")
    return backtest.delist_incidence(p, df.select("date", "ticker", F.when(F.col("volume") > 10, F.col("volume")).alias("z")), _trades(p, 6))


@query(f"""WITH {SUP}, w AS (SELECT date, ticker, volume / sum(volume) OVER (PARTITION BY date) AS w FROM sup), d AS (SELECT date, lead(date) OVER (ORDER BY date) AS nxt FROM (SELECT DISTINCT date FROM sup)),
  m AS (SELECT date, ticker, sum(x) AS d FROM (SELECT date, ticker, w AS x FROM w UNION ALL SELECT nxt, ticker, -w FROM w JOIN d USING (date) WHERE nxt IS NOT NULL) GROUP BY ALL) SELECT date, {r('sum(abs(d)) / 2 AS turnover')} FROM m GROUP BY date""")
def turnover_between(spark, d):
    df = _sup(spark, d)
    w = df.withColumn("w", safe_div(F.col("volume"), F.sum("volume").over(Window.partitionBy("date")))).select("date", "ticker", "w")
    nxt = df.select("date").distinct().withColumn("nxt", F.lead("date").over(Window.orderBy("date"))).filter("nxt IS NOT NULL")
    old = w.join(F.broadcast(nxt), "date").select(F.col("nxt").alias("date"), "ticker", "w")
    return backtest.turnover_between(old, w, by=["date"])


@query(f"""WITH {SUP}, l AS (SELECT ticker, sector, volume / sum(volume) OVER () AS w FROM sup WHERE date = (SELECT max(date) FROM sup)), c AS (SELECT ticker, sector, least(w, 0.05::DOUBLE) AS w FROM l),
  g AS (SELECT *, sum(w) OVER (PARTITION BY sector) AS g FROM c), s AS (SELECT ticker, CASE WHEN g > 0.2 THEN w * 0.2::DOUBLE / g ELSE w END AS w FROM g) SELECT ticker, {r('w / sum(w) OVER () AS w')} FROM s""")
def sector_caps(spark, d):
    df = _sup(spark, d)
    last = df.join(F.broadcast(df.agg(F.max("date").alias("date"))), "date", "left_semi")
    total = last.agg(F.sum("volume").alias("t"))
    w = last.crossJoin(F.broadcast(total)).select("ticker", "sector", safe_div(F.col("volume"), F.col("t")).alias("w"))
    return backtest.apply_caps(w, 0.05, 0.2).select("ticker", "w")

