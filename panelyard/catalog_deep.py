"""Registered queries of sources, sinks and of operators that split one key's rows over many tasks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adapters as ad
from .catalog import CAL, RET, SUP, _LEGS, _LS, _RAW, _bt_sql, _dd_sql, _ic, _raw_prices, _sup, _sup_returns, _trades, _z, query, r
from .functions import selection, xsec
from .operators import asof, clean, dedup, ranges
from .plans import backtest, correlation, lab
from .sources import increments, loads, stages, zips
from .sources.groups import SECTOR_GROUPS, sector_groups
from .sources.scratch import scratch_path, written
from .streaming import asof_state

# ---------------------------------------------------------------- sources and sinks


@query("SELECT l_orderkey::VARCHAR AS l_orderkey, l_linenumber::VARCHAR AS l_linenumber, strftime(l_shipdate, '%Y-%m-%d') AS shipped, l_returnflag || ', \"' || l_linestatus || '\"' AS flags FROM lineitem")
def zip_round_trip(spark, d):
    """lineitem as zipped CSV, an archive for each task, and read back by ranges of members."""
    li = ad.read(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("l_orderkey"), F.col("l_linenumber").cast("string").alias("l_linenumber"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipped"), F.concat("l_returnflag", F.lit(', "'), "l_linestatus", F.lit('"')).alias("flags"))
    folder = scratch_path(spark, "zips")
    zips.write_zips(li, folder, "lines", member_rows=50_000)
    return zips.read_zips(spark, folder, "lines", columns=li.columns, split=4 << 20).drop("file_no")


def _report(spark: SparkSession, report: dict) -> DataFrame:
    return spark.createDataFrame(sorted(report.items()), "reason string, n bigint")


@query(f"""WITH {_RAW}, c AS (SELECT try_cast("DATE" AS DATE) AS d, trim("TICKER") AS t, CASE WHEN try_cast("DATE" AS DATE) IS NULL THEN 'bad_date' WHEN trim("TICKER") = '' THEN 'missing_ticker' WHEN coalesce(try_cast("ADJ_CLOSE" AS DOUBLE), 0) <= 0 THEN 'bad_adj_close' ELSE 'ok' END AS reason FROM raw),
  u AS (SELECT count(*) AS n, count(DISTINCT (d, t)) AS kept FROM c WHERE reason = 'ok')
  SELECT 'rows_in' AS reason, count(*) AS n FROM c UNION ALL SELECT 'rows_out', kept FROM u UNION ALL SELECT 'duplicates', n - kept FROM u UNION ALL SELECT reason, count(*) FROM c WHERE reason <> 'ok' GROUP BY reason""")
def counted_load(spark, d):
    return _report(spark, loads.load_prices(_raw_prices(spark, d), scratch_path(spark, "load")))


@query("""WITH v AS (SELECT o_custkey, CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate::DATE END AS known, CASE o_orderstatus WHEN 'F' THEN 'FY' WHEN 'O' THEN 'Q1TTM' ELSE 'Q' || (o_orderkey % 3) END AS p FROM orders),
  t AS (SELECT *, p IN ('FY', 'Q1TTM') AS ttm FROM v), u AS (SELECT count(*) AS n, count(DISTINCT (o_custkey, known, p)) AS kept FROM t WHERE ttm AND known IS NOT NULL)
  SELECT 'rows_in' AS reason, count(*) AS n FROM t UNION ALL SELECT 'rows_out', kept FROM u UNION ALL SELECT 'duplicates', n - kept FROM u UNION ALL SELECT 'no_availability', count(*) FROM t WHERE ttm AND known IS NULL
  UNION ALL SELECT 'skipped_period', count(*) FROM t WHERE NOT ttm UNION ALL SELECT 'skipped ' || p, count(*) FROM t WHERE NOT ttm GROUP BY p""")
def counted_vintages(spark, d):
    k = F.col("o_orderkey")
    raw = ad.read(spark, d, "orders").select(F.col("o_custkey").alias("ticker"), F.when(k % 5 > 0, F.to_date("o_orderdate").cast("string")).alias("filing_date"), F.lit(None).cast("string").alias("first_calculable_at"), F.when(F.col("o_orderstatus") == "F", "FY").when(F.col("o_orderstatus") == "O", "Q1TTM").otherwise(F.concat(F.lit("Q"), (k % 3).cast("string"))).alias("fiscal_period"), "o_orderkey")
    report = loads.load_vintages(raw, scratch_path(spark, "vintages"))
    skipped = report.pop("skipped_periods")
    return _report(spark, report | {f"skipped {p}": n for p, n in skipped.items()})


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def incremental_table(spark, d):
    """orders in files by year: half of them are ingested, one of these changes, then all are; a third run finds nothing to do."""
    inputs, table = scratch_path(spark, "inputs"), scratch_path(spark, "table")
    orders = ad.read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.year("o_orderdate").alias("y"))
    first, rest = orders.filter("y < 1995").withColumn("o_custkey", F.when(F.col("y") > 1993, -1).otherwise(F.col("o_custkey")).cast("bigint")), orders.filter("y >= 1994")
    schema = orders.schema

    def build(paths: list[str]) -> DataFrame:
        return spark.read.schema(schema).parquet(*paths).select("*", F.col("_metadata.file_path").alias("input_path"))

    first.repartition("y").write.parquet(f"{inputs}/a")
    increments.ingest(spark, table, f"{inputs}/*", build)
    first.filter("y < 1994").repartition("y").write.mode("overwrite").parquet(f"{inputs}/a")
    rest.repartition("y").write.parquet(f"{inputs}/b")
    increments.ingest(spark, table, f"{inputs}/*", build, drop_missing=True)
    again = increments.ingest(spark, table, f"{inputs}/*", build)
    if again["new"] or again["changed"]:
        raise AssertionError(again)
    return increments.read_committed(spark, table).select("o_orderkey", "o_custkey", "o_orderstatus")


@query(f"SELECT l_suppkey, {r('sum(l_quantity::BIGINT)::DOUBLE AS qty')} FROM lineitem WHERE l_shipdate >= DATE '1995-01-01' GROUP BY l_suppkey")
def reused_stage(spark, d):
    """A stage that is built, found again, and built anew once its plan differs."""
    path = scratch_path(spark, "stage")

    def since(day: str):
        return lambda: ad.read(spark, d, "lineitem").filter(F.col("l_shipdate") >= F.lit(day).cast("date")).groupBy("l_suppkey").agg(F.sum(F.col("l_quantity").cast("bigint")).cast("double").alias("qty"))

    stages.reuse(spark, path, since("1996-01-01"))
    stages.reuse(spark, path, since("1995-01-01"))
    return stages.reuse(spark, path, since("1995-01-01"))


_GROUP_NAMES = sorted(g for groups in SECTOR_GROUPS.values() for g in groups)


@query("WITH g AS (SELECT * FROM (VALUES " + ", ".join(f"({_GROUP_NAMES.index(g)}, '{g}', '{s}')" for s, groups in SECTOR_GROUPS.items() for g in groups) + f") t(i, grp, sector)) SELECT p_partkey, grp, sector FROM part JOIN g ON p_partkey % {len(_GROUP_NAMES)} = i")
def mapped_groups(spark, d):
    """Every part in one of the vendor's industry groups, mapped to its sector by exact text."""
    names = F.array(*map(F.lit, _GROUP_NAMES))
    p = ad.read(spark, d, "part").select("p_partkey", F.get(names, (F.col("p_partkey") % len(_GROUP_NAMES)).cast("int")).alias("grp"))
    return clean.map_groups(p, "grp", sector_groups(spark))


# ---------------------------------------------------------------- one key over many tasks


@query(f"""SELECT l_returnflag, {r(*[f'quantile_cont(l_extendedprice, {p}) AS p{i}' for i, p in enumerate((0.01, 0.25, 0.5, 0.75, 0.99))])} FROM lineitem GROUP BY l_returnflag""")
def quantiles_by_counting(spark, d):
    """Three groups of a third of all rows each: every one is selected from by counting."""
    points = (0.01, 0.25, 0.5, 0.75, 0.99)
    out = selection.exact_quantiles(ad.read(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag"], points, "p", hot=1000, few=500)
    return out.select("l_returnflag", *[F.col("p")[i].alias(f"p{i}") for i in range(len(points))])


@query(f"""SELECT l_orderkey, l_linenumber, {r('greatest(least(l_extendedprice, hi), lo) AS price')} FROM lineitem JOIN (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi FROM lineitem GROUP BY ALL) USING (l_returnflag)""")
def winsorized_by_counting(spark, d):
    li = ad.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice")
    return xsec.winsorize_percentiles(li, "l_extendedprice", ["l_returnflag"], out="price", hot=1000).select("l_orderkey", "l_linenumber", "price")


@query("""SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0::DOUBLE AS rank FROM lineitem""")
def ranks_in_ranges(spark, d):
    """Average ranks with long runs of ties in three large groups."""
    li = ad.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return ranges.average_ranks(li, "l_quantity", ["l_returnflag"], parts=16).select("l_orderkey", "l_linenumber", "rank")


@query(f"""SELECT event_id, {r("last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER w AS bought", 'max(value) OVER w AS peak', 'sum(user_id) OVER w AS users')}
  FROM events WINDOW w AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def running_values_in_ranges(spark, d):
    """All events are one series."""
    ev = ad.read(spark, d, "events").select("event_id", "ts", F.lit("all").alias("key"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("b"), "value", F.col("user_id").cast("bigint").alias("u"))
    out = ranges.scan(ev, ["key"], ["ts", "event_id"], {"bought": ("last", "b"), "peak": ("max", "value"), "users": ("sum", "u")}, parts=16)
    return out.select("event_id", "bought", "peak", F.col("users").cast("double").alias("users"))


@query(f"""WITH e AS (SELECT event_id, ts FROM events WHERE event_type <> 'purchase'), v AS (SELECT ts, value FROM events WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY ts ORDER BY event_id DESC) = 1)
  SELECT event_id, {r('value AS known')} FROM e ASOF LEFT JOIN v ON e.ts >= v.ts""")
def asof_in_ranges(spark, d):
    """All events are of one key: the last purchase of anyone."""
    ev = ad.read(spark, d, "events").withColumn("key", F.lit("all"))
    v = ev.filter("event_type = 'purchase'").select("key", F.col("ts").alias("vts"), F.col("value").alias("known"), "event_id")
    left = ev.filter("event_type <> 'purchase'").select("event_id", "key", "ts")
    return asof.asof_backward(left, v, "key", "ts", "vts", ["known"], [F.desc("event_id")], parts=16).select("event_id", "known")


@query(f"""WITH e AS (SELECT event_id, user_id, ts FROM events WHERE event_type <> 'purchase'), v AS (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) = 1)
  SELECT e.event_id, {r('v.value AS known')} FROM e ASOF LEFT JOIN v ON e.user_id = v.user_id AND e.ts >= v.ts""")
def asof_with_state(spark, d):
    """Both sides as streams, each ended by a row far ahead, which lets the watermark pass all others."""
    ev = ad.read(spark, d, "events").filter("user_id is not null and ts is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    left, right = ev.filter("event_type <> 'purchase'").select("event_id", "user_id", "ts"), ev.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("vts"), F.col("value").alias("known"), "event_id")
    end = dt.datetime(2200, 1, 1)
    streams = []
    for name, df, last in (("prices", left, (-1, -1, end)), ("vintages", right, (-1, end, 0.0, -1))):
        path = scratch_path(spark, name)
        df.unionByName(spark.createDataFrame([last], df.schema)).write.parquet(path)
        streams.append(spark.readStream.schema(df.schema).parquet(path))
    out = scratch_path(spark, "joined")
    asof_state.write_asof(asof_state.asof_stream(*streams, "user_id", "ts", "vts", ["known"], "1 hour", "event_id"), out, scratch_path(spark, "offsets")).awaitTermination()
    return spark.read.parquet(out).select("event_id", "known")


# ---------------------------------------------------------------- correlations of many factors

#: Factors of a part and month: SQL that both engines read.
_FACTORS = {
    "a_volume": "volume", "b_cap": "cap", "c_px": "px", "d_disc": "disc", "e_volume_sq": "volume * volume", "f_px_gap": "CASE WHEN ticker % 5 <> 0 THEN px END", "g_disc_gap": "CASE WHEN ticker % 5 <> 0 THEN disc END",
    "h_minus_disc": "-disc", "i_cap_gap": "CASE WHEN ticker % 3 <> 0 THEN cap END", "j_key": "(ticker % 97) * 1.0", "k_px_sq": "px * px", "l_mix": "CASE WHEN ticker % 3 <> 0 THEN volume - 10 * disc END",
}
_PARTS = f"""prt AS (SELECT date_trunc('quarter', l_shipdate)::DATE AS date, l_partkey AS ticker, sum(l_quantity::BIGINT)::DOUBLE AS volume, sum(round(l_extendedprice * 100)::BIGINT)::DOUBLE / 100 AS cap,
  sum(round(l_extendedprice * 100)::BIGINT)::DOUBLE / (sum(l_quantity::BIGINT) * 100)::DOUBLE AS px, sum(round(l_discount * 100)::BIGINT)::DOUBLE / (count(*) * 100)::DOUBLE AS disc FROM lineitem GROUP BY ALL),
  w AS (SELECT date, ticker, {', '.join(f'{e} AS {n}' for n, e in _FACTORS.items())} FROM prt),
  lg AS (UNPIVOT w ON COLUMNS(* EXCLUDE (date, ticker)) INTO NAME factor VALUE x),
  pl AS (SELECT a.date, a.factor AS factor_a, b.factor AS factor_b, a.x, b.x AS y FROM lg a JOIN lg b ON a.date = b.date AND a.ticker = b.ticker AND a.factor < b.factor)"""
_BY = "PARTITION BY date, factor_a, factor_b"
_SPEARMAN = f"""{_PARTS}, rk AS (SELECT date, factor_a, factor_b, rank() OVER ({_BY} ORDER BY x) + (count(*) OVER ({_BY}, x) - 1) / 2.0::DOUBLE AS x, rank() OVER ({_BY} ORDER BY y) + (count(*) OVER ({_BY}, y) - 1) / 2.0::DOUBLE AS y FROM pl),
  corr AS (SELECT date, factor_a, factor_b, CASE WHEN count(*) >= 30 AND stddev_samp(x) > 0 AND stddev_samp(y) > 0 THEN covar_samp(x, y) / (stddev_samp(x) * stddev_samp(y)) END AS corr FROM rk GROUP BY ALL)"""


def _factors(spark: SparkSession, d: str) -> DataFrame:
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    q = ad.read(spark, d, "lineitem").groupBy(F.trunc("l_shipdate", "quarter").alias("date"), F.col("l_partkey").alias("ticker")).agg(F.sum(F.col("l_quantity").cast("long")).cast("double").alias("volume"), F.sum(cents).cast("double").alias("cents"), F.sum(F.round(F.col("l_discount") * 100).cast("long")).cast("double").alias("d"), F.count(F.lit(1)).alias("n"))
    q = q.select("date", "ticker", "volume", (F.col("cents") / 100).alias("cap"), (F.col("cents") / (F.col("volume") * 100)).alias("px"), (F.col("d") / (F.col("n") * 100).cast("double")).alias("disc"))
    return q.select("date", "ticker", *[F.expr(e).cast("double").alias(n) for n, e in _FACTORS.items()])


@query(f"WITH {_SPEARMAN} SELECT date, factor_a, factor_b, {r('corr')} FROM corr WHERE corr IS NOT NULL")
def spearman_by_null_classes(spark, d):
    """Twelve factors with three null patterns: rows are ranked for six pairs of classes, not for 66 pairs of factors."""
    return correlation.pair_correlations(_factors(spark, d), list(_FACTORS), "spearman", least=30)


_PRIORITY = {"c_px": 2.0, "h_minus_disc": 1.0, "e_volume_sq": 3.0}


@query(f"""WITH RECURSIVE {_SPEARMAN}, m AS (SELECT factor_a, factor_b, avg(corr) AS corr FROM corr WHERE corr IS NOT NULL GROUP BY ALL), ln AS (SELECT factor_a AS a, factor_b AS b, abs(corr) AS c FROM m WHERE abs(corr) >= 0.7 UNION ALL SELECT factor_b, factor_a, abs(corr) FROM m WHERE abs(corr) >= 0.7),
  reach(a, b) AS (SELECT a, a FROM ln UNION SELECT r.a, l.b FROM reach r JOIN ln l ON r.b = l.a), g AS (SELECT a AS name, min(b) AS g FROM reach GROUP BY a), p AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {v})" for k, v in _PRIORITY.items())}) t(name, w)),
  h AS (SELECT g, max(c) AS c FROM ln JOIN g ON a = name GROUP BY g)
  SELECT string_agg(name, '|' ORDER BY name) AS members, arg_max(name, (coalesce(w, 0), name)) AS keep, {r('any_value(c) AS max_abs_corr')} FROM g LEFT JOIN p USING (name) JOIN h USING (g) GROUP BY g""")
def recursive_clusters(spark, d):
    corr = written(correlation.plain_mean(correlation.pair_correlations(_factors(spark, d), list(_FACTORS), "spearman", least=30)), "corr")
    return correlation.recursive_clusters(corr, 0.7, _PRIORITY)


# ---------------------------------------------------------------- backtests of several sleeves, sensitivities, universes

_TWO = f"{SUP}, {CAL}, {_z('volume', 'date, sector', 'sup')}, {_z('disc', 'date, sector', 'zt', 'z2')}, sg AS (SELECT 'volume' AS sleeve, date, ticker, z FROM zt UNION ALL SELECT 'discount', date, ticker, CASE WHEN month(date) <> 3 THEN z2 END FROM z2t)"


@query(f"WITH {_TWO}, {_bt_sql()}, {_LEGS} SELECT sleeve, q, k, trade_date, {r('gross', 'turnover')} FROM bt")
def multi_sleeve_backtest(spark, d):
    """Two sleeves, one of them with carried scores, in one run that shares prices and fills."""
    z = xsec.add_group_z(_sup(spark, d), ["volume", "disc"], ["date", "sector"])
    both = z.select(F.lit("volume").alias("sleeve"), "date", "ticker", F.col("z_volume").alias("z")).unionByName(z.select(F.lit("discount").alias("sleeve"), "date", "ticker", F.when(F.month("date") != 3, F.col("z_disc")).alias("z")))
    p = _sup(spark, d).select("date", "ticker", "px")
    out = backtest.run_backtest(p, both, _trades(p), by=["sleeve"])
    return out.select("sleeve", "q", F.col("k").cast("long").alias("k"), "trade_date", "gross", "turnover")


def _sensitivity_sql() -> str:
    def part(signals: str, loss: str) -> str:
        run = f"{SUP}, {CAL}, {_z('volume', 'date, sector', 'sup')}, sg AS ({signals}), {_bt_sql()}, {_LEGS}, {_LS}, {_dd_sql('ls', 'spread', 'sleeve')}".replace("-0.3", loss)
        columns = r("avg(spread) * 12 AS ann_return", "min(dd) AS max_drawdown", "avg((spread > 0)::INTEGER) AS hit_rate", "arg_max(cum, trade_date) - 1 AS cumulative")
        return f"SELECT * FROM (WITH {run} SELECT sleeve AS run, count(*) AS periods, {columns} FROM c2 GROUP BY sleeve)"

    full = "SELECT 'full' AS sleeve, date, ticker, z FROM zt UNION ALL SELECT 'px900', date, ticker, CASE WHEN px >= 900 THEN z END FROM zt"
    return part(full, "-0.3") + " UNION ALL " + part("SELECT 'delist100' AS sleeve, date, ticker, z FROM zt", "-1.0")


@query(_sensitivity_sql())
def backtest_sensitivities(spark, d):
    z = xsec.add_group_z(_sup(spark, d), ["volume"], ["date", "sector"]).select("date", "ticker", F.col("z_volume").alias("z"))
    p = _sup(spark, d).select("date", "ticker", "px")
    return backtest.sensitivities(p, z, _trades(p), floor=900.0).select("run", "periods", "ann_return", "max_drawdown", "hit_rate", "cumulative")


@query(f"""WITH {SUP}, e AS (SELECT max(date) AS date FROM sup GROUP BY date_trunc('quarter', date)) SELECT date, ticker, {r("CASE WHEN ticker % 7 <> 0 THEN cap END AS cap")} FROM sup JOIN e USING (date)""")
def cap_frame(spark, d):
    """Caps as text, some of them unreadable, at quarter ends."""
    df = _sup(spark, d)
    ends = df.groupBy(F.trunc("date", "quarter").alias("quarter")).agg(F.max("date").alias("date"))
    return backtest.cap_frame(df.select("date", "ticker", F.when(F.col("ticker") % 7 != 0, F.col("cap").cast("string")).otherwise("n/a").alias("market_cap")), ends)


_EFF = {"volume": "z", "disc": "CASE WHEN ticker % 4 > 0 THEN z2 END"}


def _efficacy_sql() -> str:
    rows = " UNION ALL ".join(f"SELECT '{f}' AS factor, '{y}' AS ret, u.universe, date, {e} AS x, {y} AS y FROM fl JOIN un u ON u.universe = 'broad' OR is_lc" for f, e in _EFF.items() for y in ("ret_fwd_1", "ret_fwd_3"))
    cover = " UNION ALL ".join(f"SELECT '{f}' AS factor, avg((({e}) IS NOT NULL)::INTEGER) AS cov_broad, avg((({e}) IS NOT NULL)::INTEGER) FILTER (is_lc) AS cov_lc FROM fl" for f, e in _EFF.items())
    wide = ", ".join(f"max({v}) FILTER (ret = '{y}' AND universe = '{u}') AS {v}_{y}_{u}" for y in ("ret_fwd_1", "ret_fwd_3") for u in ("broad", "lc") for v in ("ic", "t"))
    names = [f"{v}_{y}_{u}" for y in ("ret_fwd_1", "ret_fwd_3") for u in ("broad", "lc") for v in ("ic", "t")]
    return f"""WITH {SUP}, {RET}, {_z('volume', 'date, sector', 'ret')}, {_z('disc', 'date, sector', 'zt', 'z2')}, un AS (SELECT unnest(['broad', 'lc']) AS universe),
      fl AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY cap DESC, ticker) <= 40 AS is_lc FROM z2t), rows AS ({rows}), {_ic('rows', 'x', 'y', 'factor, ret, universe, date', 30)},
      su AS (SELECT factor, ret, universe, avg(ic) AS ic, CASE WHEN count(ic) >= 2 AND stddev_samp(ic) > 0 THEN avg(ic) / (stddev_samp(ic) / sqrt(count(ic))) END AS t FROM ics WHERE n >= 30 GROUP BY ALL HAVING count(*) >= 10),
      wd AS (SELECT factor, {wide} FROM su GROUP BY factor), cv AS ({cover})
      SELECT factor, {r('cov_broad', 'cov_lc', *names)} FROM cv LEFT JOIN wd USING (factor)"""


@query(_efficacy_sql())
def universe_efficacy(spark, d):
    """Coverage and IC at two horizons in the whole universe and in each date's forty largest."""
    df = xsec.add_group_z(_sup_returns(spark, d), ["volume", "disc"], ["date", "sector"])
    large = dedup.top_n(df, ["date"], F.col("cap"), 40, "ticker")
    df = df.select("date", "ticker", "ret_fwd_1", "ret_fwd_3", F.col("z_volume").alias("volume"), F.when(F.col("ticker") % 4 > 0, F.col("z_disc")).alias("disc"))
    return lab.universe_efficacy(lab.flag_members(df, large), ["volume", "disc"], ["ret_fwd_1", "ret_fwd_3"], least=30)
