from __future__ import annotations

import datetime as dt
import zipfile

import pytest
from pyspark.sql import functions as F

from panelyard.operators import asof, calendar, clean, dedup, live, panel
from panelyard.sources import files, groups

D = dt.date


def days(n, start=D(2024, 1, 1)):
    return [start + dt.timedelta(days=i) for i in range(n)]


def test_price_quarantine_reasons(spark):
    raw = spark.createDataFrame([("2024-01-02", "A", "5"), ("not-a-date", "A", "5"), ("2024-01-02", " ", "5"), ("2024-01-02", "A", "0"), ("2024-01-02", "A", "x")], "DATE string, TICKER string, ADJ_CLOSE string")
    good, bad = clean.split_quarantine(clean.clean_prices(raw))
    assert good.count() == 1
    assert sorted(r["quarantine_reason"] for r in bad.collect()) == ["bad_adj_close", "bad_adj_close", "bad_date", "missing_ticker"]
    assert clean.load_report(raw, clean.clean_prices(raw))["rows_out"] == 1
    with pytest.raises(ValueError, match="missing columns"):
        clean.clean_prices(raw.drop("DATE"))


def test_availability_is_the_later_date(spark):
    df = spark.createDataFrame([("2025-02-01", "2025-02-03 10:00", "FY"), (None, "2025-02-03", "Q1TTM"), (None, None, "FY"), ("2025-02-01", None, "Q1")], "filing_date string, first_calculable_at string, fiscal_period string")
    out = clean.clean_vintages(df).collect()
    assert [r["available_date"] for r in out] == [D(2025, 2, 3), D(2025, 2, 3), None]
    assert [r["quarantine_reason"] for r in out] == [None, None, "no_availability"]
    assert out[0]["grossmargin"] is None
    assert clean.skipped_periods(df).collect()[0]["n"] == 1


def test_asof_takes_the_whole_latest_vintage(spark):
    prices = spark.createDataFrame([("A", D(2024, 1, 9)), ("A", D(2024, 1, 10)), ("A", D(2024, 1, 31)), ("A", D(2024, 2, 1)), ("B", D(2024, 2, 1))], "ticker string, date date")
    v = spark.createDataFrame([("A", D(2024, 1, 10), 10.0, 1.0, "Q1TTM"), ("A", D(2024, 2, 1), 20.0, 7.0, "Q2TTM"), ("A", D(2024, 2, 1), None, 2.0, "FY"), ("A", None, 9.0, 9.0, "FY")], "ticker string, known date, pe double, x double, p string")
    out = {(r["ticker"], r["date"]): (r["pe"], r["x"]) for r in asof.asof_backward(prices, v, "ticker", "date", "known", ["pe", "x"], [F.desc(panel.period_rank("p"))]).collect()}
    assert out == {("A", D(2024, 1, 9)): (None, None), ("A", D(2024, 1, 10)): (10.0, 1.0), ("A", D(2024, 1, 31)): (10.0, 1.0), ("A", D(2024, 2, 1)): (None, 2.0), ("B", D(2024, 2, 1)): (None, None)}
    strict = asof.asof_backward(prices, v, "ticker", "date", "known", ["pe"], strict=True).filter("ticker = 'A' AND date = '2024-01-10'").first()
    assert strict["pe"] is None


def test_asof_has_no_lookahead(spark):
    prices = spark.createDataFrame([("A", d) for d in days(20)], "ticker string, date date")
    v = [("A", D(2024, 1, 5), 1.0), ("A", D(2024, 1, 9), 2.0)]
    base = asof.asof_backward(prices, spark.createDataFrame(v, "ticker string, known date, x double"), "ticker", "date", "known", ["x"])
    more = asof.asof_backward(prices, spark.createDataFrame([*v, ("A", D(2024, 1, 15), 99.0)], "ticker string, known date, x double"), "ticker", "date", "known", ["x"])
    early = "date < '2024-01-15'"
    assert base.filter(early).exceptAll(more.filter(early)).isEmpty()


def test_row_returns(spark):
    df = spark.createDataFrame([("A", d, 100.0 + i) for i, d in enumerate(days(30))], "ticker string, date date, p double")
    out = panel.row_returns(df, "p", [21], [21]).orderBy("date").collect()
    assert out[0]["ret_fwd_21"] == pytest.approx(0.21) and out[21]["ret_21"] == pytest.approx(0.21)
    assert all(r["ret_fwd_21"] is None for r in out[-21:])


def test_momentum_volatility_beta(spark):
    px = [100.0] * 279 + [200.0] * 21
    df = spark.createDataFrame([("A", d, p) for d, p in zip(days(300), px)], "ticker string, date date, p double")
    assert df.select("date", panel.momentum("p", 21, 252).alias("m")).orderBy(F.desc("date")).first()["m"] == 0.0
    alt = [100.0]
    for i in range(199):
        alt.append(alt[-1] * (1.01 if i % 2 == 0 else 1 / 1.01))
    df = panel.row_returns(spark.createDataFrame([("A", d, p) for d, p in zip(days(200), alt)], "ticker string, date date, p double"), "p", [1], [])
    df = df.withColumn("b", F.col("ret_1") * 2)
    last = df.select("date", panel.rolling_vol("ret_1", 126).alias("v"), panel.rolling_beta("b", "ret_1", 126).alias("beta")).orderBy(F.desc("date")).first()
    import pandas as pd

    assert last["v"] == pytest.approx(pd.Series(alt).pct_change().tail(126).std() * 252**0.5, rel=1e-9) and last["beta"] == pytest.approx(2.0)
    assert df.limit(50).select(panel.rolling_vol("ret_1", 126)).filter("1 = 1").first()[0] is None


def test_live_stats_quarantine_bad_ticks(spark):
    calm = [100.0 * 1.001**i for i in range(253)]
    wild = calm[:200] + [x * 12 for x in calm[200:]]
    rows = [("A", d, a) for d, a in zip(days(253), calm)] + [("B", d, b) for d, b in zip(days(253), wild)]
    out = {r["ticker"]: r for r in panel.live_price_stats(spark.createDataFrame(rows, "ticker string, date date, adj_close double"), None).collect()}
    assert out["A"]["mom"] == pytest.approx(1.001**231 - 1) and out["B"]["mom"] is None and out["B"]["vol"] is None


def test_calendars(spark):
    dates = [D(2024, 1, 15), D(2024, 1, 31), D(2024, 2, 1), D(2024, 2, 28), D(2024, 3, 4), D(2024, 3, 28), D(2024, 4, 1)]
    cal = calendar.calendar(spark.createDataFrame([(d,) for d in dates], "date date"))
    ends = calendar.month_ends(cal)
    assert sorted(r[0] for r in ends.collect()) == [D(2024, 1, 31), D(2024, 2, 28), D(2024, 3, 28), D(2024, 4, 1)]
    assert sorted(r["trade_date"] for r in calendar.trade_calendar(cal, ends).collect()) == [D(2024, 2, 1), D(2024, 3, 4)]


def test_longest_series_and_latest(spark):
    rows = [("A", 1, "s1"), ("A", 1, "s2"), ("A", 2, "s2"), ("B", 1, "s3"), ("B", 1, "s4")]
    df = spark.createDataFrame(rows, "ticker string, d int, s string")
    assert sorted((r["ticker"], r["d"], r["s"]) for r in dedup.longest_series(df, ["ticker", "d"], "s").collect()) == [("A", 1, "s2"), ("A", 2, "s2"), ("B", 1, "s3")]
    q = spark.createDataFrame([("A", 2025, 3, 1.1), ("A", 2025, 4, 1.2), ("A", 2026, 1, 1.0), ("A", 2026, 2, 1.2), ("A", 2025, 2, 1.0), ("B", 2026, 2, 3.0), ("B", 2025, 2, 2.9)], "k string, fy int, q int, x double")
    ttm = {r["k"]: r["ttm"] for r in dedup.trailing_sum(q, ["k"], ["fy", "q"], "x").collect()}
    yoy = {r["k"]: r["yoy"] for r in dedup.year_over_year(q, ["k"], "fy", "q", "x").collect()}
    assert ttm["A"] == pytest.approx(4.5) and ttm["B"] is None and yoy["A"] == pytest.approx(0.2) and yoy["B"] == pytest.approx(3 / 2.9 - 1)


def test_top_n_by_size(spark):
    df = spark.createDataFrame([("BIG", 9.0, 1.0), ("NEGEV", -1.0, 8.0), ("NOEV", None, 7.0), ("SMALL", 2.0, 100.0), ("NONE", None, None)], "ticker string, enterprise_value double, market_cap double").withColumn("date", F.lit(1))
    assert sorted(r["ticker"] for r in dedup.top_n(df, ["date"], dedup.size_key(), 3, "ticker").collect()) == ["BIG", "NEGEV", "NOEV"]


def test_labels_tickers_membership(spark):
    df = spark.createDataFrame([(" Real  Estate! ", "BRK.B"), ("---", "GOOG"), (None, "X")], "s string, t string")
    out = df.select(clean.slug("s").alias("s"), clean.bulk_ticker("t").alias("t")).collect()
    assert [r["s"] for r in out] == ["real_estate", "unknown", "unknown"] and [r["t"] for r in out] == ["BRK-B", "GOOGL", "X"]
    a, b = (spark.createDataFrame([(x,) for x in t], "ticker string") for t in ("AB", "BC"))
    assert {r[0]: r[1] for r in clean.membership([("SP500", a), ("DOW", b)]).collect()} == {"A": "SP500", "B": "SP500|DOW", "C": "DOW"}
    with pytest.raises(ValueError, match="no sector"):
        clean.map_groups(df, "s", spark.createDataFrame([("g", "x")], "group string, sector string"))
    assert clean.membership([("SP500", a), ("DOW", b)], sizes={"DOW": 2}).count() == 3
    for wrong in (a.union(a), a.limit(1)):
        with pytest.raises(ValueError, match="SP500"):
            clean.membership([("SP500", wrong)], sizes={"SP500": 2})


def test_sector_groups(spark):
    m = groups.sector_groups(spark)
    assert m.count() == m.select("group").distinct().count() == 152
    assert {r["sector"] for r in m.select("sector").distinct().collect()} == set(files.SECTOR_SLUGS.values())
    assert {r["sector"]: r["count"] for r in m.groupBy("sector").count().collect()}["industrials"] == 42
    df = spark.createDataFrame([("Services –\xa0Health",), ("REIT",), ("Toys",)], "g string")
    assert [r["sector"] for r in clean.map_groups(df, "g", m).orderBy("sector").collect()] == ["consumer_discretionary", "health_care", "real_estate"]


def test_validation(spark):
    df = spark.createDataFrame([("A", 10.0, 250.0, 5.0, 9.0), ("B", 7.0, 10.0, 5.0, 9.0)], "ticker string, price double, pe_ratio double, low_52w double, high_52w double")
    assert sorted((r["ticker"], r["field"]) for r in clean.suspicious(df).collect()) == [("A", "pe_ratio"), ("A", "price")]
    assert clean.validate(df, ["price"])["price"] == 0
    with pytest.raises(ValueError, match="missing columns.*duplicate"):
        clean.validate(df.union(df), ["beta"])


def test_zip_csv(spark, tmp_path):
    for i, name in enumerate(["stock_prices_file-2.zip", "stock_prices_file-10.zip", "stock_prices_key-1.zip"]):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("x.csv", f"TICKER,DATE\nA{i},2024-01-0{i + 1}\n,2024-01-05\n")
    out = files.zip_csv(spark, str(tmp_path), "stock_prices").orderBy("file_no", "DATE").collect()
    assert [(r["TICKER"], r["file_no"]) for r in out] == [("A0", 2), (None, 2), ("A1", 10), (None, 10)]


def test_sheet_blocks(spark):
    rows = [["junk"], ["(n)", "", "Energy"], ["1", "1", " Oil Co ", "OIL", "USD"], [""], ["ignored"], ["(n)", "", "Health Care"], ["1", "2", "Med", "MED"] + ["0"] * 20]
    df = spark.createDataFrame(list(enumerate(rows)), "row int, cells array<string>")
    out = files.load_sheet(df).orderBy("ticker").collect()
    assert [(r["company"], r["ticker"], r["sector"], r["price"]) for r in out] == [("Med", "MED", "health_care", 0.0), ("Oil Co", "OIL", "energy", None)]
    with pytest.raises(ValueError, match="unknown sectors"):
        files.load_sheet(spark.createDataFrame([(0, ["(n)", "", "Mars"]), (1, ["1"])], "row int, cells array<string>"))
    with pytest.raises(ValueError, match="no sector blocks"):
        files.load_sheet(spark.createDataFrame([(0, ["x"])], "row int, cells array<string>"))


def test_workbook(spark, tmp_path):
    openpyxl = pytest.importorskip("openpyxl")
    book = openpyxl.Workbook()
    book.active.title = "UNIVERSE"
    for row in (["(n)", None, "Energy"], [1, 1, "Oil Co", "OIL", "USD", "Q1", 2.5]):
        book.active.append(row)
    book.save(tmp_path / "u.xlsx")
    assert [(r["ticker"], r["price"]) for r in files.load_sheet(files.read_sheet(spark, str(tmp_path / "u.xlsx"))).collect()] == [("OIL", 2.5)]


def test_panel_layout_and_reuse(spark, tmp_path):
    df = spark.createDataFrame([("A", D(2023, 12, 29), 1.0), ("A", D(2024, 1, 2), 2.0)], "ticker string, date date, adj_close double").withColumn("year", F.year("date"))
    files.write_panel(df, str(tmp_path / "p"))
    got = files.read_panel(spark, str(tmp_path / "p"), ["ticker", "adj_close", "absent"], [D(2024, 1, 2)])
    assert [tuple(r) for r in got.collect()] == [("A", 2.0)]
    made = []
    for _ in range(2):
        files.reuse(spark, str(tmp_path / "q"), lambda: made.append(1) or df)
    assert made == [1]


def test_live_snapshot(spark):
    s = spark.createDataFrame
    universe = s([("GOOG",), ("GOOGL",), ("GONE",)], "ticker string")
    prices = s([(t, d, 100.0 + i, 100.0 + i, 150.0, 50.0) for t in ("GOOG", "GOOGL") for i, d in enumerate(days(3))], "ticker string, date date, close double, adj_close double, high_52w double, low_52w double")
    calcs = s([("GOOGL", "FY", "2024-02-01", None, "25", "8", "0.3"), ("GOOGL", "FY", "2024-05-01", None, "28", "8", "0.4")], "ticker string, fiscal_period string, filing_date string, first_calculable_at string, pricetoearnings string, freecashflow string, roe string")
    income = s([("GOOGL", "2024", f"Q{q}", "10", "") for q in (1, 2, 3, 4)], "ticker string, fiscal_year string, fiscal_period string, totalrevenue string, filing_date string")
    companies = s([("GOOGL", "Alphabet", "Media")], "ticker string, name string, industry_group_name string")
    frame, excluded = live.build_live(universe, companies, prices, calcs, income, s([("Media", "tech")], "group string, sector string"), bench=None)
    out = {r["ticker"]: r for r in frame.collect()}
    assert set(out) == {"GOOG", "GOOGL"} and [r[0] for r in excluded.collect()] == ["GONE"]
    assert out["GOOG"]["pe_ratio"] == 28.0 and out["GOOG"]["fcf_margin"] == pytest.approx(0.2) and out["GOOG"]["price"] == 102.0 and out["GOOG"]["last_qtr"] == "Q4 2024"
