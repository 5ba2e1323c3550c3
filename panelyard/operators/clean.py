"""Cleaning with quarantine, availability dates, labels, tickers and validation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import number

#: Periods that carry trailing twelve months.
TTM_PERIODS = ("Q1TTM", "Q2TTM", "Q3TTM", "FY")
#: Tickers that the vendor files keep under another share class or name.
TICKER_ALIASES = {"BF-B": "BF-A", "FOX": "FOXA", "GOOG": "GOOGL", "NWS": "NWSA", "MAA": "MAAI"}

#: Names in the index lists.
INDEX_SIZES = {"SP500": 503, "NASDAQ100": 101, "DOW": 30}


def require(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def parse_date(c: str) -> Column:
    """First ten characters as yyyy-MM-dd; NULL if they are no date."""
    return F.try_to_date(F.substring(F.col(c).cast("string"), 1, 10), "yyyy-MM-dd")


def clean_prices(raw: DataFrame, date: str = "DATE", ticker: str = "TICKER", adj_close: str = "ADJ_CLOSE") -> DataFrame:
    """Adds date, ticker, adj_close and quarantine_reason (NULL for good rows).

    Precedence: bad_date, missing_ticker, bad_adj_close (null or not positive).
    """
    require(raw, [date, ticker, adj_close])
    d, t, p = parse_date(date), F.nullif(F.trim(ticker), F.lit("")), number(adj_close)
    reason = F.when(d.isNull(), "bad_date").when(t.isNull(), "missing_ticker").when(p.isNull() | (p <= 0), "bad_adj_close")
    return raw.select(*[c for c in raw.columns if c not in (date, ticker, adj_close)], d.alias("date"), t.alias("ticker"), p.alias("adj_close"), reason.alias("quarantine_reason"))


def split_quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col("quarantine_reason").isNull()).drop("quarantine_reason"), df.filter(F.col("quarantine_reason").isNotNull())


def available_date(filing: str = "filing_date", calculable: str = "first_calculable_at") -> Column:
    """Later of the two dates, or the one that there is."""
    return F.greatest(parse_date(filing), parse_date(calculable))


def keep_ttm(df: DataFrame, period: str = "fiscal_period") -> DataFrame:
    return df.filter(F.col(period).isin(*TTM_PERIODS))


def skipped_periods(df: DataFrame, period: str = "fiscal_period") -> DataFrame:
    return df.filter(~F.coalesce(F.col(period).isin(*TTM_PERIODS), F.lit(False))).groupBy(period).agg(F.count(F.lit(1)).alias("n"))


def clean_vintages(raw: DataFrame, extra: Sequence[str] = ("grossmargin",)) -> DataFrame:
    """TTM rows with available_date and quarantine_reason; template columns that lack are NULL."""
    df = keep_ttm(raw).withColumn("available_date", available_date())
    df = df.withColumns({c: F.lit(None).cast("double") for c in extra if c not in df.columns})
    return df.withColumn("quarantine_reason", F.when(F.col("available_date").isNull(), "no_availability"))


def load_report(raw: DataFrame, cleaned: DataFrame) -> dict[str, int]:
    """rows_in, rows_out and a count per quarantine reason, in one pass over the cleaned rows."""
    counts = {r["quarantine_reason"] or "ok": r["n"] for r in cleaned.groupBy("quarantine_reason").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {"rows_in": sum(counts.values()), "rows_out": counts.pop("ok", 0), **counts}


def slug(c: str) -> Column:
    """Trimmed, lower case, other characters as single underscores; ``unknown`` if nothing remains."""
    s = F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(s, "^_+|_+$", ""), F.lit("")), F.lit("unknown"))


def bulk_ticker(c: str, aliases: Mapping[str, str] = TICKER_ALIASES) -> Column:
    """Dots as hyphens, then the vendor's alias."""
    t = F.replace(F.col(c), F.lit("."), F.lit("-"))
    out = t
    for a, b in aliases.items():
        out = F.when(t == a, b).otherwise(out)
    return out


def map_groups(df: DataFrame, column: str, mapping: DataFrame, out: str = "sector") -> DataFrame:
    """Joins a (group, sector) map by exact text; raises if a value has no entry."""
    joined = df.join(F.broadcast(mapping.select(F.col("group").alias("__g"), F.col("sector").alias(out))), F.col(column) == F.col("__g"), "left").drop("__g")
    lost = [r[0] for r in joined.filter(F.col(out).isNull()).select(column).distinct().limit(5).collect()]
    if lost:
        raise ValueError(f"no sector for {lost}")
    return joined


def explode_aliases(universe: DataFrame, bulk: DataFrame, ticker: str = "ticker") -> DataFrame:
    """Bulk rows once for every universe ticker that reads them."""
    want = universe.select(F.col(ticker).alias("__universe"), bulk_ticker(ticker).alias("__bulk"))
    return bulk.join(want, F.col(ticker) == F.col("__bulk")).drop(ticker, "__bulk").withColumnRenamed("__universe", ticker)


def resolve_tags(columns: Sequence[str], candidates: Mapping[str, Sequence[str]]) -> dict[str, str | None]:
    """First candidate present, ignoring case, per output name."""
    have = {c.lower(): c for c in reversed(columns)}
    return {out: next((have[c.lower()] for c in cs if c.lower() in have), None) for out, cs in candidates.items()}


def quarantine_nonpositive(c: str) -> Column:
    return F.when(F.col(c) > 0, F.col(c))


def price_floor(z: str, price: str, least: float = 5.0) -> Column:
    """z where the price is known and at least ``least``."""
    return F.when(F.col(price) >= least, F.col(z))


def validate(df: DataFrame, required: Sequence[str], key: str = "ticker", price: str = "price") -> dict[str, int]:
    """Raises one ValueError that names every structural problem; returns counts of zeros."""
    problems = [f"missing columns: {', '.join(m)}"] if (m := [c for c in required if c not in df.columns]) else []
    zero_columns = [c for c, t in df.dtypes if t == "double"]
    aggs = [F.count(F.lit(1)).alias("__n")] + [F.sum((F.col(c) == 0).cast("long")).alias(c) for c in zero_columns]
    if key in df.columns:
        aggs.append((F.count(key) - F.count_distinct(key)).alias("__dup"))
    if price in df.columns:
        aggs.append(F.sum(F.col(price).isNull().cast("long")).alias("__no_price"))
    row = df.agg(*aggs).first().asDict()
    if not row["__n"]:
        problems.append("empty")
    if row.get("__dup"):
        problems.append(f"{row['__dup']} duplicate keys")
    if row.get("__no_price"):
        problems.append(f"{row['__no_price']} rows without price")
    if problems:
        raise ValueError("; ".join(problems))
    return {c: row[c] or 0 for c in zero_columns}


def suspicious(df: DataFrame, key: str = "ticker") -> DataFrame:
    """key, field, value, reason of implausible values; fields that lack are skipped."""
    checks = []

    def check(field: str, hit: Column, reason: str) -> None:
        checks.append(F.when(hit, F.struct(F.lit(field).alias("field"), F.col(field).cast("double").alias("value"), F.lit(reason).alias("reason"))))

    for field, most, reason in (("pe_ratio", 200, "P/E > 200"), ("peg_ratio", 20, "PEG > 20"), ("ps_ratio", 50, "P/S > 50")):
        if field in df.columns:
            check(field, F.col(field) > most, reason)
    if "trailing_beta" in df.columns:
        check("trailing_beta", F.abs("trailing_beta") > 3, "|beta| > 3")
    if {"price", "low_52w", "high_52w"} <= set(df.columns):
        check("price", (F.col("price") < F.col("low_52w")) | (F.col("price") > F.col("high_52w")), "outside 52-week range")
    if not checks:
        return df.sparkSession.createDataFrame([], f"{key} {dict(df.dtypes)[key]}, field string, value double, reason string")
    return df.select(key, F.explode(F.array_compact(F.array(*checks))).alias("x")).select(key, "x.field", "x.value", "x.reason")


def coverage(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Share of non-null values per column, long form."""
    wide = df.groupBy(*by).agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns])
    return wide.unpivot(list(by), list(columns), "factor", "coverage")


def membership(lists: Sequence[tuple[str, DataFrame]], key: str = "ticker", sizes: Mapping[str, int] | None = None) -> DataFrame:
    """key and its memberships joined by | in the order of the lists.

    ValueError if a list named in ``sizes`` has another number of rows, or repeats a key.
    """
    for name, df in lists:
        if sizes and name in sizes:
            n, distinct = df.agg(F.count(key), F.count_distinct(key)).first()
            if not n == distinct == sizes[name]:
                raise ValueError(f"{name}: {n} rows, {distinct} keys, not {sizes[name]}")
    every = None
    for i, (name, df) in enumerate(lists):
        part = df.select(key).distinct().select(key, F.struct(F.lit(i).alias("i"), F.lit(name).alias("name")).alias("m"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy(key).agg(F.concat_ws("|", F.transform(F.sort_array(F.collect_list("m")), lambda m: m["name"])).alias("index_membership"))
