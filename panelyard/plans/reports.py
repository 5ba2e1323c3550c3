"""Text reports of small results, built on the driver."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def markdown(rows: Sequence[Mapping], columns: Sequence[str] | None = None, digits: int = 4) -> str:
    """A Markdown table; numbers rounded, missing values as a dash."""
    if not rows:
        return "(none)"
    cols = list(columns or rows[0])

    def cell(v) -> str:
        return "-" if v is None or v != v else f"{v:.{digits}f}" if isinstance(v, float) else str(v)

    lines = ["| " + " | ".join(cols) + " |", "|" + "---|" * len(cols)]
    return "\n".join(lines + ["| " + " | ".join(cell(r.get(c)) for c in cols) + " |" for r in rows])


def top_per_group(df: DataFrame, n: int = 5, group: str = "sector", rank: str = "rank", tie: str = "ticker") -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(F.asc_nulls_last(rank), tie))).filter(F.col("__n") <= n).drop("__n")


def newcomers(now: DataFrame, before: DataFrame, key: str = "ticker") -> DataFrame:
    """Keys of the first table that the second lacks, each once."""
    return now.select(key).distinct().join(before.select(key), key, "left_anti")


def shortlist(df: DataFrame, n: int, weights: Mapping[str, float], by: str = "composite", previous: DataFrame | None = None) -> DataFrame:
    """The n best with ``driver``, the sleeve of the largest weighted z, and ``is_new`` against a previous list."""
    have = [s for s in weights if f"z_{s}" in df.columns]
    best = F.greatest(*[F.struct(F.coalesce(F.col(f"z_{s}") * weights[s], F.lit(float("-inf"))).alias("v"), F.lit(s).alias("s")) for s in have]) if len(have) > 1 else F.struct(F.lit(0.0).alias("v"), F.lit(have[0]).alias("s"))
    top = df.orderBy(F.desc_nulls_last(by), "ticker").limit(n).withColumn("driver", best["s"])
    if previous is None:
        return top.withColumn("is_new", F.lit(True))
    return top.join(previous.select("ticker", F.lit(False).alias("__old")).distinct(), "ticker", "left").withColumn("is_new", F.coalesce("__old", F.lit(True))).drop("__old")


def tear_sheet(df: DataFrame, n: int = 5, columns: Sequence[str] = ("ticker", "composite", "rank")) -> str:
    """The best n of each group as fixed-width text."""
    rows = [r.asDict() for r in top_per_group(df, n).orderBy("sector", "rank", "ticker").collect()]
    out, now = [], None
    for r in rows:
        if r["sector"] != now:
            now = r["sector"]
            out += ["", now.replace("_", " ").title(), "".join(f"{c:>14}" for c in columns)]
        out.append("".join(f"{r[c]:>14.4f}" if isinstance(r[c], float) else f"{r[c]!s:>14}" for c in columns))
    return "\n".join(out).strip() + "\n"


def efficacy_report(title: str, ic: DataFrame, spreads: DataFrame | None = None, half_lives: Mapping[str, Mapping] | None = None) -> str:
    """Factor efficacy: IC table by t-statistic, spread table, half-lives."""
    rows = sorted((r.asDict() for r in ic.collect()), key=lambda r: -(abs(r["tstat"]) if r.get("tstat") is not None else -1.0))
    parts = [f"# {title}", "## Rank IC", markdown(rows)]
    if spreads is not None:
        parts += ["## Quantile spreads", markdown([r.asDict() for r in spreads.collect()])]
    if half_lives:
        parts += ["## Half-life", markdown([{"factor": k, **v} for k, v in sorted(half_lives.items())], ["factor", "days", "censored"])]
    return "\n\n".join(parts) + "\n"


def correlation_report(title: str, pairs: DataFrame, pca: Mapping, dimensions: Mapping[str, int], clusters: Sequence[Mapping], top: int = 15) -> str:
    """Correlation structure: strongest pairs, components, redundant groups."""
    shares = [{"pc": i + 1, "eigenvalue": float(v), "explained": float(e), "cumulative": float(c)} for i, (v, e, c) in enumerate(zip(pca["eigenvalues"], pca["explained"], pca["cumulative"], strict=True))]
    groups = [{"members": ", ".join(g["members"]), "keep": g["keep"], "max_abs_corr": g["max_abs_corr"]} for g in clusters]
    return "\n\n".join([f"# {title}", "## Strongest pairs", markdown([r.asDict() for r in pairs.limit(top).collect()]), "## Components", markdown(shares), markdown([dict(dimensions)]), "## Redundant groups", markdown(groups)]) + "\n"
