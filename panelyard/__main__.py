"""Commands: ``python -m panelyard panel|rank|lab|backtest|shortlist --input table.parquet ... --out folder``.

Each reads Parquet tables with the columns that the run of the same name in ``plans.runs`` states, and
writes its small results as CSV, and reports as text, into the folder.  ``panel`` builds a panel from prices and
vintages and writes it by year; it is built again only if its inputs or arguments have changed.
"""

from __future__ import annotations

import argparse
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import panel as panel_ops
from .plans import reports, runs, scoring
from .sources import files, stages


def weights(text: str) -> dict[str, float]:
    """value=0.2,quality=0.3 as a dict."""
    try:
        return {k.strip(): float(v) for k, v in (pair.split("=") for pair in text.split(","))}
    except ValueError:
        raise argparse.ArgumentTypeError(f"not name=number,...: {text}") from None


def rank(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame | str]:
    scored = runs.rank_snapshot(spark.read.parquet(a.input), a.weights, a.asof, a.sigma)
    return {"scores": scored, "top": reports.tear_sheet(scored, a.top)}


def shortlist(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame | str]:
    scored = runs.rank_snapshot(spark.read.parquet(a.input), a.weights, a.asof, a.sigma)
    previous = spark.read.csv(a.previous, header=True) if a.previous else None
    return {"shortlist": reports.shortlist(scored, a.top, a.weights, previous=previous)}


def lab(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame | str]:
    panel = spark.read.parquet(a.input)
    factors = a.factors.split(",") if a.factors else scoring.available_factors(panel)
    bench = spark.read.parquet(a.bench) if a.bench else None
    out = runs.factor_lab(panel, factors, a.returns.split(","), a.least, price=a.price, bench=bench, lags=a.lags, horizons=a.horizons)
    lives = {r["factor"]: {"days": r["days"], "censored": r["censored"]} for r in out["half_life"].collect()}
    return out | {"efficacy": reports.efficacy_report("Factor efficacy", out[f"ic_{a.returns.split(',')[0]}"], out["spreads"], lives)}


def backtest(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame | str]:
    caps = spark.read.parquet(a.caps) if a.caps else None
    return dict(runs.backtest_report(spark.read.parquet(a.input), spark.read.parquet(a.signals), a.bench, caps, a.cost_bps, floor=a.floor))


def panel(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame | str]:
    names = dict(pair.split("=") for pair in a.factors.split(",")) if a.factors else {}

    def build() -> DataFrame:
        tables = [spark.read.parquet(p) for p in (a.input, a.fundamentals, a.revenue, a.companies)]
        return panel_ops.build_panel(*tables, names, a.trailing, a.forward)

    built = stages.reuse(spark, f"{a.out}/panel", build, rebuild=a.rebuild, write=files.write_panel)
    return {"years": built.groupBy("year").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("ticker").alias("tickers")).orderBy("year")}


def numbers(text: str) -> tuple[int, ...]:
    return tuple(map(int, text.split(",")))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="panelyard")
    commands = p.add_subparsers(dest="command", required=True)

    def command(run, text: str) -> argparse.ArgumentParser:
        c = commands.add_parser(run.__name__, help=text)
        c.set_defaults(run=run)
        c.add_argument("--input", required=True)
        c.add_argument("--out", required=True)
        return c

    c = command(panel, "build a panel from prices and vintages")
    for name in ("fundamentals", "revenue", "companies"):
        c.add_argument(f"--{name}", required=True)
    c.add_argument("--factors", default="", help="vendor=panel,... names of fundamentals")
    c.add_argument("--trailing", type=numbers, default=(21, 126, 252))
    c.add_argument("--forward", type=numbers, default=(21, 63))
    c.add_argument("--rebuild", action="store_true")
    for run, text, top in ((rank, "score and rank a snapshot", 5), (shortlist, "the best of a snapshot", 20)):
        c = command(run, text)
        c.add_argument("--weights", type=weights, required=True)
        c.add_argument("--asof")
        c.add_argument("--sigma", type=float, default=3.0)
        c.add_argument("--top", type=int, default=top)
    c.add_argument("--previous", help="CSV of an earlier list")
    c = command(lab, "efficacy of factors on a panel")
    c.add_argument("--factors", default="")
    c.add_argument("--returns", default="ret_fwd_21d,ret_fwd_63d")
    c.add_argument("--least", type=int, default=200)
    c.add_argument("--price")
    c.add_argument("--bench")
    c.add_argument("--lags", type=numbers, default=runs.lab.LAGS)
    c.add_argument("--horizons", type=numbers, default=runs.lab.HORIZONS)
    c = command(backtest, "backtest a composite")
    c.add_argument("--signals", required=True)
    c.add_argument("--bench", required=True, help="the benchmark's ticker")
    c.add_argument("--caps")
    c.add_argument("--cost-bps", type=float, default=10.0)
    c.add_argument("--floor", type=float, default=5.0)
    return p


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("panelyard").getOrCreate()
    os.makedirs(a.out, exist_ok=True)
    for name, result in a.run(spark, a).items():
        if isinstance(result, str):
            with open(f"{a.out}/{name}.md", "w", encoding="utf-8") as f:
                f.write(result)
        else:
            files.write_small_csv(result, f"{a.out}/{name}.csv")


if __name__ == "__main__":
    main()
