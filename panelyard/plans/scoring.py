"""Factor scores, the snapshot composite and the panel composite.

A factor score is a function from a frame (and what its columns hold) to a column, higher = better.
The two composites treat missing values differently on purpose: the snapshot composite counts a
missing z as 0, the panel composite reweighs over the sleeves a row has.
"""

from __future__ import annotations

import hashlib
import warnings
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import number, row_mean, safe_div
from ..functions.xsec import add_group_z, impute_group_median, least_rank

#: Direction of each panel factor (+1: higher is better).
FACTOR_DIRECTION = {
    "ev_ebitda": -1, "earn_yield": 1, "pe": -1, "ps": -1, "pb": -1, "roe": 1, "roa": 1, "profit_margin": 1,
    "gross_margin": 1, "fcf_margin": 1, "debt_to_equity": -1, "fcf": 1, "bvps": 1, "asset_turnover": 1,
    "debt_ebitda": -1, "leverage": -1, "rev_growth": 1, "ebitda_growth": 1, "ebit_growth": 1, "div_yield": 1,
    "interest_coverage": 1, "enterprise_value": 1, "mom_12m1m": 1, "vol_126d": -1, "beta_252d": -1, "noise_raw": 1,
}
#: Factors that are not scored; ratios that are missing unless positive.
DROPPED_FACTORS = ("ev_ebit", "ev_fcff", "ebitda_margin", "market_cap")
QUARANTINE_NONPOSITIVE = ("ev_ebitda", "pe", "ps", "pb")
#: Sleeves, their members and weights in the panel composite.
SLEEVES = {
    "value": ["earn_yield", "ps", "ev_ebitda", "pb"],
    "quality": ["roe", "roa", "gross_margin", "profit_margin", "fcf_margin", "debt_to_equity", "debt_ebitda", "interest_coverage"],
    "growth": ["rev_growth", "ebitda_growth", "ebit_growth"],
    "yield": ["div_yield"],
    "momentum": ["mom_12m1m"],
    "lowvol": ["vol_126d"],
    "size": ["enterprise_value"],
    "noise": ["noise_raw"],
}
SLEEVE_WEIGHTS = {"quality": 0.0, "momentum": 0.2, "value": 0.2, "lowvol": 0.1, "size": 0.0, "growth": 0.0, "noise": 0.0}
#: Snapshot quality metrics, whether higher is better; growth metrics and their fallback.
QUALITY_METRICS = {"roe": True, "roa": True, "gross_margin": True, "profit_margin": True, "fcf_margin": True, "debt_to_equity": False, "debt_to_ebitda": False, "interest_coverage": True}
TTM_GROWTH_METRICS = ("rev_growth", "ebit_growth", "ebitda_growth")
QUARTER_GROWTH_METRICS = ("sales_growth_q", "eps_growth_q")
#: Seed text of the noise control; a parameter of ``noise``.
NOISE_SALT = "panelyard-noise"


def _null() -> Column:
    return F.lit(None).cast("double")


def filled(df: DataFrame, columns: Sequence[str]) -> set[str]:
    """Those of the columns that exist and hold any value: one small aggregate."""
    have = [c for c in columns if c in df.columns]
    if not have:
        return set()
    row = df.agg(*[F.max(F.col(c).isNotNull()).alias(c) for c in have]).first()
    return {c for c in have if row[c]}


def value_parts(df: DataFrame, pe: str = "pe_ratio", ey: str = "earn_yield", ps: str = "ps_ratio", ev: str = "ev_to_ebitda", pb: str = "pb_ratio") -> list[Column]:
    """Earnings yield (negative kept) and the inverses of positive ratios."""
    parts = []
    if ey in df.columns:
        parts.append(F.col(ey))
    elif pe in df.columns:
        parts.append(safe_div(F.lit(1.0), F.when(F.col(pe) > 0, F.col(pe))))
    return parts + [safe_div(F.lit(1.0), F.when(F.col(c) > 0, F.col(c))) for c in (ps, ev, pb) if c in df.columns]


def quality_parts(df: DataFrame) -> list[Column]:
    """The quality metrics that exist, higher = better."""
    have = [c for c in QUALITY_METRICS if c in df.columns]
    if not have:
        warnings.warn("no quality metric present; the sleeve is left out", UserWarning, stacklevel=3)
    return [F.col(c) if QUALITY_METRICS[c] else -F.col(c) for c in have]


def growth_parts(df: DataFrame) -> list[Column]:
    """Trailing growth metrics with any value, else quarterly ones."""
    some = filled(df, [*TTM_GROWTH_METRICS, *QUARTER_GROWTH_METRICS])
    return [F.col(c) for c in [c for c in TTM_GROWTH_METRICS if c in some] or [c for c in QUARTER_GROWTH_METRICS if c in some]]


def _imputed_mean(parts: Sequence[Column], group: str) -> Column:
    return row_mean([impute_group_median(p, [group]) for p in parts]) if parts else _null()


def value_score(df: DataFrame, group: str = "sector", **columns: str) -> Column:
    """Mean of the value parts, each imputed by its group's median first; ``add_scores`` does it without sorting a group."""
    return _imputed_mean(value_parts(df, **columns), group)


def quality_score(df: DataFrame, group: str = "sector") -> Column:
    return _imputed_mean(quality_parts(df), group)


def growth_score(df: DataFrame, group: str = "sector") -> Column:
    return _imputed_mean(growth_parts(df), group)


def momentum_score(df: DataFrame) -> Column:
    if "mom_12_1" in filled(df, ["mom_12_1"]):
        return F.col("mom_12_1")
    return F.col("pct_above_52w_low") if "pct_above_52w_low" in df.columns else _null()


def lowvol_score(df: DataFrame) -> Column:
    return -F.col("vol_126d" if "vol_126d" in df.columns else "trailing_beta")


def size_score(df: DataFrame, ev: str = "enterprise_value") -> Column:
    return F.when(F.col(ev) > 0, F.ln(ev)) if ev in df.columns else _null()


def noise(date: str | Column = "date", entity: str = "ticker", salt: str = NOISE_SALT) -> Column:
    """Standard normal draw per (date, entity) from a hash: order-free, stays in the JVM.

    Two 32-bit pieces of SHA-256 become uniforms, Box and Muller make them normal.
    """
    date = F.col(date) if isinstance(date, str) else date
    text = F.concat_ws("|", F.lit(salt), date.cast("string"), F.col(entity).cast("string"))
    h = F.sha2(text.cast("binary"), 256)

    def uniform(start: int) -> Column:
        return (F.conv(F.substring(h, start, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)

    return F.sqrt(F.lit(-2.0) * F.ln(uniform(1))) * F.cos(F.lit(6.283185307179586) * uniform(9))


def noise_sequence(df: DataFrame, date: str = "date", entity: str = "ticker", salt: str = NOISE_SALT) -> DataFrame:
    """noise_raw as successive numpy normals over the sorted entities of a date.

    The generator's stream is sequential, so a date goes to one Python call (its size is the number
    of entities); the seed is the first eight bytes of SHA-256 of salt|date.
    """
    import numpy as np

    def draw(pdf):
        key = str(pdf[date].iloc[0])[:10]
        rng = np.random.default_rng(int.from_bytes(hashlib.sha256(f"{salt}|{key}".encode()).digest()[:8], "big"))
        pdf = pdf.sort_values(entity, kind="mergesort")
        return pdf.assign(noise_raw=rng.standard_normal(len(pdf)))

    schema = df.select(date, entity).schema.add("noise_raw", "double")
    return df.select(date, entity).groupBy(date).applyInPandas(draw, schema)


FACTORS: dict[str, Callable[..., Column]] = {"value": value_score, "quality": quality_score, "growth": growth_score, "momentum": momentum_score, "lowvol": lowvol_score, "size": size_score}


#: Scores that are means of imputed parts.
PARTS: dict[str, Callable[..., list[Column]]] = {"value": value_parts, "quality": quality_parts, "growth": growth_parts}


def add_scores(df: DataFrame, group: str = "sector") -> DataFrame:
    """All of ``FACTORS`` as columns.

    The medians of every part come from one aggregation by group and a join with its few rows, instead of a
    window that sorts a group in one task for each of the parts.
    """
    parts = {(name, i): p for name, of in PARTS.items() for i, p in enumerate(of(df))}
    at = {k: f"__{k[0]}_{k[1]}" for k in parts}
    rows = df.withColumns({at[k]: p for k, p in parts.items()}) if parts else df
    if parts:
        medians = rows.groupBy(F.col(group).alias("__g")).agg(*[F.median(c).alias(f"{c}_m") for c in at.values()])
        rows = rows.join(F.broadcast(medians), F.col(group).eqNullSafe(F.col("__g")), "left")
    mean = {name: [F.coalesce(at[k], f"{at[k]}_m") for k in at if k[0] == name] for name in PARTS}
    scores = {name: (row_mean(mean[name]) if mean[name] else _null()) if name in PARTS else score(df) for name, score in FACTORS.items()}
    return rows.withColumns(scores).drop("__g", *at.values(), *[f"{c}_m" for c in at.values()])


def snapshot_composite(df: DataFrame, weights: Mapping[str, float], group: str = "sector", sigma: float = 3.0, tie: Sequence[str] = ()) -> DataFrame:
    """z_<sleeve>, composite and rank (1 = best within the group, ties share the least rank).

    Composites that differ by rounding only (nine digits) are ties.  Sleeves without any value are left out and the weights renormalized; a missing z counts as 0.
    """
    active = [s for s in weights if s in filled(df, list(weights))]
    total = sum(weights[s] for s in active)
    if not active or not total:
        raise ValueError("no sleeve with weight has any value")
    out = add_group_z(df, active, [group], sigma)
    score = F.lit(0.0)
    for s in active:
        score = score + F.coalesce(F.col(f"z_{s}"), F.lit(0.0)) * F.lit(weights[s] / total)
    out = out.withColumn("composite", score)
    return out.withColumn("rank", least_rank(F.round("composite", 9), [group]))


def oriented(factor: str, directions: Mapping[str, int] = FACTOR_DIRECTION) -> Column:
    """The factor with higher = better; nonpositive values of certain ratios are missing."""
    sign = directions[factor]
    x = number(factor)
    if factor in QUARANTINE_NONPOSITIVE:
        x = F.when(x > 0, x)
    return x * F.lit(float(sign))


def available_factors(df: DataFrame) -> list[str]:
    return [f for f in FACTOR_DIRECTION if f in df.columns and f not in DROPPED_FACTORS]


def add_panel_z(df: DataFrame, factors: Sequence[str] | None = None, date: str = "date", group: str = "sector", sigma: float = 3.0) -> DataFrame:
    """z_<factor> within (date, group) of every oriented factor."""
    factors = list(factors or available_factors(df))
    return add_group_z(df.withColumns({f: oriented(f) for f in factors}), factors, [date, group], sigma)


def sleeve_column(df: DataFrame, members: Sequence[str]) -> Column:
    return row_mean([f"z_{m}" for m in members if f"z_{m}" in df.columns])


def panel_composite(df: DataFrame, sleeves: Mapping[str, Sequence[str]] = SLEEVES, weights: Mapping[str, float] = SLEEVE_WEIGHTS) -> DataFrame:
    """sleeve_<name> columns and z_composite, reweighed over the sleeves that a row has."""
    if unknown := set(weights) - set(sleeves):
        raise KeyError(f"unknown sleeves: {sorted(unknown)}")
    out = df.withColumns({f"sleeve_{s}": sleeve_column(df, m) for s, m in sleeves.items()})
    top, bottom = F.lit(0.0), F.lit(0.0)
    for s, w in weights.items():
        if w:
            c = F.col(f"sleeve_{s}")
            top, bottom = top + F.coalesce(c * w, F.lit(0.0)), bottom + F.when(c.isNotNull(), w).otherwise(0.0)
    return out.withColumn("z_composite", F.when(bottom > 0, F.try_divide(top, bottom)))


def signal_frame(panel: DataFrame, dates: DataFrame, eligible: DataFrame | None = None, proxies: DataFrame | None = None, factors: Sequence[str] | None = None, sleeves=SLEEVES, weights=SLEEVE_WEIGHTS) -> DataFrame:
    """date, ticker, z_composite, sleeve_*: scores at the given dates for the eligible (date, ticker)."""
    frame = panel.join(F.broadcast(dates.select("date")), "date", "left_semi")
    if eligible is not None:
        frame = frame.join(eligible.select("date", "ticker"), ["date", "ticker"], "left_semi")
    if proxies is not None:
        frame = frame.join(proxies, ["ticker", "date"], "left")
    frame = frame.withColumn("noise_raw", noise())
    scored = panel_composite(add_panel_z(frame, factors), sleeves, weights)
    return scored.select("date", "ticker", "z_composite", *[f"sleeve_{s}" for s in sleeves])


def attributions(df: DataFrame, columns: Mapping[str, str], entity: str = "ticker") -> DataFrame:
    """entity, factor, z of every entity, nulls included. columns: z column -> factor."""
    return df.select(entity, *[F.col(c).alias(f) for c, f in columns.items()]).unpivot([entity], list(columns.values()), "factor", "z")


def attribution(df: DataFrame, key: str, columns: Sequence[str], entity: str = "ticker") -> DataFrame:
    """factor, z of one entity, best first; KeyError if it isn't there."""
    row = df.filter(F.col(entity) == key)
    if row.isEmpty():
        raise KeyError(key)
    return attributions(row, {c: c for c in columns}, entity).orderBy(F.desc_nulls_last("z"), "factor")
