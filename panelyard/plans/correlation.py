"""Correlation structure of factors: per-date matrices, Fisher mean, PCA, redundancy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from ..functions.nulls import covariance_corr
from ..functions.xsec import average_rank

MIN_PER_DATE, REDUNDANT = 200, 0.70
#: Values of a date (rows times factors) up to which a task ranks the date in memory, at 16 to 20 bytes each.
CELLS = 100_000_000


def pair_correlations(df: DataFrame, columns: Sequence[str], method: str = "pearson", date: str = "date", least: int = MIN_PER_DATE, cells: int = CELLS) -> DataFrame:
    """date, factor_a, factor_b, corr (a < b) of complete pairs, on dates of at least ``least`` rows.

    Pearson: every pair is a few sums over the date's rows, so all pairs are one aggregation of the
    wide frame and no row is multiplied.  Spearman: see ``_spearman``.
    """
    cols = sorted(columns)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    if method != "pearson":
        return _spearman(df, cols, date, least, cells)
    aggs = [F.when(F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)) >= least, covariance_corr(a, b)).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]
    wide = df.groupBy(date).agg(F.count(F.lit(1)).alias("__n"), *aggs).filter(F.col("__n") >= least)
    return _long(wide, pairs, [date]).filter(F.col("corr").isNotNull())


def _long(wide: DataFrame, pairs: Sequence[tuple[str, str]], keys: Sequence[str]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(a).alias("factor_a"), F.lit(b).alias("factor_b"), F.col(f"p{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])
    return wide.select(*keys, F.explode(rows).alias("x")).select(*keys, "x.*")


def null_classes(df: DataFrame, columns: Sequence[str], date: str = "date", least: int = MIN_PER_DATE) -> DataFrame:
    """date, classes: for each column the first one that is null on the same rows of the date. Dates of fewer than ``least`` rows are left out."""
    differ = [[F.max(F.col(a).isNull() != F.col(b).isNull()).alias(f"d{i}_{j}") for j, b in enumerate(columns[:i])] for i, a in enumerate(columns)]
    wide = df.groupBy(date).agg(F.count(F.lit(1)).alias("__n"), *[c for row in differ for c in row]).filter(F.col("__n") >= least)
    first = []
    for i in range(len(columns)):
        c = F.lit(i)
        for j in reversed(range(i)):
            c = F.when(~F.col(f"d{i}_{j}"), F.lit(j)).otherwise(c)
        first.append(c)
    return wide.select(date, F.array(*first).alias("classes"))


def _spearman(df: DataFrame, cols: Sequence[str], date: str, least: int, cells: int) -> DataFrame:
    """Rank correlations of complete pairs, each date's in one task by columns; dates of more than ``cells`` values by windows, which spill.

    Rows are exchanged once by date and not multiplied.  Rows per date are counted first: a row for each date comes to the driver.
    """
    df = df.filter(F.col(date).isNotNull())
    counts = {r[0]: r[1] for r in df.groupBy(date).count().filter(F.col("count") >= least).collect()}
    large = [d for d, n in counts.items() if n * len(cols) > cells]
    schema = StructType().add(date, df.schema[date].dataType).add("factor_a", StringType()).add("factor_b", StringType()).add("corr", DoubleType())

    def ranked(key: tuple[pa.Scalar], rows: pa.Table) -> pa.Table:
        found = list(_rank_correlations(rows, cols, least)) if rows.num_rows >= least else []
        names = [pa.array([f[i] for f in found], pa.string()) for i in (0, 1)]
        return pa.table([pa.array([key[0].as_py()] * len(found), key[0].type), *names, pa.array([f[2] for f in found], pa.float64())], names=schema.names)

    small = df.filter(~F.col(date).isin(large)) if large else df
    out = small.select(date, *[F.col(c).cast("double").alias(c) for c in cols]).groupBy(date).applyInArrow(ranked, schema)
    return out.unionByName(_spearman_by_windows(df.filter(F.col(date).isin(large)), cols, date, least)) if large else out


def _centred_ranks(x: np.ndarray) -> np.ndarray:
    """Twice the average rank less its mean, n + 1: whole numbers. NaNs are ties, above all others."""
    order = np.argsort(x)
    x = x[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) & ~(np.isnan(x[1:]) & np.isnan(x[:-1]))
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(x))
    out = np.empty(len(x))
    out[order] = np.repeat((starts + ends - len(x)).astype(float), ends - starts)
    return out


def _rank_correlations(rows: pa.Table, cols: Sequence[str], least: int):
    """(factor_a, factor_b, corr) of one date. Factors with equal null patterns are a class; all pairs of two classes share their complete rows and ranks."""
    classes: list[tuple[np.ndarray, list[int]]] = []
    for i, c in enumerate(cols):
        there = rows[c].is_valid().to_numpy()
        own = next((own for mask, own in classes if np.array_equal(mask, there)), None)
        if own is None:
            classes.append((there, [i]))
        else:
            own.append(i)

    def ranks(i: int, mask: np.ndarray) -> tuple[np.ndarray, float]:
        r = _centred_ranks(rows[cols[i]].fill_null(0.0).to_numpy()[mask])
        return r, float(np.sqrt(r @ r))

    for a, (mask, some) in enumerate(classes):
        for b, (other, rest) in enumerate(classes[a:], a):
            both = mask & other
            if int(both.sum()) < least:
                continue
            held = {i: ranks(i, both) for i in some}
            for j in rest:
                y, sy = held[j] if a == b else ranks(j, both)
                for i in some:
                    x, sx = held[i]
                    if (a != b or i < j) and sx > 0 and sy > 0:
                        yield cols[min(i, j)], cols[max(i, j)], float(x @ y) / (sx * sy)


def _spearman_by_windows(df: DataFrame, cols: Sequence[str], date: str, least: int) -> DataFrame:
    """Rank correlations of complete pairs, ranked once for all pairs with the same complete rows.

    The ranks of a pair depend on its complete rows, and these only on where its two factors are null.
    A date's factors fall into classes with equal null patterns; all pairs of two classes (or within one) share
    their complete rows.  So rows are spread over pairs of classes, m (m + 1) / 2 times for m classes: once on dense data,
    where pairs of factors would be k (k - 1) / 2.
    """
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    classes = null_classes(df, cols, date, least)
    distinct = F.array_sort(F.array_distinct("classes"))
    blocks = F.flatten(F.transform(distinct, lambda a: F.transform(F.filter(distinct, lambda b: b >= a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    present = F.array(*[F.col(c).isNotNull() for c in cols])
    rows = df.select(date, *cols, present.alias("__present")).join(F.broadcast(classes.select(date, "classes", blocks.alias("__blocks"))), date)
    mine = F.filter("__blocks", lambda x: F.get("__present", x["a"]) & F.get("__present", x["b"]))
    rows = rows.select(date, *cols, "classes", F.explode(mine).alias("__block")).withColumn("__n", F.lit(1))
    in_block = [F.get("classes", F.lit(i)).isin(F.col("__block.a"), F.col("__block.b")) for i in range(len(cols))]
    rows = rows.withColumns({c: F.when(in_block[i], F.col(c)) for i, c in enumerate(cols)})
    by = [date, "__block"]
    ranked = rows.select(*by, "classes", *[(F.when(F.col(c).isNotNull(), average_rank(c, by)) * 2.0).alias(f"r{i}") for i, c in enumerate(cols)])
    # twice the mean rank is n + 1 in every block, so products and squares are the only sums; a factor whose greatest rank is the mean is constant
    sums = [F.sum(F.col(f"r{i}") * F.col(f"r{j}")).alias(f"c{n}") for n, (i, j) in enumerate(pairs)] + [f(F.col(f"r{i}") * g).alias(f"{x}{i}") for i in range(len(cols)) for x, f, g in (("s", F.sum, F.col(f"r{i}")), ("m", F.max, F.lit(1.0)))]
    wide = ranked.groupBy(*by, "classes").agg(*sums, F.count(F.lit(1)).cast("double").alias("__n")).filter(F.col("__n") >= least)
    n = F.col("__n")
    centre = n * (n + 1) * (n + 1)
    wide = wide.withColumns({f"s{i}": F.when(F.col(f"m{i}") > n + 1, F.sqrt(F.col(f"s{i}") - centre)) for i in range(len(cols))} | {f"c{p}": F.col(f"c{p}") - centre for p in range(len(pairs))})
    own = [F.array_sort(F.array(F.get("classes", F.lit(i)), F.get("classes", F.lit(j)))) == F.array(F.col("__block.a"), F.col("__block.b")) for i, j in pairs]
    wide = wide.select(date, *[F.when(own[n], F.try_divide(f"c{n}", F.col(f"s{i}") * F.col(f"s{j}"))).alias(f"p{n}") for n, (i, j) in enumerate(pairs)])
    return _long(wide, [(cols[i], cols[j]) for i, j in pairs], [date]).filter(F.col("corr").isNotNull())


def fisher_mean(corr: DataFrame) -> DataFrame:
    """factor_a, factor_b, corr: mean over dates on Fisher's scale."""
    clipped = F.greatest(F.least(F.col("corr"), F.lit(0.9999999)), F.lit(-0.9999999))
    return corr.groupBy("factor_a", "factor_b").agg(F.tanh(F.avg(F.atanh(clipped))).alias("corr"))


def plain_mean(corr: DataFrame) -> DataFrame:
    return corr.groupBy("factor_a", "factor_b").agg(F.avg("corr").alias("corr"))


def ranked_pairs(corr: DataFrame) -> DataFrame:
    return corr.withColumn("abs_corr", F.abs("corr")).orderBy(F.desc("abs_corr"), "factor_a", "factor_b")


def matrix(corr: DataFrame, columns: Sequence[str]):
    """The k x k matrix on the driver; k is the number of factors, some dozens."""
    cols = sorted(columns)
    out = np.eye(len(cols))
    for r in corr.collect():
        i, j = cols.index(r["factor_a"]), cols.index(r["factor_b"])
        out[i, j] = out[j, i] = r["corr"]
    return cols, out


def pca(corr) -> dict:
    """Eigenvalues (descending, none below 0), explained shares, cumulative shares, loadings."""
    values, vectors = np.linalg.eigh(np.asarray(corr, float))
    order = np.argsort(-values)
    values, vectors = np.maximum(values[order], 0.0), vectors[:, order]
    explained = values / values.sum() if values.sum() > 0 else np.zeros_like(values)
    return {"eigenvalues": values, "explained": explained, "cumulative": np.cumsum(explained), "vectors": vectors, "loadings": vectors * np.sqrt(values)}


def effective_dimensions(result: dict, shares: Sequence[float] = (0.8, 0.9)) -> dict[str, int]:
    out = {"kaiser_gt1": int((result["eigenvalues"] > 1).sum())}
    return out | {f"n_pc_{round(100 * s)}pct": int(np.searchsorted(result["cumulative"], s)) + 1 for s in shares}


def redundancy_clusters(columns: Sequence[str], corr, threshold: float = REDUNDANT, priority: Mapping[str, float] | None = None) -> list[dict]:
    """Connected groups of factors with correlation of at least the threshold in size.

    The one to keep has the highest priority (ties: the later name), or without priorities the first
    name.
    """
    unseen, groups = set(range(len(columns))), []
    while unseen:
        group, edge = set(), {min(unseen)}
        while edge:
            group |= edge
            edge = {j for i in edge for j in unseen - group if abs(corr[i][j]) >= threshold}
        unseen -= group
        if len(group) > 1:
            names = sorted(columns[i] for i in group)
            keep = max(names, key=lambda c: (priority.get(c, 0.0), c)) if priority else names[0]
            most = max(abs(float(corr[i][j])) for i in group for j in group if i < j)
            groups.append({"members": names, "keep": keep, "drop": [c for c in names if c != keep], "max_abs_corr": most})
    return sorted(groups, key=lambda g: -g["max_abs_corr"])


def recursive_clusters(corr: DataFrame, threshold: float = REDUNDANT, priority: Mapping[str, float] | None = None) -> DataFrame:
    """The same from the long table by one recursive query: members (joined by |), keep, max_abs_corr.

    The recursion's only row holds the factors' labels, which become the smallest label nearby and then that
    label's label, so chains halve in each step; it ends when nothing changes.  Nothing comes to the driver.
    """
    spark = corr.sparkSession
    weights = spark.createDataFrame(list((priority or {}).items()), "name string, weight double")
    keep = "max_by(name, struct(coalesce(weight, 0.0D), name))" if priority else "min(name)"
    return spark.sql(
        f"""
        WITH RECURSIVE
        links AS (SELECT factor_a AS a, factor_b AS b, abs(corr) AS c FROM {{corr}} WHERE abs(corr) >= {threshold}),
        both AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        names AS (SELECT sort_array(collect_set(a)) AS names FROM both),
        near AS (SELECT a, collect_set(b) AS bs FROM both GROUP BY a),
        nodes AS (
          SELECT transform(sort_array(collect_list(struct(a, transform(bs, b -> CAST(array_position(names, b) - 1 AS int)) AS js))), x -> x.js) AS near, any_value(size(names)) AS n
          FROM near CROSS JOIN names),
        grow(step, labels, before, near) AS (
          SELECT 0, transform(sequence(1, n), x -> x - 1), CAST(NULL AS array<int>), near FROM nodes WHERE n > 0
          UNION ALL
          SELECT step + 1, transform(nearest, x -> least(x, get(nearest, x))), labels, near
          FROM (SELECT step, labels, near, transform(labels, (x, i) -> least(x, array_min(transform(get(near, i), j -> get(labels, j))))) AS nearest
                FROM grow WHERE before IS NULL OR labels <> before)),
        last AS (SELECT max_by(labels, step) AS labels FROM grow),
        placed AS (SELECT name, get(labels, at) AS label FROM (SELECT posexplode(names) AS (at, name), labels FROM names CROSS JOIN last)),
        heights AS (SELECT label, max(c) AS max_abs_corr FROM links JOIN placed ON a = name GROUP BY label)
        SELECT array_join(sort_array(collect_list(name)), '|') AS members, {keep} AS keep, any_value(max_abs_corr) AS max_abs_corr
        FROM placed LEFT JOIN {{weights}} USING (name) JOIN heights USING (label) GROUP BY label
        """,
        corr=corr,
        weights=weights,
    )


def priority_from_efficacy(report: Mapping[str, Mapping], field: str = "tstat") -> dict[str, float]:
    """Size of the IC t-statistic per factor from an efficacy report."""
    return {f: abs(v[field]) for f, v in report.items() if v.get(field) is not None}
