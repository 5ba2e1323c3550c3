"""Exact quantiles of groups of any size by counting, in several passes.

``percentile`` keeps all distinct values of a group in one buffer, which ends in one task.  Here each pass
draws a mergeable sketch of what lies between two known values, counts exactly how many values are
below and at the sketch's neighbours of the wanted rank, and goes on with the gap that holds
it, unless a neighbour is the value itself.  A pass shrinks the part by two orders of magnitude whatever the distribution, so two or three passes
over a narrow table leave a few thousand values, which are ranked.  All that comes together in one place is a sketch or
at most ``FEW`` values of a group.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..sources.scratch import written

#: Values of a group above which it is selected from by counting.
HOT = 1_000_000
#: Fractions of a pass's sketch, of these how many to each side are counted, its accuracy, and values that are ranked rather than split further.
GRID, MARGIN, ACCURACY, FEW = 256, 2, 4096, 50_000


def _interpolated(values: dict[int, float], p: float, n: int) -> float:
    at = p * (n - 1)
    low, high = math.floor(at), math.ceil(at)
    return values[low] if values[low] == values[high] else (high - at) * values[low] + (at - low) * values[high]


def _narrowed(k: int, part: tuple, counted: list[tuple[float, int, int]]) -> tuple:
    """The part that holds rank k: a split itself, or what lies strictly between two. counted: split, values below it, values up to it."""
    low, high, below, between = part
    for s, less, upto in counted:
        if k < less:
            return low, math.nextafter(s, -math.inf), below, less - below
        if k < upto:
            return s, s, less, upto - less
        low, below, between = math.nextafter(s, math.inf), upto, part[2] + part[3] - upto
    return low, high, below, between


def order_statistics(rows: DataFrame, group: str, x: str, wanted: dict[int, list[int]], sizes: dict[int, int], few: int = FEW) -> dict[int, dict[int, float]]:
    """group -> rank (from 0) -> value. rows: an integer group and a value that is not null; written, as each pass reads it."""
    spark, found = rows.sparkSession, {g: {} for g in wanted}
    parts = {(g, k): (-math.inf, math.inf, 0, sizes[g]) for g, ks in wanted.items() for k in ks}  # lowest, highest, values below, values between
    g, v = F.col("__g"), F.col(x)
    while True:
        large = {t: s for t, s in parts.items() if s[3] > few and s[0] < s[1]}
        if not large:
            break
        by: dict[int, list[tuple[int, int]]] = {}
        for t in sorted(large):
            by.setdefault(t[0], []).append(t)
        most = max(map(len, by.values()))

        def beside(values: dict, kind: str, by: dict = by, most: int = most) -> DataFrame:
            """The rows of the groups beside a list of what ``values`` has for each of their parts."""
            table = [(i, [values[t] for t in ts] + [values[ts[0]]] * (most - len(ts))) for i, ts in by.items()]
            return rows.join(F.broadcast(spark.createDataFrame(table, f"__g int, __s array<array<{kind}>>")), F.col(group) == g)

        grid = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
        between = [F.when(v.between(F.col("__s")[j][0], F.col("__s")[j][1]), v) for j in range(most)]
        sketches = beside({t: list(s[:2]) for t, s in large.items()}, "double").groupBy("__g").agg(*[F.percentile_approx(c, grid, ACCURACY).alias(f"s{j}") for j, c in enumerate(between)]).collect()
        splits = {}
        for r in sketches:
            for j, t in enumerate(by[r["__g"]]):
                share = (t[1] - large[t][2]) / large[t][3] * GRID
                splits[t] = sorted(set(r[f"s{j}"][max(0, math.floor(share - MARGIN)) : min(GRID, math.ceil(share + MARGIN)) + 1]))
        wide = max(map(len, splits.values()))
        at = [(j, i, F.col("__s")[j][i]) for j in range(most) for i in range(wide)]
        counts = [f(c).alias(f"{n}{j}_{i}") for j, i, s in at for n, f, c in (("less", F.count_if, v < s), ("upto", F.count_if, v <= s))]
        for r in beside({t: s + [s[-1]] * (wide - len(s)) for t, s in splits.items()}, "double").groupBy("__g").agg(*counts).collect():
            for j, t in enumerate(by[r["__g"]]):
                parts[t] = _narrowed(t[1], large[t], [(s, r[f"less{j}_{i}"], r[f"upto{j}_{i}"]) for i, s in enumerate(splits[t])])
    rest = []
    for (i, k), (low, high, below, _) in parts.items():
        if low == high:
            found[i][k] = low
        else:
            rest.append((i, k, low, high, k - below))
    if rest:
        table = F.broadcast(spark.createDataFrame(rest, "__g int, __k bigint, __lo double, __hi double, __at bigint"))
        near = rows.join(table, (F.col(group) == g) & v.between(F.col("__lo"), F.col("__hi")))
        near = near.withColumn("__n", F.row_number().over(Window.partitionBy("__g", "__k").orderBy(x)) - 1).filter(F.col("__n") == F.col("__at"))
        for r in near.select("__g", "__k", x).collect():
            found[r["__g"]][r["__k"]] = r[x]
    return found


def exact_quantiles(df: DataFrame, x: str, by: Sequence[str], points: Sequence[float], name: str, hot: int = HOT, few: int = FEW) -> DataFrame:
    """Interpolated quantiles, one row a group, as ``percentile`` gives them; null if a group has no value.

    Groups of up to ``hot`` values go through ``percentile``; larger ones, of which there are few,
    are selected from by counting.
    """
    spark, by = df.sparkSession, list(by)
    narrow = df.select(*by, F.col(x).cast("double").alias("__x"))
    sizes = narrow.groupBy(*by).agg(F.count("__x").alias("__n")).filter(F.col("__n") > hot).collect()
    cold = narrow.groupBy(*by).agg(F.percentile("__x", F.array(*map(F.lit, points))).alias(name))
    if not sizes:
        return cold
    keys = narrow.select(*by).schema
    groups = spark.createDataFrame([(*[r[b] for b in by], i) for i, r in enumerate(sizes)], keys.add("__id", IntegerType()))
    same = [F.col(f"l.{b}").eqNullSafe(F.col(f"r.{b}")) for b in by]
    rows = written(narrow.filter("__x IS NOT NULL").alias("l").join(F.broadcast(groups.alias("r")), same).select("__id", "__x"), "hot-groups")
    n = {i: r["__n"] for i, r in enumerate(sizes)}
    wanted = {i: sorted({f(p * (m - 1)) for p in points for f in (math.floor, math.ceil)}) for i, m in n.items()}
    values = order_statistics(rows, "__id", "__x", wanted, n, few)
    edges = spark.createDataFrame([(i, [_interpolated(v, p, n[i]) for p in points]) for i, v in values.items()], f"__i int, `{name}` array<double>")
    large = groups.join(edges, F.col("__id") == F.col("__i")).select(*by, name)
    small = narrow.alias("l").join(F.broadcast(groups.alias("r")), same, "left_anti")
    return small.groupBy(*by).agg(F.percentile("__x", F.array(*map(F.lit, points))).alias(name)).unionByName(large)
