"""Centroid clustering (Lloyd's rounds) with Elkan's bounds, in exact integers.

Every vector keeps its cluster, an upper bound of the distance to that centroid and a lower bound of
the distance to each of the k centroids.  After the centroids have moved, the upper bound grows and
the lower bounds shrink by the way they went.  A distance to a centroid is computed only if neither its
lower bound nor half its distance from the vector's own centroid lies above the upper bound.  Bounds are
floating point and rounded to the safe side; a centroid is passed over only if it is strictly farther,
so ties are always settled by the distances themselves, which are exact integers.

Vectors travel in blocks: one row holds some thousand vectors and their bounds as packed arrays, and
the block's sums per cluster.  A round reads the blocks that the round before wrote to the shared folder and writes
the next, map-side; only the sums, k x (dims + 1) numbers a block, are aggregated, and the driver holds
k centroids.  The tables of earlier rounds are deleted.  Rounds end early once no centroid moves, since further ones
would change nothing.

Defined results: vectors that are null, of another length, or hold null or non-finite components take
no part, nor do those without an id; nor those with a component of ``MOST`` or more in magnitude, whose squared
distances a long couldn't hold; rows that repeat an id are vectors of their own; with fewer vectors than
clusters there are as many clusters as vectors; sums of distances that a long can't hold are null; an
empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, in_arrow, materialize, release, table

K, DIMS, ROUNDS, SCALE, SEED = 8, 64, 10, 1024, 3
#: Components of this magnitude or more: 64 squares of twice 1024 * MOST just fit a long.
MOST = float(1 << 17)
#: Bounds are moved outwards by this share, far above what rounding can do to them.
SLACK = 1e-12

BLOCK = "ids binary, x binary, own binary, upper binary, lower binary, sums array<bigint>"


def _packed(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    """Blocks of scaled integer vectors that have no bounds yet, a block for each batch."""
    for b in batches:
        if b.num_rows:
            x = np.floor(np.asarray(b.column("vec").flatten(), np.float64).reshape(-1, dims) * SCALE).astype(np.int32)
            yield _block(np.asarray(b.column("vec_id")), x, np.zeros(0, np.int32), np.zeros(0), np.zeros(0), [])


def _block(ids, x, own, upper, lower, sums) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({**{n: pa.array([v.tobytes()], pa.binary()) for n, v in (("ids", ids), ("x", x), ("own", own), ("upper", upper), ("lower", lower))}, "sums": pa.array([sums], pa.list_(pa.int64()))})


def exact(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows, as integers."""
    d = x.astype(np.int64) - c
    return np.einsum("ij,ij->i", d, d)


def apart(centroids: np.ndarray) -> np.ndarray:
    """Half the distances between centroids, rounded down."""
    return np.stack([np.sqrt(exact(centroids, c).astype(np.float64)) for c in centroids]) * (0.5 * (1 - SLACK))


def nearest(x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Cluster and tightened bounds of each vector, and how many distances that took."""
    own, upper, lower = own.copy(), upper.copy(), lower.copy()
    rows = np.arange(len(x))
    others = half + np.where(np.eye(len(half), dtype=bool), np.inf, 0.0)
    possible = ~((upper[:, None] < lower) | (upper[:, None] < others[own]))
    possible[rows, own] = False
    at = np.flatnonzero(possible.any(1))
    best = np.zeros(len(x), np.int64)
    best[at] = exact(x[at], centroids[own[at]])
    upper[at] = np.sqrt(best[at].astype(np.float64)) * (1 + SLACK)
    lower[at, own[at]] = upper[at] * (1 - 3 * SLACK)
    computed = len(at)
    for j in range(len(centroids)):
        on = at[(own[at] != j) & ~(upper[at] < lower[at, j]) & ~(upper[at] < half[own[at], j])]
        d = exact(x[on], centroids[j])
        computed += len(on)
        root = np.sqrt(d.astype(np.float64))
        lower[on, j] = root * (1 - SLACK)
        nearer = (d < best[on]) | ((d == best[on]) & (j < own[on]))
        won = on[nearer]
        own[won], best[won], upper[won] = j, d[nearer], root[nearer] * (1 + SLACK)
    return own, upper, lower, computed


def moved(own: np.ndarray, upper: np.ndarray, lower: np.ndarray, way: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds after the centroids went ``way`` (rounded up)."""
    return (upper + way[own]) * (1 + SLACK), np.maximum(0.0, (lower - way) * (1 - SLACK) - way * SLACK)


def sums_of(x: np.ndarray, own: np.ndarray, k: int) -> list[int]:
    """Of each cluster the number of vectors and their componentwise sum."""
    out = np.zeros((k, x.shape[1] + 1), np.int64)
    for j in range(k):
        mine = x[own == j]
        out[j, 0], out[j, 1:] = len(mine), mine.sum(0, dtype=np.int64)
    return out.ravel().tolist()


def _unpacked(b: pa.RecordBatch, i: int, dims: int) -> tuple[np.ndarray, ...]:
    types = {"ids": np.int64, "x": np.int32, "own": np.int32, "upper": np.float64, "lower": np.float64}
    ids, x, own, upper, lower = (np.frombuffer(b.column(n)[i].as_buffer(), t) for n, t in types.items())
    return ids, x.reshape(-1, dims), own, upper, lower.reshape(len(upper), -1) if len(upper) else lower


def _round(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, way: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    k, dims, half = len(centroids), centroids.shape[1], apart(centroids)
    for b in batches:
        for i in range(b.num_rows):
            ids, x, own, upper, lower = _unpacked(b, i, dims)
            if way is None or not len(own):
                own, upper, lower = np.zeros(len(ids), np.int32), np.full(len(ids), np.inf), np.zeros((len(ids), k))
            else:
                upper, lower = moved(own, upper, lower, way)
            own, upper, lower, _ = nearest(x, own, upper, lower, centroids, half)
            yield _block(ids, x, own, upper, lower, sums_of(x, own, k))
    release()


def _distances(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            ids, x, own, _, _ = _unpacked(b, i, centroids.shape[1])
            yield pa.RecordBatch.from_pydict({"vec_id": pa.array(ids), "cluster": pa.array(own), "distance": pa.array(exact(x, centroids[own]))})
    release()


def updated(sums: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Floors of the means; a cluster without vectors keeps its centroid. sums: Python integers, exact at any size."""
    return np.array([[int(s) // int(row[0]) for s in row[1:]] if row[0] else c for row, c in zip(sums.tolist(), centroids.tolist(), strict=True)], np.int64).reshape(centroids.shape)


def cluster(vectors: DataFrame, k: int = K, dims: int = DIMS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 per vector. vectors: vec_id, embedding."""
    spark = vectors.sparkSession
    fine = (F.size("vec") == dims) & F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < MOST))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform("embedding", lambda v: v.cast("double")).alias("vec"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & F.coalesce(fine, F.lit(False)))
    first = rows.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256), "vec").limit(k).collect()
    if not first:
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    centroids = np.floor(np.array([r["vec"] for r in first]) * SCALE).astype(np.int64)
    blocks, way = materialize(rows.transform(in_arrow, lambda it: _packed(it, dims), BLOCK), "vectors"), None
    for turn in range(rounds + 1):
        before, now, went = blocks, centroids, way
        blocks = materialize(before.transform(in_arrow, lambda it, c=now, w=went: _round(it, c, w), BLOCK), "clusters")
        forget(before)
        if turn == rounds:
            break
        found = blocks.select(F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
        sums = np.zeros(now.shape[0] * (dims + 1), object)
        for r in found:
            sums[r["i"]] = int(r["s"])
        centroids = updated(sums.reshape(len(now), -1), now)
        if (centroids == now).all():
            break
        way = np.sqrt(exact(centroids, now).astype(np.float64)) * (1 + SLACK)
    last = centroids
    done = materialize(blocks.transform(in_arrow, lambda it: _distances(it, last), "vec_id bigint, cluster int, distance bigint"), "distances")
    forget(blocks)
    inertia = {r["cluster"]: int(r["d"]) for r in done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    fits = lambda v: v if v < 1 << 63 else None
    total = fits(sum(inertia.values()))
    of = spark.createDataFrame([(j, fits(d), total, hashlib.sha256(",".join(map(str, last[j].tolist())).encode()).hexdigest()) for j, d in inertia.items()], "of int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return done.join(F.broadcast(of), F.col("cluster") == F.col("of")).drop("of")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def oracle(k: int = K, dims: int = DIMS, rounds: int = ROUNDS, seed: int = SEED) -> str:
    """The same by all distances in every round, for DuckDB."""
    steps = [
        f"x0 AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)::BIGINT) AS x FROM embeddings "
        f"WHERE vec_id IS NOT NULL AND len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e) AND abs(e) < {MOST})) = {dims})",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), x) - 1)::INTEGER AS j, x AS c FROM x0 QUALIFY j < {k})",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"a{r} AS MATERIALIZED (SELECT vec_id, x, min((d, j)) AS best FROM (SELECT i, vec_id, x, j, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d "
            f"FROM (SELECT *, row_number() OVER () AS i FROM x0), c{r}) GROUP BY i, vec_id, x)"
        )
        if r < rounds:
            steps.append(
                f"m{r} AS (SELECT j, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY p) AS c FROM (SELECT best[2] AS j, p, sum(x[p])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{r}, range(1, {dims} + 1) t(p) GROUP BY ALL) GROUP BY j), "
                f"c{r + 1} AS MATERIALIZED (SELECT c{r}.j, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (j))"
            )
    return "WITH " + ",\n".join(steps) + (
        f"\nSELECT vec_id, best[2]::INTEGER AS cluster, best[1]::BIGINT AS distance, sum(best[1]) OVER (PARTITION BY best[2])::BIGINT AS cluster_inertia, sum(best[1]) OVER ()::BIGINT AS inertia, "
        f"sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON j = best[2]"
    )


OP11_SQL = oracle()
