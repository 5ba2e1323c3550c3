"""Approximate nearest neighbours by a forest of random-projection trees.

Trees are built on the driver from a bounded sample: each node splits its part of the sample at the
median of the projection on the line through two of its points.  For inner products the vectors get
one component more, which brings them all to the same length; queries get a zero there.  Every row is
then put in its leaf of every tree.  A query walks all trees through one priority queue, keyed by
the largest margin by which it lies on the other side of a split on the way, and collects leaves, best
first, until it has so many leaves, or the queue's margin is so large, as the data ask for.  How
many, or how large, is measured: for ``TRIALS`` queries at most the neighbours are found exactly, and the rule (of the
two the one that meets fewer vectors) is set where their queues have reached ``COVER`` of them.  So the share of the
vectors that a query meets is small if they are clustered and large if they have no structure at
all.  The candidates in the leaves are scored exactly, in double precision.

Leaves are laid out in parts of about ``ROOM`` entries, a large leaf over several parts; a query
goes once to each part that holds a leaf of its own.  A part's entries are in memory, its queries are
streamed, so a task is bounded at any number of vectors.

Equal vectors are one entry everywhere, so a vector that a third of the rows share costs no more
than any other.  An entry stands for its ids; a query needs no more than its ``k`` + 1 smallest.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part,
nor do those whose length isn't the most frequent one, nor null ids; rows that repeat an id and its
vector count once; ties go to the smaller id; fewer than ``k`` candidates are all returned; an empty
table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_arrow, materialize, release, table

K, EVERY = 20, 20
#: Bound of the sample the trees are built from, trees, entries per leaf (more, if the sample is too small to split so far).
SAMPLE, TREES, LEAF = 20_000, 4, 256
#: Bound of the queries whose neighbours are found exactly to set the stop rule, as a share of all and as a number, and the share of neighbours it must reach.
TRIAL_SHARE, LEAST_TRIALS, TRIALS, COVER = 0.1, 16, 128, 0.95
#: Entries of a part, queries that go through a part together, found rows held before they are thinned.
ROOM, TOGETHER, HELD = 20_000, 1024, 300_000


@dataclass
class Forest:
    """Complete binary trees; node i of a level is node 2**level - 1 + i of the arrays."""

    depth: int
    lines: np.ndarray  # (trees, nodes, dim + 1)
    cuts: np.ndarray  # (trees, nodes)
    sizes: np.ndarray  # (trees, leaves), entries expected in each leaf
    longest: float  # length that vectors are filled up to
    parts: list[list[tuple[int, int]]]  # of each leaf, numbered tree * leaves + leaf: its first part and how many
    most: int = 1 << 30  # leaves after which a query stops
    farthest: float = np.inf  # margin of the queue beyond which it stops

    def filled(self, x: np.ndarray) -> np.ndarray:
        """Vectors with the component that brings them to the common length."""
        return np.hstack([x, np.sqrt(np.maximum(0.0, self.longest**2 - (x * x).sum(1)))[:, None]])

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(trees, rows): the leaf of each row in each tree."""
        x = self.filled(x)
        out = np.zeros((len(self.lines), len(x)), np.int32)
        for t in range(len(self.lines)):
            for level in range(self.depth):
                node = 2**level - 1 + out[t]
                out[t] = 2 * out[t] + (np.einsum("ij,ij->i", x, self.lines[t, node]) > self.cuts[t, node])
        return out

    def queue(self, q: np.ndarray) -> Iterator[tuple[float, int]]:
        """Margin and number of every leaf in order of the shared queue."""
        q = q / np.linalg.norm(q) * self.longest
        margins = (self.lines[:, :, :-1] @ q - self.cuts).tolist() if self.depth else []
        queue: list[tuple[float, int, int, int]] = [(0.0, t, 0, 0) for t in range(len(self.lines))]
        leaves = self.sizes.shape[1]
        while queue:
            worst, t, level, i = heapq.heappop(queue)
            while level < self.depth:
                m = margins[t][2**level - 1 + i]
                near = 2 * i + (m > 0)
                level += 1
                heapq.heappush(queue, (max(worst, abs(m)), t, level, near ^ 1))
                i = near
            yield worst, t * leaves + i

    def search(self, q: np.ndarray) -> list[int]:
        """Numbers of the leaves up to the stop rule; the first leaf of every tree is always among them."""
        found = []
        for margin, leaf in self.queue(q):
            if margin > 0 and (len(found) >= self.most or margin > self.farthest):
                break
            found.append(leaf)
        return found

    def set_rule(self, queries: np.ndarray, near: list[np.ndarray], cover: float = COVER) -> None:
        """Sets the stop rule from queries and their exact neighbours: the cheaper of a number of leaves and a margin that reach ``cover`` of them."""
        reached: list[tuple[int, float]] = []  # place in the queue and margin at which each neighbour is met
        walks = []
        for q, own in zip(queries, near, strict=True):
            waiting = {}
            for t, row in enumerate(self.leaves(own)):
                for i, leaf in enumerate(row.tolist()):
                    waiting.setdefault(t * self.sizes.shape[1] + leaf, []).append(i)
            met, walk = set(), []
            for place, (margin, leaf) in enumerate(self.queue(q)):
                walk.append((margin, self.sizes.flat[leaf]))
                for i in waiting.get(leaf, ()):
                    if i not in met:
                        met.add(i)
                        reached.append((place + 1, margin))
            walks.append(walk)
        if not reached:
            return
        enough = min(len(reached) - 1, int(np.ceil(cover * len(reached))) - 1)
        most, farthest = sorted(p for p, _ in reached)[enough], sorted(m for _, m in reached)[enough]
        by_number = sum(size for walk in walks for _, size in walk[:most])
        by_margin = sum(size for walk in walks for m, size in walk if m <= farthest)
        if by_number <= by_margin:
            self.most = most
        else:
            self.farthest = farthest


def laid_out(sizes: np.ndarray, room: int = ROOM) -> list[tuple[int, int]]:
    """First part and number of parts of each leaf: leaves follow each other in parts of ``room`` entries, large ones fill several."""
    out, part, used = [], 0, 0.0
    for size in sizes.ravel().tolist():
        if used and used + size > room:
            part, used = part + 1, 0.0
        n = max(1, int(np.ceil(size / room)))
        out.append((part, n))
        part, used = (part + n, 0.0) if n > 1 else (part, used + size)
    return out


def grow(sample: np.ndarray, total: int, longest: float, trees: int = TREES, leaf: int = LEAF, room: int = ROOM) -> Forest:
    """sample: (n, dim) distinct vectors, a bounded part of ``total``."""
    n = len(sample)
    depth = max(0, min(int(np.ceil(np.log2(max(1, total) / leaf))), int(np.log2(max(1, n / 4)))))
    forest = Forest(depth, np.zeros((trees, max(1, 2**depth - 1), sample.shape[1] + 1)), np.zeros((trees, max(1, 2**depth - 1))), np.zeros((trees, 2**depth)), longest, [])
    x = forest.filled(sample)
    for t in range(trees):
        rng = np.random.default_rng(t)
        split = [np.arange(n)]
        for level in range(depth):
            halves = []
            for i, own in enumerate(split):
                node = 2**level - 1 + i
                if len(own) > 1:
                    a, b = rng.choice(own, 2, replace=False)
                    line = x[a] - x[b]
                    line /= max(1e-30, float(np.linalg.norm(line)))
                    p = x[own] @ line
                    forest.lines[t, node], forest.cuts[t, node] = line, np.median(p)
                    halves += [own[p <= forest.cuts[t, node]], own[p > forest.cuts[t, node]]]
                else:
                    halves += [own, own[:0]]
            split = halves
        forest.sizes[t] = [len(own) * total / max(1, n) for own in split]
    forest.parts = laid_out(forest.sizes, room)
    return forest


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), np.float64).reshape(len(flat), -1)


def _exact(batches: Iterator[pa.RecordBatch], queries: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The ``k`` best vectors of a task for each of a few queries."""
    score, x = np.zeros((len(queries), 0)), np.zeros((len(queries), 0, queries.shape[1]))
    for b in batches:
        for a in range(0, b.num_rows, 1024):
            own = _matrix(b.slice(a, 1024).column("vec"))
            both = np.hstack([score, queries @ own.T])
            keep = np.argsort(-both, axis=1, kind="stable")[:, :k]
            held = np.arange(len(queries))[:, None], np.minimum(keep, max(0, score.shape[1] - 1))
            new = own[np.maximum(0, keep - score.shape[1])]
            x = np.where((keep < score.shape[1])[:, :, None], x[held], new) if score.shape[1] else new
            score = np.take_along_axis(both, keep, 1)
    n = score.size
    if n:
        yield pa.RecordBatch.from_pydict({"q": pa.array(np.repeat(np.arange(len(queries), dtype=np.int32), score.shape[1])), "score": pa.array(score.ravel()), "vec": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), queries.shape[1]).cast(pa.list_(pa.float64()))})
    release()


def trials(distinct: DataFrame, forest: Forest, k: int) -> None:
    """Measures the stop rule on a bounded sample of the queries (by a hash of their vectors)."""
    asked = distinct.filter("asked")
    n = asked.count()
    wanted = min(TRIALS, max(LEAST_TRIALS, int(TRIAL_SHARE * n)))
    slot = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(1 << 30))
    drawn = asked.filter(slot < int(min(1.0, 4.0 * wanted / max(1, n)) * (1 << 30))).orderBy(slot, "key").limit(wanted).select("vec").toArrow()
    if not drawn.num_rows:
        return
    queries = _matrix(drawn.column("vec"))
    sent = distinct.sparkSession.sparkContext.broadcast(queries)
    best = distinct.select("vec").transform(in_arrow, lambda it: _exact(it, sent.value, k + 1), "q int, score double, vec array<double>")
    best = best.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec"))).filter(F.col("n") <= k + 1).select("q", "vec").toArrow().sort_by("q")
    at, x = np.asarray(best.column("q")), _matrix(best.column("vec"))
    near = [x[at == i] for i in range(len(queries))]
    forest.set_rule(queries, [own[~(own == q).all(1)][:k] for own, q in zip(near, queries, strict=True)])


#: What is dealt to parts: entries (query false) with their leaf, queries with all leaves they have there.
DEALT = "part int, query boolean, leaf array<int>, key binary, rep bigint, vec array<double>"


def _placed(batches: Iterator[pa.RecordBatch], forest: Forest) -> Iterator[pa.RecordBatch]:
    leaves = forest.sizes.shape[1]
    first, n = np.array(forest.parts, np.int64).T
    for b in batches:
        if not b.num_rows:
            continue
        mixed = _names(b.column("key"))[:, 0]
        for t, where in enumerate(forest.leaves(_matrix(b.column("vec")))):
            leaf = t * leaves + where.astype(np.int64)
            part = first[leaf] + (mixed % n[leaf].astype(np.uint64)).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(leaf) + 1, dtype=np.int32)), pa.array(leaf.astype(np.int32)))
            yield pa.RecordBatch.from_pydict({"part": pa.array(part.astype(np.int32)), "query": pa.array(np.zeros(len(leaf), bool)), "leaf": lists, "key": b.column("key"), "rep": b.column("rep"), "vec": b.column("vec")})


def _sought(batches: Iterator[pa.RecordBatch], forest: Forest) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for a in range(0, b.num_rows, 200):
            some, at, part, leaf = b.slice(a, 200), [], [], []
            for i, q in enumerate(_matrix(some.column("vec"))):
                own: dict[int, list[int]] = {}
                for number in forest.search(q):
                    first, n = forest.parts[number]
                    for p in range(first, first + n):
                        own.setdefault(p, []).append(number)
                at += [i] * len(own)
                part += own
                leaf += own.values()
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_pydict({"part": pa.array(part, pa.int32()), "query": pa.array(np.ones(len(at), bool)), "leaf": pa.array(leaf, pa.list_(pa.int32())), "key": some.column("key").take(take), "rep": some.column("rep").take(take), "vec": some.column("vec").take(take)})


def _names(column: pa.Array) -> np.ndarray:
    """(n, 2) numbers of a column of 16-byte names."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, 2)


def _thin(rows: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """(query, entry, score, rep) -> the ``k`` best entries of each query, ties to the smaller rep; each entry once."""
    q, e, score, rep = (np.concatenate(x) for x in zip(*rows, strict=True))
    order = np.lexsort((e, rep, -score, q))
    q, e, score, rep = q[order], e[order], score[order], rep[order]
    new = np.append(True, (q[1:] != q[:-1]) | (rep[1:] != rep[:-1]) | (score[1:] != score[:-1]))  # a rep is of one vector
    q, e, score, rep = q[new], e[new], score[new], rep[new]
    first = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
    keep = np.arange(len(q)) - np.repeat(first, np.diff(first, append=len(q))) < k
    return q[keep], e[keep], score[keep], rep[keep]


class _Part:
    """The entries of a part, by leaf."""

    def __init__(self, batches: list[pa.RecordBatch]):
        whole = pa.Table.from_batches(batches)
        leaf = np.asarray(whole.column("leaf").combine_chunks().flatten())
        order = np.argsort(leaf, kind="stable")
        self.key, self.rep, self.x = _names(whole.column("key"))[order], np.asarray(whole.column("rep"))[order], _matrix(whole.column("vec"))[order]
        numbers, starts = np.unique(leaf[order], return_index=True)
        self.ranges = {int(n): (a, b) for n, a, b in zip(numbers, starts, np.append(starts[1:], len(leaf)), strict=True)}

    def best(self, queries: pa.RecordBatch, k: int) -> pa.RecordBatch:
        """The ``k`` best entries of each query in its leaves."""
        q, names = _matrix(queries.column("vec")), _names(queries.column("key"))
        asked: dict[int, list[int]] = {}
        for i, leaves in enumerate(queries.column("leaf").to_pylist()):
            for leaf in leaves:
                if leaf in self.ranges:
                    asked.setdefault(leaf, []).append(i)
        rows, held, least = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))], 0, np.full(len(q), -np.inf)
        for leaf, own in asked.items():
            a, b = self.ranges[leaf]
            own_at = np.array(own)
            rough = q[own_at] @ self.x[a:b].T
            if b - a > k:  # what is below the k-th best of the leaf is none of the k best; rounding aside
                kth = -np.partition(-rough, k - 1, axis=1)[:, k - 1]
                least[own_at] = np.maximum(least[own_at], kth - 1e-9 * (1 + np.abs(kth)))
            i, j = np.nonzero(rough >= least[own_at][:, None])
            i, j = own_at[i], j + a
            rows.append((i, j, np.einsum("ij,ij->i", self.x[j], q[i]), self.rep[j]))
            held += len(i)
            if held > HELD:
                rows = [_thin(rows, k)]
                held = len(rows[0][0])
        i, j, score, rep = _thin(rows, k)
        return pa.RecordBatch.from_pydict({"q": pa.array([x.tobytes() for x in names[i]], pa.binary()), "c": pa.array([x.tobytes() for x in self.key[j]], pa.binary()), "rep": pa.array(rep, pa.int64()), "score": pa.array(score, pa.float64())})


def _scored(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part, entries before queries: the best entries of the part for each of its queries."""
    now, entries, part = -1, [], None
    for b in batches:
        number, query = np.asarray(b.column("part")), b.column("query").to_numpy(zero_copy_only=False)
        cut = np.flatnonzero((number[1:] != number[:-1]) | (query[1:] != query[:-1])) + 1
        for lo, hi in zip([0, *cut], [*cut, b.num_rows], strict=True):
            if lo == hi:
                continue
            if number[lo] != now:
                now, entries, part = number[lo], [], None
            if not query[lo]:
                entries.append(b.slice(lo, hi - lo))
                continue
            if part is None and entries:
                part, entries = _Part(entries), []
            for a in range(lo, hi, TOGETHER) if part is not None else ():
                yield part.best(b.slice(a, min(TOGETHER, hi - a)), k)
    release()


def neighbours(vectors: DataFrame, k: int = K, every: int = EVERY, sample: int = SAMPLE, trees: int = TREES, leaf: int = LEAF, room: int = ROOM) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest of every ``every``-th id. vectors: vec_id, embedding."""
    spark = vectors.sparkSession
    out = "query_id bigint, rank int, vec_id bigint, score double"
    vec = F.transform("embedding", lambda v: v.cast("double"))
    fine = F.col("vec").isNotNull() & F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vec", lambda v: v != 0)
    rows = vectors.select("vec_id", vec.alias("vec")).filter(F.col("vec_id").isNotNull() & fine)
    dims = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    if not dims:
        return spark.createDataFrame([], out)
    rows = rows.filter(F.size("vec") == dims[0]["dim"]).withColumn("key", F.unhex(F.md5(F.concat_ws(",", F.col("vec").cast("array<string>")).cast("binary"))))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v * v))
    is_query = F.col("vec_id") % every == 0
    distinct = materialize(rows.groupBy("key").agg(F.min("vec_id").alias("rep"), F.first("vec").alias("vec"), F.max(is_query).alias("asked")), "vectors")
    total, longest = distinct.agg(F.count(F.lit(1)), F.max(norm)).first()
    slot = F.pmod(F.xxhash64("key"), F.lit(1 << 30))
    drawn = distinct.filter(slot < int(min(1.0, sample / total) * (1 << 30))).select("key", "vec").toArrow().sort_by("key")
    grown = grow(_matrix(drawn.column("vec")) if drawn.num_rows else np.zeros((0, dims[0]["dim"])), total, longest, trees, leaf, room)
    if grown.depth:
        trials(distinct, grown, k)
    forest = spark.sparkContext.broadcast(grown)
    own = distinct.select("key", "rep", "vec")
    entries = own.transform(in_arrow, lambda it: _placed(it, forest.value), DEALT)
    asked = distinct.filter("asked").select("key", "rep", "vec").repartition("key").transform(in_arrow, lambda it: _sought(it, forest.value), DEALT)
    parts = max(first + n for first, n in forest.value.parts)
    met = entries.union(asked).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "query")
    met = met.transform(in_arrow, lambda it: _scored(it, k + 1), "q binary, c binary, rep bigint, score double")
    best = met.groupBy("q", "c").agg(F.min("rep").alias("rep"), F.max("score").alias("score"))
    best = best.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "rep"))).filter(F.col("n") <= k + 1)
    ids = rows.select("key", "vec_id")
    members = ids.groupBy("key", "vec_id").agg(F.lit(1)).select("key", "vec_id").withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))).filter(F.col("n") <= k + 1)
    near = best.select("q", "c", "score").join(members.select(F.col("key").alias("c"), "vec_id"), "c")
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).filter(F.col("n") <= k + 1)
    lists = near.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("near"))
    asked_ids = ids.filter(is_query).distinct().select(F.col("key").alias("q"), F.col("vec_id").alias("query_id"))
    found = asked_ids.join(lists, "q").select("query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("near"))
    return found.select("query_id", F.posexplode("near").alias("i", "x")).select("query_id", (F.col("i") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"))
