"""Near-duplicate detection by order MinHash.

Two texts are linked if the edit distance of their words is at most 1 - ``SIMILAR`` of the longer
text; classes are the connected components of the links.  A sketch of a text samples the ``TAKEN``
least of its k-mers (pairs of words, labelled with the number of their earlier occurrences) in a
random order of its own and retains them in text order.  Texts that agree in one of the sketches meet
in a bucket.  With d edits to a text of n words at least n - 2 d of the k-mers are left, so that a
linked pair agrees in a sketch with probability of about (0.6 / 1.4) ** 3 or more, and in none of all with
about ``MISSED`` at most, wherever the edits are; that fixes the number of sketches (65).  Candidates are
verified by a banded alignment.

Texts of at most ``SHORT`` words are too few k-mers for that; they meet by prefix filter instead,
which misses nothing: k-mers are put in one order for all texts, rare ones first, and linked texts share
one of the first n - M + 2 d + 1 (n words; M and d: words and edits of the longer text).

Large groups hardly ever meet as pairs.  Equal texts are one node.  Every text is compared with the
one that is most often the first of its buckets, and the links make classes.  Then, for ``ROUNDS``, each
class of a bucket is compared with the bucket's largest class by one text of either.  What is left in a
bucket of several classes is compared in full inside the tasks, classes apart, each pair in one of its
buckets: the texts of the largest class are dealt over cells of about ``CELL`` texts or ``CELL_WORDS`` words, the others
are sent to all of these and over cells of their own.  So all pairs of a bucket are compared or are
in one class, and only links leave a task.

Defined results: a null text is a class of its own; equal texts are one class, as are texts that
differ in white space only, if they have words; the class id is the smallest doc_id in the class (null if it has none);
repeated rows share their class, as do equal texts with null ids; an empty table gives an empty result.
Texts are named by 64-bit hashes, so among 1e9 distinct texts one pair in 40 such tables is
mistaken for equal.  Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from math import ceil, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, in_arrow, materialize, slices, small, table

SIMILAR = 0.8
#: k-mers in a sketch, and the share of linked pairs that may agree in no sketch.
TAKEN, MISSED = 3, 0.005
#: Words up to which the prefix filter is used in place of sketches.
SHORT = 32
#: Rounds in which classes that share a bucket are compared by one text each.
ROUNDS = 1
#: Texts of the largest class, and of the others, that are compared in one go.
CELL = 512
#: Words of these in one go, beyond which the cells become more.
CELL_WORDS = 1 << 20
#: Rows of a text that one bit set of the alignment covers.
STRETCH = 4096
#: Texts in which k-mers and buckets are counted, how many of the most frequent k-mers are known as
#: such (the order of the rest is by hash: any order is right, a good one makes buckets small), and
#: how often a bucket must occur among these texts to be split.
COUNTED, FREQUENT, HOT = 10_000, 1 << 16, 8
#: Distinct texts that a task remembers, to sketch each once.
SEEN = 200_000
#: k-mers of a text hashed at a time.
CHUNK = 1 << 13

_U = np.uint64

def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        raw = word.encode("utf-8", "surrogatepass")
        self[word] = h = zlib.crc32(raw) | (zlib.adler32(raw) & 0x7FFFFFFF) << 32
        return h


_hash_of = _WordHashes()


def _edits(n: int, least: float) -> int:
    return int((1 - least) * n + 1e-9)


def _k(least: float) -> int:
    """Words of a k-mer: below 0.75 linked texts need not share a pair of words."""
    return 2 if least >= 0.75 else 1


def first(n: int, least: float = SIMILAR) -> int:
    """How many first k-mers of a text of n words count: of these every linked text has one, whatever its length."""
    k = _k(least)
    longest = int(n / least + 1e-9) if least > 0 else n
    return max(n - m + k * _edits(m, least) + 1 for m in {*range(n, min(longest, n + 20) + 1), longest})


def sketches(least: float = SIMILAR) -> int:
    """How many sketches miss no more than ``MISSED`` of the linked pairs."""
    lost = _k(least) * (1 - least)
    return ceil(log(MISSED) / log1p(-(((1 - lost) / (1 + lost)) ** TAKEN)))


def grams(words: Sequence[str], k: int) -> np.ndarray:
    """Hashes of the labelled k-mers."""
    h = _mix(np.fromiter(map(_hash_of.__getitem__, words), np.uint64, len(words)))
    k = min(k, len(h))
    n = len(h) - k + 1
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * _U(0x9E3779B97F4A7C15) + h[i : i + n]
    out = _mix(out)
    order = np.argsort(out, kind="stable")
    ranked = out[order]
    start = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    if len(start) < n:
        seen = np.empty(n, np.uint64)
        seen[order] = np.arange(n, dtype=np.uint64) - np.repeat(start, np.diff(start, append=n)).astype(np.uint64)
        out = out + seen * _U(0xD6E8FEB86659FD93)
    return out


def _slots(g: np.ndarray) -> np.ndarray:
    return (g >> _U(32)).astype(np.int64)


def order_minhash(g: np.ndarray, number: int) -> np.ndarray:
    """Hashes of ``number`` sketches of a text with the labelled k-mers g: the TAKEN least in an order of each sketch, in text order."""
    taken, rows = min(TAKEN, len(g)), np.arange(number)
    factors = _mix(np.arange(1, number + 1, dtype=np.uint64)) | _U(1)
    least, where = np.zeros((number, 0), np.uint64), np.zeros((number, 0), np.int64)
    for at in range(0, len(g), CHUNK):
        hashed = factors[:, None] * g[None, at : at + CHUNK]
        for _ in range(min(taken, hashed.shape[1])):
            place = hashed.argmin(1)
            least, where = np.column_stack([least, hashed[rows, place]]), np.column_stack([where, place + at])
            hashed[rows, place] = _U(0xFFFFFFFFFFFFFFFF)
    if where.shape[1] > taken:
        where = np.take_along_axis(where, np.argsort(least, 1, kind="stable")[:, :taken], 1)
    where.sort(1)
    out = factors
    for i in range(taken):
        out = _mix(out + g[where[:, i]])
    return out.view(np.int64)


@dataclass
class Known:
    """What a sample tells: the slots of frequent k-mers in order, their counts, and hot buckets with their numbers of parts."""

    slots: np.ndarray
    counts: np.ndarray
    hot: dict[int, int]


def rare(words: Sequence[str], known: Known, least: float = SIMILAR) -> np.ndarray:
    """The text's first k-mers."""
    if not words:
        return np.zeros(0, np.int64)
    g = grams(words, _k(least))
    n = first(len(words), least)
    if n < len(g):
        slot, often = _slots(g), np.zeros(len(g), np.int64)
        if len(known.slots):
            at = np.minimum(np.searchsorted(known.slots, slot), len(known.slots) - 1)
            often = np.where(known.slots[at] == slot, known.counts[at], 0)
        g = g[np.lexsort((g, often))[:n]]
    return g.view(np.int64)


def sketched(words: Sequence[str], least: float = SIMILAR) -> np.ndarray:
    """The text's order MinHash sketches; none if only texts of up to SHORT words can be linked to it."""
    if len(words) < int((SHORT + 1) * least):
        return np.zeros(0, np.int64)
    return order_minhash(grams(words, _k(least)), sketches(least))


def _near(stretches: dict[int, int], first: int, last: int) -> int:
    """Bits of rows ``first`` to ``last``, and perhaps of some behind."""
    found = 0
    for c in stretches if len(stretches) < (last - first) // STRETCH + 2 else range(max(0, first) // STRETCH, last // STRETCH + 1):
        at = c * STRETCH - first
        if bits := stretches.get(c):
            found |= bits << at if at >= 0 else bits >> -at
    return found


def distance(a: Sequence, b: Sequence, most: int) -> int:
    """Edit distance of two sequences if it is at most ``most``, else most + 1.

    Bit-parallel within a band of ``most`` cells on either side of the diagonal: bit i of the band
    at column j stands for row j - most + i; the vertical steps of a column are two bit sets.  Memory is
    in proportion to the texts: bit sets as long as a text, one for each of its words, would not be.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return most + 1
    lo, n = 0, len(b)
    while lo < n and a[lo] == b[lo]:
        lo += 1
    end = 0
    while end < n - lo and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[lo : len(a) - end], b[lo : n - end]
    if not b:
        return len(a)
    k, extra = min(most, len(a)), len(a) - len(b)
    short = len(a) <= STRETCH
    rows: dict = {}  # of each word the rows it is in, as bits; of a long text as bits of stretches, which are no longer than a stretch
    for i, x in enumerate(a):
        if short:
            rows[x] = rows.get(x, 0) | 1 << i
        else:
            own = rows.setdefault(x, {})
            own[i // STRETCH] = own.get(i // STRETCH, 0) | 1 << i % STRETCH
    full = (1 << (2 * k + 1)) - 1
    diagonal = 1 << (k + extra)
    plus, minus, dist = full & ~((1 << k) - 1), 0, extra
    for j, x in enumerate(b):  # column j + 1 covers rows j + 1 - k ..
        found = rows.get(x, 0)
        if found and short:
            found = (found >> (j - k) if j >= k else found << (k - j)) & full
        elif found:
            found = _near(found, j - k, j + k) & full
        same = ((((found & plus) + plus) ^ plus) | found | minus) & full
        right_plus, right_minus = (minus | ~(same | plus)) & full, same & plus
        if not same & diagonal:
            dist += 1
            if dist > most:
                return most + 1
        same >>= 1
        plus, minus = (right_minus | ~(same | right_plus)) & full, same & right_plus
    return dist


def similar(a: Sequence[str], b: Sequence[str], least: float = SIMILAR) -> bool:
    most = _edits(max(len(a), len(b)), least)
    return distance(a, b, most) <= most


def _counted(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        for words in map(str.split, b.column("text").to_pylist()):
            found = (np.unique(_slots(grams(words, _k(least)))) if words else np.zeros(0, np.int64), sketched(words, least))
            yield pa.RecordBatch.from_pydict({"bucket": np.repeat([False, True], list(map(len, found))), "name": np.concatenate(found)})


def sample(docs: DataFrame, distinct: int, least: float = SIMILAR) -> Known:
    """Frequent k-mers and buckets of COUNTED texts, chosen by their hashes. docs: node, text."""
    slot = F.pmod("node", F.lit(1 << 20))
    some = docs.filter(slot < int(min(1.0, COUNTED / max(1, distinct)) * (1 << 20)) + 1).dropDuplicates(["node"]).select("text")
    counted = materialize(some.transform(in_arrow, lambda it: _counted(it, least), "bucket boolean, name bigint").groupBy("bucket", "name").count().filter("count > 2"), "counted")
    often = sorted(tuple(r) for r in counted.filter("not bucket").orderBy(F.desc("count"), "name").limit(FREQUENT).select("name", "count").collect())
    hot = counted.filter(F.col("bucket") & (F.col("count") >= HOT)).select("name", "count").collect()  # no more than COUNTED * sketches / HOT
    return Known(np.array([r[0] for r in often], np.int64), np.array([r[1] for r in often], np.int64), {r["name"]: ceil(r["count"] / HOT) for r in hot})


def _keyed(batches: Iterator[pa.RecordBatch], known: Known, least: float) -> Iterator[pa.RecordBatch]:
    """(key, node, n, part) of each text's buckets; every text once in a task."""
    seen: set[int] = set()
    for b in slices(batches):
        own = []
        for node, text in zip(b.column("node").to_pylist(), b.column("text").to_pylist(), strict=True):
            if node in seen:
                continue
            if len(seen) >= SEEN:
                seen.clear()
            seen.add(node)
            words = text.split()
            key = sketched(words, least)
            if len(words) <= SHORT:
                key = np.concatenate([key, rare(words, known, least)])
            own.append((node, len(words), key))
        sizes = [len(key) for _, _, key in own]
        if sum(sizes):
            key = np.concatenate([key for _, _, key in own])
            node = np.repeat(np.array([node for node, _, _ in own], np.int64), sizes)
            parts = np.fromiter((known.hot.get(k, 0) for k in key.tolist()), np.int64, len(key)) if known.hot else np.zeros(len(key), np.int64)
            part = np.where(parts > 0, node % np.maximum(parts, 1) + 1, 0)
            yield pa.RecordBatch.from_pydict({"key": key, "node": node, "n": np.repeat(np.array([n for _, n, _ in own], np.int32), sizes), "part": part.astype(np.int32)})


def _aligned(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        ok = [similar(x.split(), y.split(), least) for x, y in zip(b.column("ta").to_pylist(), b.column("tb").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_pydict({"a": b.column("a"), "b": b.column("b"), "ok": pa.array(ok, pa.bool_())})


def _texts(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, text of the wanted nodes. docs: doc_id, node, text; nodes: node, doc_id (of one of its documents)."""
    ids = materialize(wanted.distinct().join(nodes.select(F.col("node").alias("wn"), F.col("doc_id").alias("wd")), F.col("node") == F.col("wn")).select("wn", "wd"), "participants")
    texts = docs.join(small(ids), (F.col("node") == F.col("wn")) & F.col("doc_id").eqNullSafe(F.col("wd")), "left_semi")
    out = materialize(texts.select("node", "text").dropDuplicates(["node"]), "participant-texts")
    forget(ids)
    return out


def buckets(docs: DataFrame, known: Known, least: float = SIMILAR) -> DataFrame:
    """(key, part, node, n, lo): the texts by bucket, if they are not alone in it; lo is the least (node, n) of the part.

    A hot bucket is dealt in parts, numbered from 1, by node; others are part 0.
    """
    keyed = docs.select("node", "text").transform(in_arrow, lambda it: _keyed(it, known, least), "key bigint, node bigint, n int, part int")
    w = Window.partitionBy("key", "part")
    met = keyed.withColumns({"lo": F.min(F.struct("node", "n")).over(w), "hi": F.max("node").over(w)})
    return met.filter((F.col("lo.node") < F.col("hi")) | (F.col("part") > 0)).select("key", "part", "node", "n", "lo").dropDuplicates(["key", "part", "node"])


def _edits_of(longer: Column, least: float) -> Column:
    return F.floor(longer * F.lit(1 - least) + 1e-9)


def _met(rows: DataFrame, least: float) -> DataFrame:
    """rows: node, n, p (node, n) -> (a, b, na, nb) whose lengths allow a link, the same for a pair whichever way it is met."""
    x, y = F.struct("node", "n"), F.struct("p.node", "p.n")
    met = rows.select(F.greatest(x, y).alias("x"), F.least(x, y).alias("y")).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb"))
    return met.filter((F.col("a") != F.col("b")) & (F.abs(F.col("na") - F.col("nb")) <= _edits_of(F.greatest("na", "nb"), least)))


def _classed(members: DataFrame, roots: DataFrame) -> DataFrame:
    return members.select("key", "node", "n").join(small(roots), "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("class"))


def _open(classes: DataFrame) -> DataFrame:
    """classes: key, class, size, words, rep (node, n) -> the buckets of several classes: key, main (size, class, rep, words), others (texts), other_words."""
    keys = classes.groupBy("key").agg(F.count(F.lit(1)).alias("classes"), F.sum("size").alias("all"), F.sum("words").alias("words"), F.max(F.struct("size", "class", "rep", "words")).alias("main"))
    return keys.filter("classes > 1").select("key", "main", (F.col("all") - F.col("main.size")).alias("others"), (F.col("words") - F.col("main.words")).alias("other_words"))


class _Cell:
    """Texts of one bucket that are compared in one go, as numbers of their words."""

    def __init__(self, key: int):
        self.key, self.rows, self.root, self.numbers = key, [], {}, {}

    def add(self, row: dict) -> None:
        numbers = self.numbers
        row["words"] = array("I", [numbers.setdefault(w, len(numbers)) for w in row.pop("text").split()])
        self.rows.append(row)

    def find(self, c: int) -> int:
        while self.root.get(c, c) != c:
            c = self.root[c]
        return c

    def links(self, least: float) -> Iterator[tuple[int, int]]:
        """(node, node): links between texts of different slots, or of one if it is marked so, that make other classes one."""
        earlier: dict[int, list[int]] = {}
        self.rows.sort(key=lambda r: (r["n"], r["node"]))
        at = 0
        for i, r in enumerate(self.rows):
            while self.rows[at]["n"] < least * r["n"] - 1e-6:
                at += 1
            before = [k for k in r["keys"] if k < self.key]  # buckets that have compared their pairs
            met = set().union(*(earlier.get(k, ()) for k in before))
            for k in before:
                earlier.setdefault(k, []).append(i)
            for j in range(at, i):
                o = self.rows[j]
                if (r["slot"] != o["slot"] or r["within"]) and j not in met and self.find(r["class"]) != self.find(o["class"]) and similar(r["words"], o["words"], least):
                    self.root[self.find(r["class"])] = self.find(o["class"])
                    yield r["node"], o["node"]


def _linked(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and cell: the links found in each cell."""
    cell, now = _Cell(0), None
    for b in slices(batches):
        out: list[tuple[int, int]] = []
        for row in b.to_pylist():
            if now != (row["key"], row["cell"]):
                out += cell.links(least)
                now, cell = (row["key"], row["cell"]), _Cell(row["key"])
            cell.add(row)
        yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})
    out = list(cell.links(least))
    yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


def _parts(texts: Column, n: Column, size: int, words: int) -> Column:
    """Into how many parts texts are dealt, by their number and by their words."""
    return F.greatest(F.lit(1), F.ceil(texts / size), F.ceil(n / words))


def cells(rows: DataFrame, keys: DataFrame, size: int = CELL, words: int = CELL_WORDS) -> DataFrame:
    """rows: key, node, n, class; keys: of _open -> key, cell, slot, within, node, n, class.

    Two texts of a bucket are in one cell, in slots to be compared, exactly once, unless both are
    of the largest class.
    """
    rows = rows.join(keys.select("key", F.col("main.class").alias("main"), _parts(F.col("main.size"), F.col("main.words"), size, words).alias("na"), _parts(F.col("others"), F.col("other_words"), size, words).alias("no")), "key")
    is_main, mixed = F.col("class") == F.col("main"), F.xxhash64("node", "key")
    slot = F.when(is_main, F.pmod(mixed, F.col("na"))).otherwise(F.pmod(mixed, F.col("no")))
    rows = rows.withColumn("slot", slot)
    zero = F.lit(0).cast("bigint")

    def to(cell: Column, slot: Column, within: Column) -> Column:
        return F.struct(cell.cast("bigint").alias("cell"), slot.cast("bigint").alias("slot"), within.alias("within"))

    with_main = F.transform(F.sequence(zero, F.col("na") - 1), lambda i: to(i, F.lit(0), (F.col("no") == 1) & (i == 0)))
    apart = F.transform(F.sequence(zero, F.col("no") - 1), lambda k: to(F.col("na") + F.least(k, F.col("slot")) * F.col("no") + F.greatest(k, F.col("slot")), F.col("slot"), k == F.col("slot")))
    dealt = F.when(is_main, F.array(to(F.col("slot"), F.lit(-1), F.lit(False)))).when(F.col("no") == 1, with_main).otherwise(F.concat(with_main, apart))
    return rows.withColumn("to", F.explode(dealt)).select("key", "to.cell", "to.slot", "to.within", "node", "n", "class")


class _Links:
    """The classes that the links found so far make: ``roots``, (node, root). docs: doc_id, node, text."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, least: float):
        self.docs, self.nodes, self.least = docs, nodes, least
        self.roots = materialize(nodes.filter("false").select("node", F.col("node").alias("root")), "roots")

    def add(self, edges: DataFrame) -> None:
        before, self.roots = self.roots, materialize(components(edges.select("a", "b").union(self.roots.filter("node <> root"))), "roots")
        forget(before)

    def test(self, pairs: DataFrame) -> None:
        """Compares pairs (a, b) by alignment."""
        least = self.least
        pairs = materialize(pairs.select("a", "b").distinct(), "pairs")
        texts = _texts(self.docs, self.nodes, pairs.select(F.col("a").alias("node")).union(pairs.select("b")))
        both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
        aligned = materialize(both.select("a", "b", "ta", "tb").transform(in_arrow, lambda it: _aligned(it, least), "a bigint, b bigint, ok boolean").filter("ok"), "aligned")
        self.add(aligned)
        forget(pairs, texts, aligned)

    def first_star(self, members: DataFrame) -> None:
        """Compares every text with the one that is most often the first of its buckets."""
        tops = members.filter("part > 0").groupBy("key").agg(F.min("lo").alias("p"))
        parts = members.filter("part > 0 and node = lo.node").select("key", "node", "n").join(tops, "key").select("node", "n", "p")
        met = _met(members.select("node", "n", F.col("lo").alias("p")).union(parts), self.least)
        votes = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("votes"))
        self.test(votes.groupBy("a").agg(F.max_by("b", F.struct("votes", "b")).alias("b")))

    def classes(self, members: DataFrame) -> DataFrame:
        """key, class, size, words, rep of every class in every bucket."""
        return materialize(_classed(members, self.roots).groupBy("key", "class").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("words"), F.max(F.struct("node", "n")).alias("rep")), "bucket-classes")

    def class_star(self, members: DataFrame) -> None:
        """Compares each class of a bucket with the largest by one text of either, the two once in all buckets."""
        classes = self.classes(members)
        met = classes.join(_open(classes).select("key", "main"), "key").filter(F.col("class") != F.col("main.class"))
        met = met.select("class", F.col("main.class").alias("other"), F.col("rep.node"), F.col("rep.n"), F.col("main.rep").alias("p"))
        longer = F.greatest("n", "p.n")
        met = met.filter(F.abs(F.col("n") - F.col("p.n")) <= _edits_of(longer, self.least))
        once = met.groupBy("class", "other").agg(F.max(F.struct("node", "n", "p")).alias("x")).select("x.node", "x.n", "x.p")
        self.test(_met(once, self.least))
        forget(classes)

    def rest(self, members: DataFrame) -> None:
        """Compares all that is left of buckets of several classes."""
        least = self.least
        classes = self.classes(members)
        keys = materialize(_open(classes), "open")
        rows = materialize(_classed(members, self.roots).join(keys.select("key"), "key", "left_semi"), "left")
        lists = rows.groupBy("node").agg(F.sort_array(F.collect_set("key")).alias("keys"))  # no more than sketches
        texts = _texts(self.docs, self.nodes, rows.select("node")).join(lists, "node")
        dealt = cells(rows, keys).join(texts, "node").repartition("key", "cell").sortWithinPartitions("key", "cell")
        dealt = dealt.select("key", "cell", "slot", "within", "node", "n", "class", "keys", "text")
        found = materialize(dealt.transform(in_arrow, lambda it: _linked(it, least), "a bigint, b bigint"), "rest")
        self.add(found)
        forget(classes, keys, rows, found)


def links(docs: DataFrame, nodes: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(node, root): the classes of all links, as far as they have several nodes. nodes: node, doc_id (of one of its documents)."""
    found = _Links(docs, nodes, least)
    members = materialize(buckets(docs, sample(docs, nodes.count(), least), least), "members")
    found.first_star(members)
    for _ in range(ROUNDS):
        found.class_star(members)
    found.rest(members)
    forget(members)
    return found.roots


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); the root is the component's least node.

    Alternating stars: each node hands its larger, then its smaller neighbours to its least one.
    Only edges are kept, as written tables; every step is an aggregation and a join.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "edges")
    before = None
    while True:
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
        before = now
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = materialize(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        edges_left = materialize(large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").union(least.select("u", "m")).distinct(), "small-star")
        forget(edges, large)
        edges = edges_left


def classes(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """doc_id, node, class_id per document. docs: doc_id, text."""
    rows = docs.select("doc_id", "text").withColumn("node", F.xxhash64("text"))
    real = rows.filter(F.col("text").isNotNull())
    nodes = materialize(real.groupBy("node").agg(F.min("doc_id").alias("doc_id")), "nodes")
    roots = links(real, nodes, least)
    several = materialize(nodes.join(small(roots), "node").select("node", "doc_id", "root"), "linked")
    ids = materialize(several.groupBy("root").agg(F.min("doc_id").alias("class_id")), "class-ids")
    linked = materialize(several.join(small(ids), "root").select(F.col("node").alias("ln"), "class_id", F.lit(True).alias("several")), "of-class")
    named = materialize(nodes.join(small(linked), F.col("node") == F.col("ln"), "left").select("node", F.when(F.col("several"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id")), "classes")
    forget(nodes, roots, several, ids, linked)
    out = rows.select("doc_id", "node", F.col("text").isNull().alias("none"))
    null = out.filter("none").select("doc_id", F.lit(None).cast("bigint").alias("node"), F.col("doc_id").alias("class_id"))
    return out.filter(~F.col("none")).join(named, "node").select("doc_id", "node", "class_id").union(null)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def keep_first(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """The documents (all columns) without near duplicates: of each class the smallest doc_id stays.

    Rows that repeat both its id and its text are one document; null texts all stay.
    """
    kept = classes(docs, least).filter(F.col("node").isNotNull() & F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("kept_id"), F.col("node").alias("kept_node")).distinct()
    kept = materialize(kept, "kept")
    rows = docs.filter(F.col("text").isNotNull()).select(F.struct("*").alias("row"), "doc_id", F.xxhash64("text").alias("node"))
    real = rows.join(kept, (F.col("node") == F.col("kept_node")) & F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi").dropDuplicates(["doc_id", "node"])
    return real.select("row.*").union(docs.filter(F.col("text").isNull()))
