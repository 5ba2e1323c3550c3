"""Document fingerprints by locally consistent parsing.

A text is a string of symbols, first its code points.  Each level cuts the string into phrases and
names every phrase by a hash of its symbols; the names are the next level's symbols.  Cuts come from
deterministic coin tossing: a symbol is compared with its left neighbour, the place and value of
their lowest differing bit replaces it, and after three rounds the labels are so few that local
maxima are close together; a phrase begins at each.  Whether a cut falls at a position depends only
on a few symbols around it, so equal substrings get equal phrases, and equal names at all higher
levels, but for a margin at either end, whatever their offset.  A run of one symbol is a phrase of
its own, named by symbol and length, before the tossing.

A fingerprint is a sketch of the names of levels ``LEVELS``: each name falls into one of ``SLOTS``
slots, which keeps the least hash.  The likeness of two fingerprints is the share of equal slots
among those that either fills; it estimates the Jaccard similarity of the two sets of phrases.

Defined results: a null text counts as empty; an empty text fills no slot, is 1 like another empty
text and 0 like any other; the last document has no next one but the first; with rows that repeat
an id, the one with the smaller text comes first; null ids come before all others; an empty table
gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, slices, table
from .pretoken import blocks

#: Levels whose phrase names are sketched, and slots of the sketch (4 hex digits each).
LEVELS, SLOTS = (2, 3), 64
#: Rounds of coin tossing per level, from 64-bit names to labels below 10.
ROUNDS = 3
EMPTY = 0xFFFF
#: Symbols of one text parsed at a time; longer texts are streamed, with the same result.
BLOCK = 1 << 20
#: Symbols to the left on which the cuts before a position depend, and one more.
CONTEXT = ROUNDS + 2
#: Symbols of several texts parsed in one go.
TOGETHER = 1 << 18
#: Buckets of the order by id; their limits and first ids are all that the driver holds.
MOST_BUCKETS = 1 << 17

SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _names(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hash of each phrase [starts[i], starts[i + 1]): a sum of symbol hashes weighted by place."""
    place = np.arange(1, len(symbols) + 1, dtype=np.uint64)
    place -= np.repeat(starts.astype(np.uint64), np.diff(starts, append=len(symbols)))
    place *= _U(0x9E3779B97F4A7C15)
    place ^= symbols
    place *= _U(0xBF58476D1CE4E5B9)
    place ^= place >> _U(32)
    place *= _U(0x94D049BB133111EB)
    return _mix(np.add.reduceat(place, starts))


def _toss(label: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Twice the place of the lowest bit in which a symbol differs from its left one, plus that bit.

    The first symbol of a text has no left one and takes its successor's label with the bit flipped,
    so neighbours differ again.  Neighbours within a text must differ.
    """
    differ = label[1:] ^ label[:-1]
    below = differ - label.dtype.type(1)
    place = np.bitwise_count(~differ & below)
    out = np.empty(len(label), np.uint8)
    out[1:] = place * np.uint8(2) + (label[1:] & differ & ~below != 0)
    follows = np.minimum(begins + 1, len(label) - 1)
    out[begins] = out[follows] ^ np.uint8(1)
    return out


def _collapse(symbols: np.ndarray, begins: np.ndarray, before: np.uint64 | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Runs become single symbols. before: the symbol to the left of the first one, if there is one."""
    new = np.empty(len(symbols), bool)
    new[0] = True
    np.not_equal(symbols[1:], symbols[:-1], out=new[1:])
    new[begins] = True
    if not new.all():
        starts = np.flatnonzero(new)
        length = np.diff(starts, append=len(symbols))
        run = np.flatnonzero(length > 1)
        begins = np.searchsorted(starts, begins)
        symbols = symbols[starts]
        symbols[run] = _mix(symbols[run] + _mix(length[run].astype(np.uint64)))
        same = np.setdiff1d(np.flatnonzero(symbols[1:] == symbols[:-1]) + 1, begins)  # a chance collision
        symbols[same] = _mix(symbols[same] + _U(1))
    if before is not None and symbols[0] == before:
        symbols[0] = _mix(symbols[0] + _U(1))
    return symbols, begins


def _peaks(symbols: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where phrases begin, but for the ends of texts: at local maxima of the tossed labels."""
    label = symbols
    for _ in range(ROUNDS):
        label = _toss(label, begins)
    peak = np.zeros(len(symbols), bool)
    peak[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    return peak


def level(symbols: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrase names of texts laid end to end, and where each text begins among the names.

    symbols: 64-bit; begins: ascending first positions of the texts, none of which is empty.
    """
    symbols, begins = _collapse(symbols, begins)
    peak, ends = _peaks(symbols, begins), np.append(begins[1:], len(symbols))
    peak[ends - 1] = False
    peak[begins] = True
    for a, b in zip(begins[short := np.flatnonzero(ends - begins < 4)], ends[short], strict=True):
        peak[a + 1 : b] = False  # a single phrase
    starts = np.flatnonzero(peak)
    return _names(symbols, starts), np.searchsorted(starts, begins)


def stream_level(parts: Iterable[np.ndarray]) -> Iterator[np.ndarray]:
    """Phrase names of one text that comes in parts; the same as ``level`` of the whole, in memory of a part.

    The last run of a part waits for the next part, as does the last phrase, with so much
    of what comes before it that the cuts behind it are those of the whole text.
    """
    first = np.zeros(1, np.intp)
    ready, context = np.zeros(0, np.uint64), 0  # collapsed symbols, how many of these are named
    run, length = _U(0), 0  # the open run

    def named(last: bool) -> np.ndarray:
        nonlocal ready, context
        n = len(ready)
        peak = _peaks(ready, first) if n > 1 else np.zeros(n, bool)
        peak[: context + 1] = False
        peak[-1:] = False
        if last and not context and n < 4:
            peak[:] = False
        starts = np.append(context, np.flatnonzero(peak))
        if last:
            return _names(ready[context:], starts - context)
        end = starts[-1]
        out = _names(ready[context:end], starts[:-1] - context) if end > context else np.zeros(0, np.uint64)
        keep = max(0, end - CONTEXT)
        ready, context = ready[keep:], end - keep
        return out

    def closed() -> None:
        """The open run joins the collapsed symbols."""
        nonlocal ready
        symbol = np.array([run], np.uint64)
        if length > 1:
            symbol = _mix(symbol + _mix(np.array([length], np.uint64)))
        if len(ready) and symbol[0] == ready[-1]:
            symbol = _mix(symbol + _U(1))
        ready = np.append(ready, symbol)

    for part in parts:
        if length:
            other = np.flatnonzero(part != run)
            lead = int(other[0]) if len(other) else len(part)
            length, part = length + lead, part[lead:]
        if not len(part):
            continue
        if length:
            closed()
        other = np.flatnonzero(part != part[-1])
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            ready = np.concatenate([ready, _collapse(part[:cut].copy(), first, ready[-1] if len(ready) else None)[0]])
        run, length = part[-1], len(part) - cut
        if len(ready) > 2 * CONTEXT:
            yield named(False)
    if length:
        closed()
    if len(ready) > context:
        yield named(True)


def _put(out: np.ndarray, symbols: np.ndarray, owner: np.ndarray | int, depth: int) -> None:
    """Puts the names of a level in the slots of their texts' sketches."""
    h = _mix(symbols + _U(depth))
    np.minimum.at(out.reshape(-1), owner * SLOTS + (h >> _U(32)).astype(np.intp) % SLOTS, ((h & _U(0xFFFFFFFF)) % _U(EMPTY)).astype(np.uint16))


def _symbols(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + _U(1)


def sketches(texts: list[str], block: int = BLOCK) -> np.ndarray:
    """(texts, SLOTS) 16-bit values; EMPTY where no name fell."""
    out = np.full((len(texts), SLOTS), EMPTY, np.uint16)
    queue: list[np.ndarray] = []
    owner: list[int] = []
    waiting = 0

    def flush() -> None:
        nonlocal waiting
        owns, begins = np.array(owner), np.cumsum([0, *(len(x) for x in queue[:-1])])
        symbols = np.concatenate(queue)
        for depth in range(1, max(LEVELS) + 1):
            symbols, begins = level(symbols, begins)
            if depth in LEVELS:
                _put(out, symbols, np.repeat(owns, np.diff(begins, append=len(symbols))), depth)
        queue.clear()
        owner.clear()
        waiting = 0

    def watched(parts: Iterable[np.ndarray], i: int, depth: int) -> Iterator[np.ndarray]:
        for part in parts:
            _put(out, part, i, depth)
            yield part

    for i, text in enumerate(texts):
        if len(text) > block:
            parts: Iterable[np.ndarray] = (_symbols(text[a : a + block]) for a in range(0, len(text), block))
            for depth in range(1, max(LEVELS) + 1):
                parts = stream_level(parts)
                if depth in LEVELS:
                    parts = watched(parts, i, depth)
            for _ in parts:
                pass
        elif text:
            if waiting and waiting + len(text) > TOGETHER:
                flush()
            queue.append(_symbols(text))
            owner.append(i)
            waiting += len(text)
    if queue:
        flush()
    return out


def fingerprint(text: str) -> np.ndarray:
    return sketches([text])[0]


def to_hex(sketch: np.ndarray) -> str:
    return sketch.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal slots among the filled ones, along the last axis; two empty sketches: 1."""
    filled = (a != EMPTY) | (b != EMPTY)
    n = filled.sum(-1)
    return np.where(n > 0, ((a == b) & filled).sum(-1) / np.maximum(n, 1), 1.0)


def edited(text: str, following: str) -> str:
    """The last half of ``text`` replaced by as much of the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one bucket after another in order; each gets its successor's text.

    Rows with ``own`` false only lend their text to the row before them.
    """
    held: list[tuple] = []  # the last row met: (bucket, doc_id, own, text)
    held_sketch = np.zeros((0, SLOTS), np.uint16)
    for b in slices(batches):
        columns = [b.column(c).to_pylist() for c in ("bucket", "doc_id", "own", "text")]
        columns[3] = [x or "" for x in columns[3]]
        for lo, hi in blocks(columns[3]):
            rows = held + list(zip(*(c[lo:hi] for c in columns), strict=True))
            prints = np.concatenate([held_sketch, sketches(columns[3][lo:hi])])
            held, held_sketch = rows[-1:], prints[-1:]
            at = [i for i in range(len(rows) - 1) if rows[i][2] and rows[i][0] == rows[i + 1][0]]
            changed = [edited(rows[i][3], rows[i + 1][3]) for i in at]
            own, after, new = prints[at], prints[[i + 1 for i in at]], sketches(changed)
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array([rows[i][1] for i in at], pa.int64()),
                "n_chars": pa.array([len(rows[i][3]) for i in at], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in changed], pa.string()),
                "fingerprint": pa.array([to_hex(x) for x in own], pa.string()),
                "edited_fingerprint": pa.array([to_hex(x) for x in new], pa.string()),
                "near_edited": pa.array(likeness(own, new), pa.float64()),
                "near_next": pa.array(likeness(own, after), pa.float64()),
            })


def fingerprints(docs: DataFrame, rows_per_bucket: int = 1000) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The order by id is cut into buckets at quantiles of the ids (narrow passes over the ids alone).
    Every row goes to its bucket, and the first row of a bucket also to the bucket before it in the
    cycle, so each bucket finds all successors in itself: the texts are shuffled once, sorted within
    a task and streamed, whatever the size of a bucket.
    """
    rows = docs.select("doc_id", "text")
    buckets = min(MOST_BUCKETS, max(1, rows.select("doc_id").count() // rows_per_bucket))
    bucket = F.lit(0)
    if buckets > 1:
        cuts = np.array(sorted(set(rows.select("doc_id").approxQuantile("doc_id", [i / buckets for i in range(1, buckets)], 0.2 / buckets))), np.int64)
        bucket = F.when(F.col("doc_id").isNull(), 0).otherwise(_bucket_of(cuts)("doc_id"))
    rows = rows.withColumn("bucket", bucket)
    firsts = rows.groupBy("bucket").agg(F.max(F.col("doc_id").isNull()).alias("some_null"), F.min("doc_id").alias("first")).orderBy("bucket").collect()
    if not firsts:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    # cyclic: the very first row also ends the last bucket
    lists = [(r["bucket"], firsts[i - 1]["bucket"], None if r["some_null"] else r["first"]) for i, r in enumerate(firsts)]
    limits = docs.sparkSession.createDataFrame(lists, "of int, before int, first bigint")  # a row for each bucket
    own = F.struct(F.col("bucket"), F.lit(True).alias("own"))
    loan = F.struct(F.col("before").alias("bucket"), F.lit(False).alias("own"))
    dealt = rows.join(F.broadcast(limits), F.col("bucket") == F.col("of")).withColumn("to", F.explode(F.when(F.col("doc_id").eqNullSafe(F.col("first")), F.array(own, loan)).otherwise(F.array(own))))
    dealt = dealt.select("to.bucket", "doc_id", "to.own", "text").repartitionById(firsts[-1]["bucket"] + 1, F.col("bucket"))
    return dealt.sortWithinPartitions("bucket", F.desc("own"), F.asc_nulls_first("doc_id"), F.asc_nulls_first("text")).transform(in_arrow, _pairs, SCHEMA)


def _bucket_of(cuts: np.ndarray):
    """Number of cuts at most doc_id."""

    @F.arrow_udf("int")
    def bucket(doc_id: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(cuts, doc_id.fill_null(0).to_numpy(zero_copy_only=False), side="right").astype(np.int32))

    return bucket


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))

