"""Quality classifier: naive Bayes support vectors.

Features are indicators of byte n-grams (1 to 4 bytes, hashed).  Each is scaled by the log-ratio of
its smoothed frequencies among good and bad documents, each document is scaled to unit length of its
indicator vector, and a linear hinge-loss model is fitted by dual coordinate descent.  A logistic
curve fitted on a part left out of the descent turns margins into scores.

The model is fitted on the driver on a bounded sample (``PER_CLASS`` documents of each class);
executors reduce the sampled texts to feature numbers first.  Scoring is map-side over whole texts.

Defined results: null and empty texts have no indicators and get the score of a zero margin plus
bias; repeated rows score alike; without labels of both classes every score is 0.5; an empty table
gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, slices, table
from .sampling import sample_ids

#: Hash space of the n-grams, lengths of n-grams, and bytes processed at a time.
SPACE, LENGTHS, CHUNK = 1 << 17, (1, 2, 3, 4), 1 << 20
#: Bound of the sample that the model is fitted on.
PER_CLASS = 1500
#: Smoothing of the class counts, bound of the dual variables, passes of the descent.
SMOOTH, C, PASSES = 1.0, 4.0, 30

SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int"


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


class Features:
    """Distinct hashed n-grams of a text; one reusable bitmap per process."""

    def __init__(self) -> None:
        self.seen = np.zeros(SPACE, bool)

    def of(self, text: str | None) -> np.ndarray:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        seen = self.seen
        for at in range(0, len(raw), CHUNK):
            part = raw[at : at + CHUNK + max(LENGTHS) - 1].astype(np.uint32)
            h = np.zeros(len(part), np.uint32)
            for n in LENGTHS:
                if len(part) < n:
                    break
                h = (h[: len(part) - n + 1] + np.uint32(1)) * np.uint32(0x01000193) ^ (part[n - 1 :] * np.uint32(0x9E3779B1))
                seen[(h ^ h >> np.uint32(15)) & np.uint32(SPACE - 1)] = True
        found = np.flatnonzero(seen)
        seen[found] = False
        return found.astype(np.int32)


@dataclass
class Model:
    weights: np.ndarray  # log-count ratio times hinge weight of each feature
    bias: float
    slope: float
    offset: float

    def score(self, found: np.ndarray) -> float:
        margin = self.bias + float(self.weights[found].sum(dtype=np.float64)) / max(1.0, len(found) ** 0.5)
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -500, 500))))


def descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, passes: int = PASSES, c: float = C) -> tuple[np.ndarray, float]:
    """Hinge loss with a quadratic penalty, by dual coordinate descent; the bias is a feature of 1."""
    rng = np.random.default_rng(0)
    scaled = [ratio[r] / max(1.0, len(r) ** 0.5) for r in rows]
    norm = np.array([float(x @ x) + 1 for x in scaled])
    share = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    w, b, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(y))
    for _ in range(passes):
        for i in rng.permutation(len(y)):
            r, x = rows[i], scaled[i]
            gradient = y[i] * (float(w[r] @ x) + b) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), c * share[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                alpha[i] = new
                w[r] += step * x
                b += step
    return w, b


def calibrate(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic curve through (margin, label) by Newton steps, with smoothed targets."""
    pos, neg = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([((p - t) * margins).sum() + 1e-3 * a, (p - t).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * margins**2).sum() + 1e-3, (v * margins).sum()], [(v * margins).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
    return max(float(a), 1e-3), float(b)


def fit_rows(rows: list[np.ndarray], y: np.ndarray) -> Model:
    if not ((y > 0).any() and (y < 0).any()):
        return Model(np.zeros(SPACE, np.float32), 0.0, 0.0, 0.0)
    count = {s: np.full(SPACE, SMOOTH) for s in (1, -1)}
    for r, s in zip(rows, y, strict=True):
        count[int(s)][r] += 1
    ratio = np.log(count[1] / count[1].sum()) - np.log(count[-1] / count[-1].sum())
    tune = np.arange(len(y)) % 5 == 4
    if not ((y[tune] > 0).any() and (y[tune] < 0).any()):
        tune[:] = False
    w, b = descend([r for r, t in zip(rows, tune, strict=True) if not t], y[~tune], ratio)
    model = Model((w * ratio).astype(np.float32), b, 1.0, 0.0)
    margins = np.array([b + model.weights[r].sum(dtype=np.float64) / max(1.0, len(r) ** 0.5) for r, t in zip(rows, tune, strict=True) if t or not tune.any()])
    model.slope, model.offset = calibrate(margins, y[tune] if tune.any() else y)
    return model


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """docs: doc_id, text. labels: doc_id, quality (1 good, 0 bad). Held-out rows are never read."""
    spark = docs.sparkSession
    labels = labels.select("doc_id", "quality").filter(F.col("quality").isin(0, 1))
    ids = sample_ids(labels.filter(~held_out()), "quality", per_class)
    chosen = [(i, int(g)) for g, own in ids.items() for i in own]
    if not chosen:
        return fit_rows([], np.zeros(0))
    picked = spark.createDataFrame(chosen, "picked bigint, quality int")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Features()
        for b in slices(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "quality": b.column("quality"), "found": pa.array([own.of(x) for x in b.column("text").to_pylist()], pa.list_(pa.int32()))})

    rows = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("picked")).select("doc_id", "text", "quality")
    got = rows.transform(in_arrow, features, "doc_id bigint, quality int, found array<int>").toArrow()
    order = sorted(range(got.num_rows), key=lambda i: (got["doc_id"][i].as_py() * 2654435761 % 2**32, got["doc_id"][i].as_py(), len(got["found"][i])))
    return fit_rows([np.asarray(got["found"][i].values) for i in order], np.array([1 if got["quality"][i].as_py() else -1 for i in order]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted per document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, m = Features(), sent.value
        for b in slices(batches):
            s = [m.score(own.of(x)) for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "score": pa.array(s, pa.float64()), "predicted": pa.array([int(x >= 0.5) for x in s], pa.int32())})

    return docs.select("doc_id", "text", held_out().alias("held_out")).transform(in_arrow, run, SCHEMA)


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents (all columns) that score at least ``threshold``; map-side."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, m = Features(), sent.value
        for b in slices(batches):
            yield b.filter(pa.array([m.score(own.of(x)) >= threshold for x in b.column(at).to_pylist()], pa.bool_()))

    return docs.transform(in_arrow, run, docs.schema)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
