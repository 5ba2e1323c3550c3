"""Language identification by a bidirectional gated recurrent network over bytes.

A text is read in windows of ``WINDOW`` bytes.  One gated recurrent layer runs over a window from
the left, one from the right; a softmax over both states labels every byte position, and a
document's probabilities are the mean over all its positions.  The network is trained in numpy by
backpropagation through time on windows of a bounded sample (``PER_LANG`` documents of each
language, whatever their number, ``PER_DOC`` windows of each).

Defined results: a null text or one without letters (Unicode category L) is ``und`` with score 0, as is everything if
there is nothing to learn from; texts are read whole at any length; repeated rows are labelled
alike; an empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, slices, table
from .sampling import sample_ids

WINDOW, HIDDEN, PAD = 64, 16, 256
#: Bounds of the training sample: documents of a language, windows of a document.
PER_LANG, PER_DOC = 160, 16
#: Training: steps, windows in a step, learning rate.
STEPS, BATCH, RATE = 240, 192, 0.02
#: Windows that go through the network together; bounds a task's memory.
TOGETHER = 1024

SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double, n_positions bigint, share_labelled double"
_LETTER = regex.compile(r"\p{L}")


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


@dataclass
class Network:
    """x: input tables (2 directions, gates z, r, n; byte; hidden). u: recurrent (2, 3, H, H). o, c: output."""

    langs: list[str]
    x: np.ndarray
    u: np.ndarray
    o: np.ndarray
    c: np.ndarray

    @classmethod
    def new(cls, langs: list[str], hidden: int = HIDDEN) -> Network:
        rng, f = np.random.default_rng(7), np.float32
        x = rng.normal(0, 0.3, (2, 3, PAD + 1, hidden)).astype(f)
        x[:, :, PAD] = 0
        x[:, 0, PAD] = 40  # z = 1: padding leaves the state as it is
        return cls(langs, x, rng.normal(0, hidden**-0.5, (2, 3, hidden, hidden)).astype(f), rng.normal(0, 0.1, (2 * hidden, len(langs))).astype(f), np.zeros(len(langs), f))

    def states(self, seq: np.ndarray, d: int, keep: bool = False):
        """States after each position of (T, B) bytes, in reading order of direction ``d``."""
        steps, width = seq.shape
        hidden = self.u.shape[-1]
        out = np.empty((steps, width, hidden), np.float32)
        h, zr, n, q, tmp = np.zeros((width, hidden), np.float32), np.empty((2, width, hidden), np.float32), np.empty((width, hidden), np.float32), np.empty((width, hidden), np.float32), np.empty((2, width, hidden), np.float32)
        half_x, half_u = self.x[d, :2] * np.float32(0.5), self.u[d, :2] * np.float32(0.5)  # sigmoid(a) = (1 + tanh(a / 2)) / 2
        kept = []
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            s = seq[t]
            np.take(half_x[0], s, axis=0, out=zr[0], mode="clip")
            np.take(half_x[1], s, axis=0, out=zr[1], mode="clip")
            np.matmul(h, half_u, out=tmp)
            zr += tmp
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            np.matmul(h, self.u[d, 2], out=q)
            np.take(self.x[d, 2], s, axis=0, out=n, mode="clip")
            before = h
            if keep:
                kept.append((t, before, zr.copy(), q.copy()))
            q *= zr[1]
            n += q
            np.tanh(n, out=n)
            np.subtract(before, n, out=q)
            q *= zr[0]
            h = out[t]
            np.add(q, n, out=h)
            if keep:
                kept[-1] += (n.copy(),)
        return (out, kept) if keep else out

    def positions(self, seq: np.ndarray) -> np.ndarray:
        """Probabilities of the languages at every position: (T, B, languages)."""
        hidden = self.u.shape[-1]
        logits = self.states(seq, 0).reshape(-1, hidden) @ self.o[:hidden] + self.states(seq, 1).reshape(-1, hidden) @ self.o[hidden:] + self.c
        logits -= logits.max(1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(1, keepdims=True)
        return logits.reshape(*seq.shape, -1)

    def gradients(self, seq: np.ndarray, lang: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over all positions and its gradients, through time in both directions."""
        hidden = self.u.shape[-1]
        (fwd, kf), (bwd, kb) = self.states(seq, 0, True), self.states(seq, 1, True)
        both = np.concatenate([fwd, bwd], 2).reshape(-1, 2 * hidden)
        logits = both @ self.o + self.c
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(1, keepdims=True)
        real = (seq.ravel() != PAD).astype(np.float32)
        where, target = np.arange(len(p)), np.tile(lang, len(seq))
        loss = float(-(np.log(p[where, target] + 1e-9) * real).sum() / real.sum())
        p[where, target] -= 1
        p *= (real / real.sum())[:, None]
        do, dc = both.T @ p, p.sum(0)
        dboth = (p @ self.o.T).reshape(*seq.shape, 2 * hidden)
        dx, du = np.zeros_like(self.x), np.zeros_like(self.u)
        flat = seq.ravel()
        for d, kept in ((0, kf), (1, kb)):
            u, dh_next = self.u[d], np.zeros((seq.shape[1], hidden), np.float32)
            gate = np.zeros((3, *seq.shape, hidden), np.float32)
            for t, hp, zr, q, n in reversed(kept):
                dh = dboth[t, :, d * hidden : (d + 1) * hidden] + dh_next
                z, r = zr
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (hp - n) * z * (1 - z)
                dr = dn * q * r * (1 - r)
                dq = dn * r
                dh_next = dh * z + dq @ u[2].T + dz @ u[0].T + dr @ u[1].T
                du[d, 0] += hp.T @ dz
                du[d, 1] += hp.T @ dr
                du[d, 2] += hp.T @ dq
                gate[0, t], gate[1, t], gate[2, t] = dz, dr, dn
            for g in range(3):
                own = gate[g].reshape(-1, hidden)
                for k in range(hidden):
                    dx[d, g, :, k] = np.bincount(flat, own[:, k], PAD + 1)
        dx[:, :, PAD] = 0
        return loss, [dx, du, do, dc]


def windows(raw: bytes, size: int = WINDOW) -> np.ndarray:
    """(n, size) bytes, the last window padded; no bytes: no windows."""
    n = -(-len(raw) // size)
    out = np.full(n * size, PAD, np.int16)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out.reshape(n, size)


def train(seqs: np.ndarray, lang: np.ndarray, langs: list[str], steps: int = STEPS, batch: int = BATCH, rate: float = RATE) -> Network:
    """seqs: (n, WINDOW) bytes; lang: their language numbers. Adam; languages are drawn evenly."""
    net = Network.new(langs)
    params = [net.x, net.u, net.o, net.c]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    rng = np.random.default_rng(11)
    by = [np.flatnonzero(lang == k) for k in range(len(langs))]
    for step in range(1, steps + 1):
        rows = np.concatenate([rng.choice(own, max(1, batch // len(langs))) for own in by])
        _, grads = net.gradients(np.ascontiguousarray(seqs[rows].T), lang[rows])
        scale = min(1.0, 1.0 / (1e-9 + float(np.sqrt(sum(float((g * g).sum()) for g in grads)))))
        lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for p, g, a, b in zip(params, grads, m, v, strict=True):
            g = g * scale
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= (lr * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def fit(docs: DataFrame, per_lang: int = PER_LANG, per_doc: int = PER_DOC, steps: int = STEPS) -> Network:
    """docs: doc_id, text, lang. Held-out rows and rows without lang are never read."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", "lang").filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    ids = sample_ids(rows.select("doc_id", "lang"), "lang", per_lang)
    langs = list(ids)
    chosen = [i for own in ids.values() for i in own]
    if not chosen:
        return Network.new([])
    picked = spark.createDataFrame([(i,) for i in chosen], "picked bigint")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                w = windows(text.encode())
                pick = np.random.default_rng(abs(doc)).permutation(len(w))[:per_doc] if len(w) > per_doc else np.arange(len(w))
                out.append(np.where(w[pick] == PAD, 0, w[pick]).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "lang": b.column("lang"), "cut": pa.array(out, pa.binary())})

    got = rows.join(F.broadcast(picked), F.col("doc_id") == F.col("picked")).select("doc_id", "text", "lang").transform(in_arrow, cut, "doc_id bigint, lang string, cut binary").collect()
    seqs, lang = [], []
    for r in sorted(got, key=lambda r: (r["doc_id"], r["lang"], bytes(r["cut"]))):
        if r["lang"] in ids:
            s = np.frombuffer(bytes(r["cut"]), np.uint8).reshape(-1, WINDOW).astype(np.int16)
            seqs.append(np.where(s == 0, PAD, s))
            lang += [langs.index(r["lang"])] * len(s)
    return train(np.concatenate(seqs), np.array(lang), langs, steps)


def label(texts: list[str | None], net: Network) -> Iterator[tuple[str, float, int, float]]:
    """lang, score, positions and the share of positions that bear the document's label, per text."""
    k = len(net.langs)
    sums, votes, sizes = np.zeros((len(texts), max(k, 1))), np.zeros((len(texts), max(k, 1))), np.zeros(len(texts), np.int64)
    queue: list[tuple[int, np.ndarray]] = []
    waiting = 0

    def flush() -> None:
        nonlocal queue, waiting
        seq = np.concatenate([w for _, w in queue])
        owner = np.repeat([i for i, _ in queue], [len(w) for _, w in queue])
        real = (seq != PAD).T
        p = net.positions(np.ascontiguousarray(seq.T, np.intp))
        p *= real[:, :, None]
        np.add.at(sums, owner, p.sum(0))
        best = p.argmax(2)
        for j in range(k):
            np.add.at(votes[:, j], owner, ((best == j) & real).sum(0))
        queue, waiting = [], 0

    for i, text in enumerate(texts):
        if not k or not text or not _LETTER.search(text):
            continue
        raw = text.encode()
        sizes[i] = len(raw)
        step = TOGETHER * WINDOW
        for at in range(0, len(raw), step):
            w = windows(raw[at : at + step])
            if waiting + len(w) > TOGETHER and queue:
                flush()
            queue.append((i, w))
            waiting += len(w)
    if queue:
        flush()
    for i in range(len(texts)):
        if not sizes[i]:
            yield "und", 0.0, 0, 0.0
        else:
            j = int(sums[i].argmax())
            yield net.langs[j], min(1.0, float(sums[i, j] / sizes[i])), int(sizes[i]), float(votes[i, j] / sizes[i])


def identify(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_positions, share_labelled per document. Map-side only."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = list(label(b.column("text").to_pylist(), sent.value))
            lang, score, n, share = zip(*got, strict=True) if got else ((), (), (), ())
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64()), "n_positions": pa.array(n, pa.int64()), "share_labelled": pa.array(share, pa.float64())})

    return docs.select("doc_id", "text", held_out().alias("held_out")).transform(in_arrow, run, SCHEMA)


def keep_known(docs: DataFrame, net: Network, threshold: float = 0.0) -> DataFrame:
    """The documents (all columns) with a language that the network knows, at ``threshold`` or more."""
    sent = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield b.filter(pa.array([lang != "und" and s >= threshold for lang, s, _, _ in label(b.column(at).to_pylist(), sent.value)], pa.bool_()))

    return docs.transform(in_arrow, run, docs.schema)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))
