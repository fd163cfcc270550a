"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network in numpy.

1. Random indexing over all documents: each word has a sparse ternary index vector (from a hash of the word, in BUCKETS
   buckets: the table goes to every task, so its size must not follow the vocabulary), and a word's vector is the sum of
   its neighbours' index vectors over the whole corpus. Tasks send one row per bucket; the sums are BUCKETS rows
   whatever the corpus. Words of one bucket share a vector, which the frequent ones of them make.
2. Every document is pooled: mean and spread of its words' vectors, and a few shares that order hides.
3. A hidden layer and an output are fitted on a bounded sample of labelled rows (none held out), and a temperature on
   a part of it that the fit did not see.

Defined results: null text is empty text and gets the score of zero features; without labels of both kinds the score is
the share of label 1 (or 1 without any label); equal texts get equal scores.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Cache, cut, gives_back, id_and_text
from .labelled import LABELLED_ROWS, held_out, training_labels

BUCKETS, DIM, NEAR, ACTIVE = 1 << 16, 32, 2, 4
FEATURES = 2 * DIM + 8
BATCH_WORDS = 400_000
_ODD = re.compile(rb"[#*$%&|<>!?]")


def index_vectors() -> np.ndarray:
    """A sparse ternary vector for each bucket, and zeros for the gap between texts (the last row)."""
    rng = np.random.default_rng(11)
    out = np.zeros((BUCKETS + 1, DIM), np.float32)
    at = rng.random((BUCKETS, DIM)).argpartition(ACTIVE, axis=1)[:, :ACTIVE]
    out[np.arange(BUCKETS)[:, None], at] = rng.choice(np.array([-1.0, 1.0], np.float32), (BUCKETS, ACTIVE))
    return out


_BUCKET = Cache(lambda word: zlib.crc32(word) % BUCKETS, 300_000)


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()


def bucket_ids(words: list[bytes]) -> list[int]:
    _BUCKET.age()
    known, miss = _BUCKET.young, _BUCKET.miss
    return [known[w] if w in known else miss(w) for w in words]


@gives_back
def _context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of neighbours' index vectors by bucket, over a whole partition."""
    index = index_vectors()
    sums, counts = np.zeros((BUCKETS + 1, DIM)), np.zeros(BUCKETS + 1)
    held: list[int] = []

    def add() -> None:
        ids = np.array(held, np.int64)
        vectors = index[ids]
        near = np.zeros_like(vectors)
        for shift in range(1, NEAR + 1):
            near[shift:] += vectors[:-shift]
            near[:-shift] += vectors[shift:]
        for d in range(DIM):
            sums[:, d] += np.bincount(ids, near[:, d], BUCKETS + 1)
        counts[:] += np.bincount(ids, minlength=BUCKETS + 1)
        held.clear()

    gap = [BUCKETS] * NEAR
    for batch in batches:
        for text in batch.column("text"):
            held += bucket_ids(words_of(text.as_py()))
            held += gap
            if len(held) >= BATCH_WORDS:
                add()
    if held:
        add()
    used = np.flatnonzero(counts[:-1])
    # whole numbers, so that the totals do not depend on the order in which tasks are added up
    arrays = [pa.array(used), pa.array(counts[used].astype(np.int64)), *(pa.array(np.rint(sums[used, d]).astype(np.int64), pa.int32()) for d in range(DIM))]
    yield pa.RecordBatch.from_arrays(arrays, ["bucket", "n", *(f"v{d}" for d in range(DIM))])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """A unit vector per bucket, from the whole corpus; zeros for unused buckets and the gap."""
    names = [f"v{d}" for d in range(DIM)]
    rows = id_and_text(docs).select("text").mapInArrow(_context, "bucket long, n long, " + ", ".join(f"{n} int" for n in names))
    summed = rows.groupBy("bucket").agg(F.sum("n").alias("n"), *(F.sum(n).alias(n) for n in names)).toPandas()
    out = np.zeros((BUCKETS + 1, DIM))
    at = summed["bucket"].to_numpy(np.int64)
    vectors, counts = summed[names].to_numpy(np.float64), summed["n"].to_numpy(np.float64)
    if len(at):
        mean = vectors.sum(axis=0) / max(1.0, counts.sum())
        vectors = vectors / counts[:, None] - mean  # what sets a word's neighbours apart from any word's
        vectors /= np.maximum(1e-9, np.sqrt((vectors**2).sum(axis=1)))[:, None]
        out[at] = vectors
    return out.astype(np.float32)


def shares(text: str, words: list[bytes], ids: np.ndarray) -> list[float]:
    """What pooling hides: length, variety, repetition and marks."""
    n = max(1, len(words))
    raw = text.encode()
    lines = [x for x in text.split("\n") if x.strip()]
    chars = max(1, len(raw))
    odd = len(_ODD.findall(raw))
    return [
        float(np.log1p(len(words))), len(set(words)) / n**0.85, float((ids[1:] == ids[:-1]).mean()) if len(ids) > 1 else 0.0, float(np.sqrt(odd / chars)),
        len(set(lines)) / max(1, len(lines)), len(lines) / n, chars / n / 10, sum(1 for w in words if len(w) <= 3) / n,
    ]


def _pooled(vectors: np.ndarray):
    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                text = text.as_py()
                words = words_of(text)
                ids = np.array(bucket_ids(words), np.int64)
                if len(ids):
                    x = vectors[ids]
                    mean, spread = x.mean(axis=0, dtype=np.float64), x.std(axis=0, dtype=np.float64)
                else:
                    mean = spread = np.zeros(DIM)
                rows.append(np.r_[mean, spread, shares(text, words, ids)].astype(np.float32))
            flat = np.concatenate(rows) if rows else np.empty(0, np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * FEATURES, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "x"])

    return run


class Network:
    """tanh hidden layer and a logistic output, with scaling of the inputs and a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 40, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.base = float(y.mean()) if len(y) else 1.0
        self.fitted = len(np.unique(y)) == 2
        self.temperature = 1.0
        if not self.fitted:
            return
        order = rng.permutation(len(y))
        apart = max(1, len(y) // 5)
        check, fit = order[:apart], order[apart:]
        if len(np.unique(y[fit])) < 2:
            check, fit = order, order
        self.mean, self.scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-3
        x = self.scaled(x)
        self.w = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.array(0.0)]
        m, v, step = [np.zeros_like(a) for a in self.w], [np.zeros_like(a) for a in self.w], 0
        for epoch in range(epochs):
            mixed = rng.permutation(fit)
            for at in range(0, len(mixed), 128):
                part = mixed[at : at + 128]
                h = np.tanh(x[part] @ self.w[0] + self.w[1])
                error = (1 / (1 + np.exp(-(h @ self.w[2] + self.w[3]))) - y[part]) / len(part)
                back = np.outer(error, self.w[2]) * (1 - h * h)
                gradient = [x[part].T @ back + 1e-3 * self.w[0], back.sum(axis=0), h.T @ error + 1e-3 * self.w[2], error.sum()]
                step += 1
                rate = 0.004 * (1 - epoch / epochs) + 1e-4
                for k, g in enumerate(gradient):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        logits = self.logits(x[check])
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 81))
        losses = [np.logaddexp(0, -(2 * y[check] - 1) * logits / t).mean() for t in grid]
        self.temperature = float(grid[int(np.argmin(losses))])

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def logits(self, scaled: np.ndarray) -> np.ndarray:
        return np.tanh(scaled @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), self.base)
        return 1 / (1 + np.exp(-np.clip(self.logits(self.scaled(x)) / self.temperature, -40, 40)))


def _features(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, FEATURES)


def score_documents(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """doc_id, held_out and score of every row; fitted on at most `rows` labelled rows."""
    vectors = word_vectors(docs)
    pooled = cut(id_and_text(docs).mapInArrow(_pooled(vectors), "doc_id long, x array<float>"))
    known = pooled.join(F.broadcast(training_labels(labels, "quality", rows)), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * rows).select("x", "label").toArrow()
    x = _features(known.column("x").combine_chunks()) if known.num_rows else np.empty((0, FEATURES))
    network = Network(x, known.column("label").to_numpy().astype(np.float64))

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = network.score(_features(batch.column("x"))) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    scored = pooled.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score")
