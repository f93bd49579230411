"""A quality score per document from random-indexing word vectors and a small network.

Every word bucket has a fixed sparse index vector of a few +1 and -1. A bucket's word vector is the
sum of the index vectors of the words around its occurrences, over the whole corpus; tasks add up
their share and the shares are summed by bucket. A document is the mean and the spread of its
words' vectors. Two layers of numpy, fitted to at most ``SAMPLE`` labelled documents, give a logit,
and a temperature fitted on a fifth of them gives the probability.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import unit_hash
from ledgerlake.llm.shingles import texts_of
from ledgerlake.session import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Labelled documents that the network is fitted to, those with the least hash of their id.
SAMPLE = 20_000
DIMENSIONS = 32
#: Buckets of words, and of words in capitals.
PLAIN, CAPITAL = 8192, 1024
BUCKETS = PLAIN + CAPITAL
WINDOW = 2
NONZERO = 2
HIDDEN = 24
THRESHOLD = 0.3
FEATURES = 2 * DIMENSIONS
_TOKEN = re.compile(rb"[A-Za-z0-9\x80-\xff]+|[^\sA-Za-z0-9\x80-\xff]")
_CHUNK = 1 << 20
_rng = np.random.default_rng(11)
_PLACES = _rng.integers(0, DIMENSIONS, (BUCKETS + 1, NONZERO))
_SIGNS = _rng.choice([-1.0, 1.0], (BUCKETS + 1, NONZERO))
_SIGNS[BUCKETS] = 0  # the gap between documents


def buckets(text: bytes) -> Iterator[np.ndarray]:
    """Word buckets of a text, in order, a stretch at a time; marks are words of their own."""
    tokens: list[bytes] = []
    for match in _TOKEN.finditer(text):
        tokens.append(match.group())
        if len(tokens) == _CHUNK:
            yield _bucketed(tokens)
            tokens = []
    if tokens:
        yield _bucketed(tokens)


def _bucketed(tokens: list[bytes]) -> np.ndarray:
    n = len(tokens)
    hashes = np.fromiter(map(zlib.crc32, tokens), dtype=np.int64, count=n)
    capital = np.fromiter(map(bytes.isupper, tokens), dtype=bool, count=n) & (np.fromiter(map(len, tokens), dtype=np.int64, count=n) > 1)
    return np.where(capital, PLAIN + hashes % CAPITAL, hashes % PLAIN)


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS * DIMENSIONS)
    gap = np.full(WINDOW, BUCKETS)
    last = gap  # words before the held ones: their pairs among each other are counted
    held: list[np.ndarray] = []
    size = 0

    def add() -> None:
        nonlocal last
        ids = np.concatenate([last, *held])
        last = ids[-WINDOW:]
        for apart in range(1, WINDOW + 1):
            near, far = ids[WINDOW - apart : -apart], ids[WINDOW:]
            for words, context in ((near, far), (far, near)):
                for k in range(NONZERO):
                    inside = words < BUCKETS
                    at = words[inside] * DIMENSIONS + _PLACES[context[inside], k]
                    total[:] += np.bincount(at, _SIGNS[context[inside], k], minlength=len(total))

    for batch in batches:
        for text in texts_of(batch.column("text")):
            for ids in buckets(text):
                held.append(ids)
                size += len(ids)
                if size >= _CHUNK:
                    add()
                    held, size = [], 0
            held.append(gap)
    if held:
        add()
    sums = total.reshape(BUCKETS, DIMENSIONS)
    filled = np.flatnonzero(sums.any(axis=1))
    yield pa.RecordBatch.from_arrays(
        [pa.array(filled)] + [pa.array(sums[filled, d].astype(np.int64)) for d in range(DIMENSIONS)],
        names=["bucket"] + [f"d{d}" for d in range(DIMENSIONS)],
    )


def word_vectors(docs: DataFrame) -> np.ndarray:
    """(BUCKETS, DIMENSIONS) unit vectors from all texts; buckets never seen are 0.

    The driver reads one row per bucket, whatever the corpus.
    """
    names = [f"d{d}" for d in range(DIMENSIONS)]
    schema = "bucket long, " + ", ".join(f"{c} long" for c in names)
    sums = docs.select("text").mapInArrow(_around, schema).groupBy("bucket").agg(*[F.sum(c).alias(c) for c in names]).toPandas()
    vectors = np.zeros((BUCKETS, DIMENSIONS))
    if len(sums):
        raw = sums[names].to_numpy(dtype=np.float64)
        common = raw.sum(axis=0)
        common /= max(np.linalg.norm(common), 1e-9)
        raw -= np.outer(raw @ common, common) * 0.9  # frequent contexts drown the others
        vectors[sums["bucket"].to_numpy()] = raw / np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-9)
    return vectors


def pooled(text: bytes, vectors: np.ndarray) -> np.ndarray:
    """Mean and standard deviation of a text's word vectors; zeros for a text without words."""
    n, first, second = 0, np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)
    for ids in buckets(text):
        unique, times = np.unique(ids, return_counts=True)
        found = vectors[unique]
        first += times @ found
        second += times @ (found * found)
        n += len(ids)
    if not n:
        return np.zeros(FEATURES)
    mean = first / n
    return np.concatenate([mean, np.sqrt(np.maximum(second / n - mean * mean, 0))])


def _pool(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [pooled(t, shared.value) for t in texts_of(batch.column("text"))]
            flat = np.concatenate(rows).astype(np.float32) if rows else np.empty(0, dtype=np.float32)
            starts = np.arange(len(rows) + 1, dtype=np.int32) * FEATURES
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(starts), pa.array(flat))], names=["doc_id", "features"]
            )

    return run


class Network:
    """Features -> tanh layer -> logit; a temperature divides the logit."""

    def __init__(self, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.centre, self.scale, self.temperature = np.zeros(FEATURES), np.ones(FEATURES), 1.0
        self.weights = [
            rng.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)
        ]
        self.rng = rng

    def logit(self, features: np.ndarray) -> np.ndarray:
        first, shift, second, bias = self.weights
        return np.tanh((features - self.centre) / self.scale @ first + shift) @ second + bias[0]

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(features) / self.temperature, -30, 30)))

    def fit(self, features: np.ndarray, labels: np.ndarray, steps: int = 2000, batch: int = 256, rate: float = 0.004) -> Network:
        """Adam on the log loss, then the temperature on every fifth row, which the steps leave out."""
        if not len(labels):
            return self
        order = self.rng.permutation(len(labels))
        held, used = order[::5], (order if len(order) < 5 else np.setdiff1d(order, order[::5]))
        self.centre, self.scale = features[used].mean(axis=0), features[used].std(axis=0) + 1e-6
        inputs = (features - self.centre) / self.scale
        moment, square = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights]
        for step in range(1, steps + 1):
            rows = self.rng.choice(used, min(batch, len(used)))
            x, y = inputs[rows], labels[rows]
            first, shift, second, bias = self.weights
            inner = np.tanh(x @ first + shift)
            error = (1 / (1 + np.exp(-np.clip(inner @ second + bias[0], -30, 30))) - y) / len(rows)
            back = np.outer(error, second) * (1 - inner * inner)
            slopes = [x.T @ back + 1e-3 * first, back.sum(axis=0), inner.T @ error + 1e-3 * second, np.array([error.sum()])]
            for i, slope in enumerate(slopes):
                moment[i] = 0.9 * moment[i] + 0.1 * slope
                square[i] = 0.999 * square[i] + 0.001 * slope * slope
                corrected = moment[i] / (1 - 0.9**step), square[i] / (1 - 0.999**step)
                self.weights[i] = self.weights[i] - rate * corrected[0] / (np.sqrt(corrected[1]) + 1e-8)
        logits, truth = self.logit(features[held]), labels[held]
        grid = np.geomspace(0.25, 8, 61)
        loss = [np.logaddexp(0, np.where(truth == 1, -1, 1) * logits / t).mean() for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])
        return self


def _apply(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features = batch.column("features").flatten().to_numpy().reshape(-1, FEATURES)
            score = shared.value.probability(features.astype(np.float64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return run


def is_held_out(doc_id: Column) -> Column:
    """Whether the id's remainder keeps the row's label from the fit."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def report(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text).

    ``labels`` has doc_id and quality, 0 or 1; null labels and labels of held-out ids are not
    used, and an id labelled twice counts once, as its least label. Null and empty texts get the
    score of a document without words; rows without an id are scored and never learned from;
    repeated rows score alike. Without labels every score is near a half; an empty table gives
    an empty one.
    """
    context = docs.sparkSession.sparkContext
    vectors = context.broadcast(word_vectors(docs))
    features = written(docs.select("doc_id", "text").mapInArrow(_pool(vectors), "doc_id long, features array<float>"), "features")
    known = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(unit_hash(F.col("doc_id")), "doc_id").limit(sample)
    )
    rows = features.join(known, "doc_id").groupBy("doc_id").agg(F.min("features").alias("features"), F.min("quality").alias("quality"))
    learned = rows.orderBy("doc_id").toPandas()
    network = Network()
    if len(learned):
        network.fit(np.stack(learned["features"].to_numpy()).astype(np.float64), learned["quality"].to_numpy().astype(np.float64))
    scored = features.mapInArrow(_apply(context.broadcast(network)), "doc_id long, score double")
    return scored.select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
