"""A toxicity score per document from subword-bag embeddings and a linear softmax.

A word is its bag of character n-grams, its edges marked, each an embedding in a hashed table; so a
misspelling never seen shares most n-grams of a known word. A document is the mean of all its
words' n-gram embeddings, and a linear softmax over it gives the classes. Embeddings and
softmax are trained jointly in numpy, on at most ``SAMPLE`` labelled documents.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import unit_hash
from ledgerlake.llm.quality_classifier import is_held_out

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Labelled documents that are learned from, those with the least hash of their id, and the
#: length in bytes up to which a document is among them.
SAMPLE = 10_000
LONGEST_LEARNED = 32_768
BUCKET_BITS = 17
BUCKETS = 1 << BUCKET_BITS
DIMENSIONS = 12
#: Characters of an n-gram; a word's edges count as one character each.
SIZES = (3, 4, 5, 6)
#: A word counts once in so many words in a row, so that a word said over and over is not the whole mean.
WINDOW = 32
CLASSES = 2
THRESHOLD = 0.5
#: N-grams without meaning that every text holds besides its own, so that a few words weigh little.
BLANK = 200
#: What means are multiplied by, as an insult is a small part of a text.
GAIN = 256.0
_START = 1e-3  # what the sums of squared slopes begin with
_STRETCH = 1 << 20  # characters whose n-grams are looked up at once
_SPACE = 32
_PARTED = str.maketrans(dict.fromkeys(".,;:!?\"()[]{}<>|", " "))
_BLANKS = re.compile(r"\s")
_PRIME, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def characters(text: str) -> Iterator[np.ndarray]:
    """The words of a text in lower case between spaces, as character codes, a stretch at a time.

    Blanks and sentence marks part words; in every ``WINDOW`` words each counts once.
    """
    at = 0
    while at < len(text):
        cut = len(text)
        if cut - at > _STRETCH:
            blank = _BLANKS.search(text, at + _STRETCH)
            cut = blank.start() if blank else cut
        words = text[at:cut].lower().translate(_PARTED).split()
        once = [" ".join(dict.fromkeys(words[i : i + WINDOW])) for i in range(0, len(words), WINDOW)]
        if once:
            yield np.frombuffer(f" {' '.join(once)} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        at = cut


def grams(text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, bucket) of the n-grams of each size; they lie in one word, with its edges at most."""
    blank = text == _SPACE
    wide = text.astype(np.uint64)
    value = wide[:-1] * _PRIME + wide[1:]
    inside = np.ones(len(value), dtype=bool)
    for size in range(3, SIZES[-1] + 1):
        if len(value) < 2:
            return
        value = value[:-1] * _PRIME + wide[size - 1 :]
        inside = inside[:-1] & ~blank[size - 2 : len(blank) - 1]
        if size in SIZES:
            at = np.flatnonzero(inside)
            yield at, (((value[at] + np.uint64(size)) * _MIX) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


class Model:
    """N-gram embeddings and a linear softmax over their mean."""

    def __init__(self, seed: int = 5) -> None:
        self.rng = np.random.default_rng(seed)
        self.embeddings = (self.rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)) / 64).astype(np.float32)
        self.weights = self.rng.normal(0, 1, (DIMENSIONS, CLASSES)).astype(np.float32)
        self.bias = np.zeros(CLASSES, dtype=np.float32)

    def table(self) -> np.ndarray:
        """Each bucket's logit of class 1 over class 0: the softmax of a mean is linear in its parts."""
        return GAIN * (self.embeddings @ (self.weights[:, 1] - self.weights[:, 0]))

    def edge(self) -> float:
        return float(self.bias[1] - self.bias[0])

    def fit(self, texts: list[str], labels: np.ndarray, epochs: int = 8, batch: int = 128, rate: float = 0.3) -> Model:
        """Adagrad on the log loss, over all documents in each epoch; texts without words teach the bias."""
        space = np.array([_SPACE], dtype=np.uint32)
        parts = [np.concatenate([space, *characters(t)]) for t in texts]
        square = [np.full_like(v, _START) for v in (self.embeddings, self.weights, self.bias)]
        for _ in range(epochs if texts else 0):
            order = self.rng.permutation(len(texts))
            for first in range(0, len(order), batch):
                rows = order[first : first + batch]
                self._step([parts[d] for d in rows], labels[rows].astype(int), rate, square)
        return self

    def _step(self, texts: list[np.ndarray], labels: np.ndarray, rate: float, square: list[np.ndarray]) -> None:
        n = len(texts)
        whose = np.repeat(np.arange(n), [len(t) for t in texts])
        found = list(grams(np.concatenate(texts)))
        place, bucket = (np.concatenate([f[i] for f in found] or [np.empty(0, dtype=np.int64)]) for i in (0, 1))
        owner = whose[place]
        count = np.bincount(owner, minlength=n) + BLANK
        by_bucket = GAIN * (self.embeddings @ self.weights)
        logits = np.stack([np.bincount(owner, by_bucket[bucket, c], minlength=n) / count for c in range(CLASSES)], axis=1) + self.bias
        chance = np.exp(logits - logits.max(axis=1, keepdims=True))
        error = (chance / chance.sum(axis=1, keepdims=True) - np.eye(CLASSES)[labels]) / n
        share = GAIN * error / count[:, None]
        slope = np.stack([np.bincount(bucket, share[owner, c], minlength=BUCKETS) for c in range(CLASSES)], axis=1).astype(np.float32)
        steps = slope @ self.weights.T, self.embeddings.T @ slope, error.sum(axis=0).astype(np.float32)
        for value, seen, step in zip((self.embeddings, self.weights, self.bias), square, steps):
            seen += step * step
            value -= rate * step / np.sqrt(seen)


def logit(text: str, table: np.ndarray, edge: float) -> float:
    """The logit of a whole text; the bias alone for a text without words."""
    total, count = 0.0, 0
    for part in characters(text):
        for _, bucket in grams(part):
            total += float(table[bucket].sum(dtype=np.float64))
            count += len(bucket)
    return total / (count + BLANK) + edge


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, edge = shared.value
        for batch in batches:
            found = np.array([logit(t or "", table, edge) for t in batch.column("text").to_pylist()], dtype=np.float64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(found, -30, 30))))], names=["doc_id", "score"]
            )

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, longest: int = LONGEST_LEARNED) -> Model:
    """The model of the labelled rows that are not held out.

    The driver reads at most ``sample`` documents of up to ``longest`` bytes. An id labelled twice counts
    as its greatest label, one with several texts as its least; null labels, ids and texts are left out.
    """
    known = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    short = docs.where(F.octet_length("text") <= longest).select("doc_id", "text")
    rows = short.join(known, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    learned = rows.orderBy(unit_hash(F.col("doc_id")), "doc_id").limit(sample).toArrow()
    truth = np.array(learned.column("toxic").to_pylist(), dtype=np.float64)
    return Model().fit(learned.column("text").to_pylist(), truth)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast((model.table(), model.edge()))
    return docs.select("doc_id", "text").mapInArrow(_score(shared), "doc_id long, score double")


def report(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text).

    Null, empty and blank texts get the score of the bias alone; rows without an id are scored and never
    learned from; repeated rows score alike; other columns do not count. Without labels every
    score is near a half, and an empty table gives an empty one.
    """
    out = scored(docs, train(docs, labels, sample))
    return out.select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
