"""Scoring texts by logistic mixing of hashed-context bit predictors.

A text is a row of bits, eight per byte and a closing zero byte. Five predictors see the one to
five bytes before and the bits of the byte so far, and count the bits that followed that context. Their log-odds are added up with weights chosen by a gate, from how much the two longest
predictors have seen and the place of the bit, and the sum is refined by a map from (bits of the
byte so far, probability) to the share of ones seen there.

All training texts are counted: tasks send the counts of their distinct six-byte strings, which
determine every table. The strings are dealt by hash into ``GROUPS`` and put in the order of a hash, whatever
the number of shuffle partitions. In each group the weights are learned online along that order at a falling
rate, and the groups' weights are averaged by mass, for ``EPOCHS`` rounds; the refinement counts the same
strings. In both, a string's own occurrence is taken out of the counts that predict it. The counts are whole and
kept per context: the model is the distinct strings with 64-bit running sums, 16 bytes each and
order, and its broadcast grows with the distinct strings of the corpus.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.shingles import texts_of, word_hashes
from ledgerlake.session import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes that each predictor sees.
CONTEXTS = (1, 2, 3, 4, 5)
ORDERS = len(CONTEXTS)
_PAST = max(CONTEXTS)
#: Steps of the number of bits a context has seen, for the gate.
_SEEN = np.array([1, 2, 4, 8, 32])
_LEVELS = len(_SEEN) + 1
SETS = _LEVELS * _LEVELS * 8
EPOCHS = 2
RATE = 1.0
#: Weights stay between these.
LEAST, MOST = -1.0, 2.0
#: Shares of the strings that learn side by side; fixed, so that results do not depend on the cluster.
GROUPS = 64
_BATCH = 1024
#: The refinement: buckets of log-odds from -8 to 8.
BUCKETS = 33
#: Words whose counts are broadcast, 16 bytes each; the others are joined.
FREQUENT = 1 << 19
_SEGMENT = 1 << 22
_WORD, _STRING = 0, 1


# ---- counting ----


def _segments(text: bytes) -> Iterator[np.ndarray]:
    """The strings of a byte and those before it, for each byte of a text and its closing zero."""
    padded = bytes(_PAST) + text + b"\0"
    for at in range(0, len(padded) - _PAST, _SEGMENT):
        part = np.frombuffer(padded, dtype=np.uint8, count=min(_SEGMENT + _PAST, len(padded) - at), offset=at).astype(np.int64)
        strings = part[: len(part) - _PAST]
        for i in range(1, _PAST + 1):
            strings = (strings << 8) | part[i : i + len(strings)]
        yield strings


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    codes, unique = pd.factorize(np.concatenate(keys))
    return unique, np.bincount(codes, np.concatenate(counts), minlength=len(unique)).astype(np.int64)


class _Tally:
    """Counts by key; the parts are merged when they have grown."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.pending = 0

    def add(self, keys: np.ndarray) -> None:
        codes, unique = pd.factorize(keys)
        self.keys.append(unique)
        self.counts.append(np.bincount(codes, minlength=len(unique)))
        self.pending += len(unique)
        if self.pending > 2_000_000:
            keys, counts = self.total()
            self.keys, self.counts, self.pending = [keys], [counts], 0

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        return _merge(self.keys, self.counts)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, strings = _Tally(), _Tally()
    buffer: list[np.ndarray] = []
    listed: list[np.ndarray] = []
    held = 0
    for batch in batches:
        for text in texts_of(batch.column("text")):
            text = text.lower()
            hashes = word_hashes(text).view(np.int64)
            for part in _segments(text):
                buffer.append(part)
                held += len(part)
            listed.append(hashes)
            if held > _SEGMENT:
                strings.add(np.concatenate(buffer))
                words.add(np.concatenate(listed))
                buffer, listed, held = [], [], 0
    if buffer:
        strings.add(np.concatenate(buffer))
        words.add(np.concatenate(listed))
    for kind, tally in ((_WORD, words), (_STRING, strings)):
        keys, counts = tally.total()
        for at in range(0, len(keys), 1 << 18):
            part = slice(at, at + (1 << 18))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(keys[part]), kind, dtype=np.int8)), pa.array(keys[part]), pa.array(counts[part])],
                names=["kind", "key", "n"],
            )


# ---- predictors ----


def _nodes(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the last byte of strings: nodes, the bits so far behind a leading one, and the bits, both (n, 8)."""
    last = strings & 0xFF
    places = np.arange(8)
    return (1 << places) | (last[:, None] >> (8 - places)), (last[:, None] >> (7 - places)) & 1


def tables(strings: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per order: the sorted distinct strings of its context and a byte, and the running sums of their counts from 0."""
    out = []
    for seen in CONTEXTS:
        short = strings & ((1 << (8 * (seen + 1))) - 1)
        order = np.argsort(short, kind="stable")
        keys, first = np.unique(short[order], return_index=True)
        counts = np.add.reduceat(n[order], first) if len(keys) else np.empty(0, dtype=np.int64)
        out.append((keys, np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(counts)])))
    return out


def bit_counts(table: tuple[np.ndarray, np.ndarray], strings: np.ndarray, seen: int) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones, (n, 8), that followed the ``seen`` bytes of context and the bits so far.

    The strings with a context and first bits are a range of the sorted keys, so counts are
    differences of running sums.
    """
    keys, sums = table
    code = strings & ((1 << (8 * (seen + 1))) - 1)
    start = code & ~0xFF
    low, high = np.searchsorted(keys, start), np.searchsorted(keys, start + 256)
    zeros, ones = np.empty((2, len(strings), 8), dtype=np.int64)
    for place in range(8):
        half = 1 << (7 - place)
        middle = np.searchsorted(keys, start + half)
        zeros[:, place], ones[:, place] = sums[middle] - sums[low], sums[high] - sums[middle]
        is_one = (code & half) > 0
        low, high = np.where(is_one, middle, low), np.where(is_one, high, middle)
        start = start + half * is_one
    return zeros, ones


def _inputs(counts: list, strings: np.ndarray, places: np.ndarray, own: np.ndarray | None = None):
    """Log-odds (orders + 1, ...), and the gate's set; ``own`` bits are taken out of the counts once."""
    found = [bit_counts(table, strings, seen) for table, seen in zip(counts, CONTEXTS)]
    zeros, ones = np.array(found, dtype=np.float64).transpose(1, 0, 2, 3)
    if own is not None:
        ones = np.maximum(ones - own, 0)
        zeros = np.maximum(zeros - (1 - own), 0)
    odds = np.log((ones + 0.05) / (zeros + 0.05))
    seen = zeros[-2:] + ones[-2:]
    level = np.searchsorted(_SEEN, seen, side="right")
    gate = (level[0] * _LEVELS + level[1]) * 8 + places
    return np.concatenate([odds, np.full((1, *odds.shape[1:]), 0.3)]), gate


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -20, 20)))


def _mixed_odds(inputs: np.ndarray, gate: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.einsum("k...,...k->...", inputs, weights[gate])


def _bucket(odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower bucket and the share of the upper one."""
    at = (np.clip(odds, -7.999, 7.999) + 8) * ((BUCKETS - 1) / 16)
    low = at.astype(np.int64)
    return low, at - low


def _learn(model, weights: np.ndarray):
    """A mapInArrow function: one online pass over a group's strings, in their order.

    A batch moves a set's weights by its mean slope, times the root of the batch's share in all the
    set has seen, so later batches move them less and a long pass settles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, own, mass, group = model.value, weights.copy(), np.zeros(SETS), None
        for batch in batches:
            if batch.num_rows and group is None:
                group = batch.column("group")[0].as_py()
            keys, times = batch.column("key").to_numpy(), batch.column("n").to_numpy().astype(np.float64)
            for at in range(0, len(keys), _BATCH):
                near = np.argsort(keys[at : at + _BATCH])  # sorted strings are found faster
                strings, n = keys[at : at + _BATCH][near], times[at : at + _BATCH][near]
                _, bits = _nodes(strings)
                inputs, gate = _inputs(counts, strings, np.arange(8), bits)
                error = bits - _squash(_mixed_odds(inputs, gate, own))
                heavy = np.broadcast_to(n[:, None], bits.shape)
                total = np.bincount(gate.ravel(), heavy.ravel(), minlength=SETS)
                mass += total
                step = RATE / np.sqrt(np.maximum(total * mass, 1))
                for k in range(ORDERS + 1):
                    slope = np.bincount(gate.ravel(), (heavy * error * inputs[k]).ravel(), minlength=SETS)
                    own[:, k] += step * slope
                np.clip(own, LEAST, MOST, out=own)
        if group is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(SETS, group)), pa.array(np.arange(SETS)), pa.array(mass)]
                + [pa.array(own[:, k]) for k in range(ORDERS + 1)],
                names=["group", "set", "mass"] + [f"w{k}" for k in range(ORDERS + 1)],
            )

    return run


def _refine(model, weights: np.ndarray):
    """A mapInArrow function: ones and bits seen per (node, bucket) of the mixed log-odds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 256 * BUCKETS))
        for batch in batches:
            strings, n = batch.column("key").to_numpy(), batch.column("n").to_numpy().astype(np.float64)
            for at in range(0, len(strings), 1 << 15):
                nodes, bits = _nodes(strings[at : at + (1 << 15)])
                inputs, gate = _inputs(model.value, strings[at : at + (1 << 15)], np.arange(8), bits)
                low, share = _bucket(_mixed_odds(inputs, gate, weights))
                heavy = n[at : at + (1 << 15), None]
                for step, part in ((0, (1 - share) * heavy), (1, share * heavy)):
                    index = (nodes * BUCKETS + low + step).ravel()
                    seen[0] += np.bincount(index, (part * bits).ravel(), minlength=256 * BUCKETS)
                    seen[1] += np.bincount(index, part.ravel(), minlength=256 * BUCKETS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(256 * BUCKETS)), pa.array(seen[0]), pa.array(seen[1])], names=["at", "ones", "bits"]
        )

    return run


def log10_cost(strings: np.ndarray, counts: list, weights: np.ndarray, refined: np.ndarray) -> np.ndarray:
    """log10 of the probability that the model gives the last byte of each string after the first four."""
    out = np.empty(len(strings))
    for at in range(0, len(strings), 1 << 14):
        nodes, bits = _nodes(strings[at : at + (1 << 14)])
        inputs, gate = _inputs(counts, strings[at : at + (1 << 14)], np.arange(8))
        odds = _mixed_odds(inputs, gate, weights)
        low, share = _bucket(odds)
        index = nodes * BUCKETS + low
        p = (_squash(odds) + 3 * ((1 - share) * refined[index] + share * refined[index + 1])) / 4
        p = np.clip(p, 1e-6, 1 - 1e-6)
        out[at : at + (1 << 14)] = np.log10(np.where(bits == 1, p, 1 - p)).sum(axis=1)
    return out


class _Costs:
    """:func:`log10_cost` that remembers up to ``MEMORY`` strings."""

    MEMORY = 1 << 21

    def __init__(self, *model) -> None:
        self.model = model
        self.strings, self.cost = np.empty(0, dtype=np.int64), np.empty(0)

    def of(self, strings: np.ndarray) -> np.ndarray:
        out = np.empty(len(strings))
        at = np.searchsorted(self.strings, strings)
        is_known = at < len(self.strings)
        is_known[is_known] = self.strings[at[is_known]] == strings[is_known]
        out[is_known] = self.cost[at[is_known]]
        rest = np.flatnonzero(~is_known)
        rest = rest[np.argsort(strings[rest], kind="stable")]  # sorted strings are found faster
        fresh = strings[rest]
        out[rest] = cost = log10_cost(fresh, *self.model)
        if len(self.strings) + len(fresh) > self.MEMORY:
            self.strings, self.cost = np.empty(0, dtype=np.int64), np.empty(0)
        together, costs = np.concatenate([self.strings, fresh]), np.concatenate([self.cost, cost])
        order = np.argsort(together, kind="stable")
        self.strings, self.cost = together[order], costs[order]
        return out


# ---- the model ----


class Model:
    """What scoring needs, as broadcasts: bit counts, mixing weights, refinement, frequent words and totals."""

    def __init__(self, spark: SparkSession, counts: DataFrame, documents: int) -> None:
        context = spark.sparkContext
        strings = written(
            counts.where(F.col("kind") == _STRING).select("key", "n")
            .repartition(F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFFFF))),  # contexts of three bytes and more whole
            "strings",
        )
        seen = strings.toArrow()
        self.counts = context.broadcast(tables(seen.column("key").to_numpy(), seen.column("n").to_numpy()))
        del seen
        weights = np.full((SETS, ORDERS + 1), 0.3)
        names = [f"w{k}" for k in range(ORDERS + 1)]
        schema = "group long, set long, mass double, " + ", ".join(f"{c} double" for c in names)
        order = F.xxhash64("key")
        dealt = (
            strings.withColumn("group", F.pmod(order, F.lit(GROUPS)).cast("int"))
            .repartitionById(GROUPS, F.col("group"))
            .sortWithinPartitions(order, "key")
        )
        for _ in range(EPOCHS):
            # GROUPS * SETS rows, averaged in the order of their groups.
            learned = dealt.mapInArrow(_learn(self.counts, weights), schema).toPandas().sort_values(["set", "group"])
            at, mass = learned["set"].to_numpy(), learned["mass"].to_numpy()
            total = np.bincount(at, mass, minlength=SETS)
            for k, name in enumerate(names):
                summed = np.bincount(at, mass * learned[name].to_numpy(), minlength=SETS)
                weights[:, k] = np.where(total > 0, summed / np.maximum(total, 1), weights[:, k])
        self.weights = weights
        refined = strings.mapInArrow(_refine(self.counts, weights), "at long, ones double, bits double").groupBy("at").agg(
            F.sum("ones").alias("ones"), F.sum("bits").alias("bits")
        ).toPandas()
        prior = np.tile(_squash(np.linspace(-8, 8, BUCKETS)), 256)
        ones, bits = np.zeros(256 * BUCKETS), np.zeros(256 * BUCKETS)
        ones[refined["at"].to_numpy()], bits[refined["at"].to_numpy()] = refined["ones"], refined["bits"]
        self.refined = (ones + 20 * prior) / (bits + 20)
        self.words = counts.where(F.col("kind") == _WORD).select("key", "n")
        total = self.words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
        # The end of a text is a token too.
        self.ends = documents
        self.tokens, self.distinct = total["n"] + documents, total["v"] + (documents > 0)
        often = self.words.orderBy(F.desc("n"), "key").limit(FREQUENT).toArrow()
        order = np.argsort(keys := often.column("key").to_numpy())
        self.frequent = context.broadcast((keys[order], often.column("n").to_numpy()[order]))


def train(texts: DataFrame) -> Model:
    """A model of the ``text`` column; all rows count, null texts as empty ones."""
    counts = written(
        texts.select("text").mapInArrow(_count, "kind tinyint, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")),
        "counts",
    )
    return Model(texts.sparkSession, counts, texts.count())


def _score(counts, weights, refined, frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, times = frequent.value
        costs = _Costs(counts.value, weights, refined)
        for batch in batches:
            texts = [t.lower() for t in texts_of(batch.column("text"))]
            score = np.zeros(len(texts))
            buffer: list[tuple[int, np.ndarray]] = []
            held = 0

            def settle() -> None:
                if not buffer:
                    return
                codes, unique = pd.factorize(np.concatenate([p for _, p in buffer]))
                cost = costs.of(unique)[codes]
                starts = np.concatenate([[0], np.cumsum([len(p) for _, p in buffer])[:-1]])
                np.add.at(score, [i for i, _ in buffer], np.add.reduceat(cost, starts))

            tokens, part, hits, rare, rare_n, content = [], [], [], [], [], []
            size = np.array([len(t) + 1 for t in texts], dtype=np.float64)
            for i, text in enumerate(texts):
                for segment in _segments(text):
                    buffer.append((i, segment))
                    held += len(segment)
                    if held > _SEGMENT:
                        settle()
                        buffer, held = [], 0
                hashes = word_hashes(text).view(np.int64)
                words, n = np.unique(hashes, return_counts=True)
                at = np.minimum(np.searchsorted(known, words), max(len(known) - 1, 0))
                is_known = known[at] == words if len(known) else np.zeros(len(words), dtype=bool)
                tokens.append(len(hashes) + 1)
                part.append(float((n[is_known] * np.log10(times[at[is_known]] + 1.0)).sum()) if len(known) else 0.0)
                hits.append(int(n[is_known].sum()))
                rare.append(words[~is_known])
                rare_n.append(n[~is_known])
                content.append(xxhash.xxh3_64_intdigest(text) - (1 << 63))
            settle()
            ends = np.concatenate([[0], np.cumsum([len(r) for r in rare])]).astype(np.int32)
            flat = (np.concatenate(rare), np.concatenate(rare_n)) if rare else (np.empty(0, np.int64), np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(content, pa.int64()), pa.array(tokens, pa.int64()), pa.array(part, pa.float64()),
                    pa.array(hits, pa.int64()), pa.array(score), pa.array(-score / size / np.log10(2)), pa.ListArray.from_arrays(ends, pa.array(flat[0])),
                    pa.ListArray.from_arrays(ends, pa.array(flat[1].astype(np.int64))),
                ],
                names=["doc_id", "content", "n_tokens", "part", "hits", "score", "bits_per_byte", "rare", "rare_n"],
            )

    return run


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for every row of ``docs``.

    ``score`` is the log10 probability of the whole lower-cased text and its end; a null text is
    an empty one. ``bits_per_byte`` is that in bits, over the text's bytes and its end. ``base_score`` adds up log10((c + 1) / (N + V + 1)) over the words and the end.
    Counts of the ``FREQUENT`` commonest words are broadcast; the other words are joined, one row
    per distinct text and word, so no word's count is lost. Repeated rows score alike; a model of
    no texts gives every token c = 0.
    """
    found = written(
        docs.select("doc_id", "text").mapInArrow(
            _score(model.counts, model.weights, model.refined, model.frequent),
            "doc_id long, content long, n_tokens long, part double, hits long, score double, bits_per_byte double, rare array<long>, rare_n array<long>",
        ),
        "scored",
    )
    pairs = found.where(F.size("rare") > 0).select("content", F.explode(F.arrays_zip("rare", "rare_n")).alias("p"))
    each = pairs.groupBy("content", F.col("p.rare").alias("key")).agg(F.first("p.rare_n").alias("times"))
    joined = each.join(model.words, "key").groupBy("content").agg(
        F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("_part"), F.sum("times").alias("_hits")
    )
    divisor = float(np.log10(model.tokens + model.distinct + 1.0))
    end = float(np.log10(model.ends + 1.0))
    rest = joined.withColumnRenamed("content", "_content")
    return found.join(rest, F.col("content") == F.col("_content"), "left").select(
        "doc_id", "n_tokens",
        (F.col("hits") + F.coalesce("_hits", F.lit(0)) + F.lit(int(model.ends > 0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("part") + F.coalesce("_part", F.lit(0.0)) + F.lit(end) - F.col("n_tokens") * F.lit(divisor)).alias("base_score"),
        "score", "bits_per_byte",
    )


def is_held_out(doc_id: Column) -> Column:
    """Whether the id's remainder keeps the row out of training; rows without an id are trained on."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def report(docs: DataFrame) -> DataFrame:
    """Scores of all documents under a model of those that are not held out."""
    out = scores(docs, train(docs.where(~is_held_out(F.col("doc_id")))))
    return out.select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score",
        "bits_per_byte",
    )
