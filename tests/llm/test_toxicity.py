"""The toxicity model on held-out rows, misspellings and messy rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlake.llm import toxicity
from ledgerlake.llm.quality_classifier import is_held_out


def brute_buckets(text):
    """N-gram buckets of a text, one window of words after the other."""
    words = text.lower().translate(toxicity._PARTED).split()
    out = []
    for at in range(0, len(words), toxicity.WINDOW):
        for word in dict.fromkeys(words[at : at + toxicity.WINDOW]):
            edged = f" {word} "
            for size in toxicity.SIZES:
                for i in range(len(edged) - size + 1):
                    value = 0
                    for c in edged[i : i + size]:
                        value = (value * 0x100000001B3 + ord(c)) % 2**64
                    out.append(((value + size) * 0x9E3779B97F4A7C15 % 2**64) >> (64 - toxicity.BUCKET_BITS))
    return out


def test_n_grams_lie_inside_words():
    text = "Ab, a b! Überfluß ab ab\n\tl'été 日本語 x" + " again" * 40
    found = [b for part in toxicity.characters(text) for _, buckets in toxicity.grams(part) for b in buckets.tolist()]
    assert sorted(found) == sorted(brute_buckets(text))


def test_long_texts_do_not_depend_on_the_stretch(monkeypatch):
    table = np.random.default_rng(1).normal(size=toxicity.BUCKETS).astype(np.float32)
    text = " ".join(f"w{i % 391}x{i}" for i in range(3200))
    whole = toxicity.logit(text, table, 0.5)
    monkeypatch.setattr(toxicity, "_STRETCH", 1 << 10)
    assert toxicity.logit(text, table, 0.5) == pytest.approx(whole, abs=0.05)  # windows of words start anew at a cut


def test_embeddings_and_softmax_are_trained_jointly():
    """One step moves every part along its slope, against differences of the loss."""
    texts, labels = ["bad bad words here", "good clear words", "more good text again"], np.array([1, 0, 0])
    parts = [np.concatenate([np.array([32], dtype=np.uint32), *toxicity.characters(t)]) for t in texts]

    def loss(model):
        gaps = [toxicity.logit(t, model.table(), model.edge()) for t in texts]
        return float(np.mean([np.logaddexp(0, -g if y else g) for g, y in zip(gaps, labels)]))

    model = toxicity.Model()
    before = [v.copy() for v in (model.embeddings, model.weights, model.bias)]
    model._step(parts, labels, 1.0, [np.full_like(v, 1e12) for v in before])  # so large that steps are slopes
    slopes = [(b - v) * 1e6 for b, v in zip(before, (model.embeddings, model.weights, model.bias))]
    fresh = toxicity.Model()
    for part, at in ((1, (3, 1)), (1, (7, 0)), (2, (1,)), (0, (brute_buckets("bad")[0], 5)), (0, (brute_buckets("again")[2], 2))):
        value = (fresh.embeddings, fresh.weights, fresh.bias)[part]
        held, losses = value[at], []
        for change in (1e-2, -1e-2):
            value[at] = held + change
            losses.append(loss(fresh))
        value[at] = held
        assert slopes[part][at] == pytest.approx((losses[0] - losses[1]) / 2e-2, rel=0.1, abs=0.08)


def test_held_out_documents_and_misspellings(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    rows = toxicity.scored(docs, model).join(labels, "doc_id").where(is_held_out(F.col("doc_id"))).collect()
    toxic, clean = ([r.score >= 0.5 for r in rows if r.toxic == t] for t in (1, 0))
    assert np.mean(toxic) > 0.85 and np.mean(clean) < 0.03
    plain = "the and of that with for was from"
    for known, unseen in (("idiot", "idioot"), ("moron", "moronn"), ("stupid", "stupiid"), ("worthless", "worthles")):
        base, right, wrong = (toxicity.logit(f"{plain} {w}".strip(), model.table(), model.edge()) for w in ("", known, unseen))
        assert wrong > base + 0.25 * (right - base) > base


def test_held_out_labels_change_nothing(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(is_held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    first, second = ({r.doc_id: tuple(r) for r in toxicity.report(docs, x).collect()} for x in (labels, turned))
    assert first == second
    assert all(r[1] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in first.items())


def test_toxicity_of_messy_rows(spark, messy, nothing):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (6, None), (None, 1), (99, 1), (7, 0), (3, 1), (4, 0)], "doc_id long, toxic int")
    rows = toxicity.report(messy.withColumn("toxic", F.lit(9)), labels).collect()
    assert len(rows) == messy.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (3, 4, 5)}) == 1
    assert toxicity.report(nothing, labels).count() == 0
    assert {r.score for r in toxicity.report(messy, labels.limit(0)).where("doc_id = 4").collect()} == {0.5}
