"""The pipeline's stages on the smallest tables, and the query list."""

from collections import Counter

import __spark_entry__ as driver
import corpus_pipeline
from ledgerlake.llm import near_dedup, packing
from ledgerlake.session import written
from tests.llm.conftest import words
from tests.llm.test_duplicates import brute_classes, brute_lines
from tests.llm.test_tables import brute_measures

FOLDER = "/root/testdata/sf0.001"


def test_every_operator_is_registered_once():
    names = [n for n in driver.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in driver.queries()


def test_stages(spark, documents):
    frames = [documents]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(written(stage(spark, frames[-1], FOLDER), name))
    assert all(f.columns == documents.columns for f in frames[:5])
    raw, ruled, lined, single, mixed, packed = ([r for r in f.collect()] for f in frames)
    assert {r.doc_id for r in ruled} <= {r.doc_id for r in raw if not brute_measures(r.text)[-1]} and len(ruled) > 0.8 * len(raw)
    gone, _ = brute_lines(spark, [(r.doc_id, r.text) for r in ruled])
    want = {r.doc_id: "\n".join(x for at, x in enumerate(r.text.split("\n")) if (r.doc_id, at) not in gone) for r in ruled}
    assert {r.doc_id: r.text for r in lined} == {i: t for i, t in want.items() if words(t)}
    classes = brute_classes([(r.doc_id, r.text) for r in lined])
    assert {r.doc_id for r in single} == {c for _, _, c in classes}
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in single}
    copies = Counter(r.doc_id for r in mixed)
    assert max(copies.values()) <= 3
    tokens = sum(len(words(r.text)) for r in mixed)
    assert sum(r.length for r in packed) == tokens and max(r.length for r in packed) <= packing.MAX_LENGTH
    assert Counter(r.doc_id for r in packed if r.piece == 0) == copies
    assert near_dedup.SIMILARITY == 75
