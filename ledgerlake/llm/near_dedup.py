"""Near duplicates through an LSH forest.

Every distinct shingle set gets ``TREES`` orders of ``DEPTH`` min-hashes. In an order, sets that
agree on a prefix lie next to each other: sets are candidates where they share the prefix of
length ``LEAST_DEPTH``, and a region with more than ``CROWD`` sets is split by longer prefixes until
it has fewer. Inside a region every set is compared on whole signatures with every other, and its
best partners are confirmed on full shingle sets. A second round takes more partners per set from
regions that still hold several components. Where partners are left untried after it, the whole
region is compared on full sets, so no pair of a region is left out and none is listed.

Two sets of similarity 0.75 share a region of depth 3, 4 or 5 in one of 24 orders with probability
0.999998, 0.9999 or 0.998, one of depth 6 or 7 with 0.991 or 0.968. The longest prefix is ``DEPTH``; a still larger region is dealt over several
that share one set. Splits and deals part some pairs, so a region of the least prefix that was split
and still holds several components after the rounds, as with pages of one template, is compared on
full sets in pairs of blocks: no pair of a crowd is left out. That work grows with the square of the
sets outside its largest component.
Signatures drop a pair of similarity 0.75 outside such whole regions with probability 0.0000008.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import narrowed
from ledgerlake.llm.components import merged_components
from ledgerlake.llm.shingles import fingerprint, overlap, shingle_set, texts_of
from ledgerlake.session import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SIMILARITY = 75  # per cent
TREES = 24
DEPTH = 7
LEAST_DEPTH = 3
CROWD = 1024
VALUES = TREES * DEPTH
#: Share of equal signature values below which a pair is not confirmed on full sets.
LEAST_ESTIMATE = 0.58
#: Best partners per set that each round confirms; what they leave is settled region by region.
PARTNERS = (1, 4)

_FACTORS = np.random.default_rng(20240501).integers(1, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ROOM = 2048  # shingles worked on at once


def signature(shingles: np.ndarray) -> np.ndarray:
    """16 bits of each min-hash of a set that is not empty."""
    least = np.full(VALUES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), _ROOM):
        part = shingles[at : at + _ROOM]
        np.minimum(least, (part[None, :] * _FACTORS[:, None]).min(axis=1), out=least)
    return ((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.uint16)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, prints, signatures = [], [], []
        for text in texts_of(batch.column("text")):
            shingles = shingle_set(text)
            sizes.append(len(shingles))
            prints.append(fingerprint(shingles) if len(shingles) else None)
            signatures.append(signature(shingles).tobytes() if len(shingles) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("content"), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), pa.array(signatures, pa.binary())],
            names=["doc_id", "content", "n_shingles", "node", "signature"],
        )


def _climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per set and order: the order with the least prefix in one number, the rest in another."""
    for batch in batches:
        nodes = batch.column("node").to_numpy()
        if not len(nodes):
            continue
        values = np.frombuffer(b"".join(batch.column("signature").to_pylist()), dtype=np.uint16)
        paths = values.reshape(-1, TREES, DEPTH).astype(np.uint64)
        key = np.broadcast_to(np.arange(TREES, dtype=np.uint64), paths.shape[:2])
        deep = np.zeros(paths.shape[:2], dtype=np.uint64)
        for level in range(DEPTH):
            if level < LEAST_DEPTH:
                key = (key << np.uint64(16)) | paths[:, :, level]
            else:
                deep = (deep << np.uint64(16)) | paths[:, :, level]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(nodes, TREES)), pa.array(key.ravel().view(np.int64)), pa.array(deep.ravel().view(np.int64))],
            names=["node", "region", "deep"],
        )


def regions(nodes: DataFrame, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """(region, node) of the sets of every region with two or more, and those of the crowds.

    A region has about ``crowd`` sets at most: a larger one is a crowd, and is split by longer prefixes and dealt at the last.
    """
    paths = written(nodes.select("node", "signature").mapInArrow(_climb, "node long, region long, deep long"), "paths")
    counts = paths.groupBy("region").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    at = written(paths.join(counts, "region"), "regions")
    settled = [at.where(F.col("_n") <= crowd).select("region", "node")]
    crowds = at.where(F.col("_n") > crowd).select("region", "node")
    for depth in range(LEAST_DEPTH + 1, DEPTH + 1):
        crowded = at.where(F.col("_n") > crowd).drop("_n")
        if crowded.isEmpty():
            return _all(settled), crowds
        prefix = F.shiftrightunsigned(F.col("deep"), 16 * (DEPTH - depth))
        longer = crowded.withColumn("region", F.xxhash64("region", prefix))
        counts = longer.groupBy("region").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
        at = written(longer.join(counts, "region"), "regions")
        settled.append(at.where(F.col("_n") <= crowd).select("region", "node"))
    crowded = at.where(F.col("_n") > crowd)
    hubs = crowded.groupBy("region").agg(F.min("node").alias("hub"), F.ceil(F.max("_n") / crowd).cast("int").alias("_k"))
    dealt = crowded.withColumn("_deal", F.pmod(F.xxhash64("node"), F.ceil(F.col("_n") / crowd)).cast("int"))
    settled.append(dealt.select(F.xxhash64("region", "_deal").alias("region"), "node"))
    every = hubs.select("region", "hub", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("_deal"))
    settled.append(every.select(F.xxhash64("region", "_deal").alias("region"), F.col("hub").alias("node")))
    return _all(settled).distinct(), crowds


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _equal_values(signatures: np.ndarray, i: int) -> np.ndarray:
    return np.count_nonzero(signatures == signatures[i], axis=1)


def _partners_in(rows: tuple[np.ndarray, ...], most: int) -> tuple[np.ndarray, ...] | None:
    """(set, partner, equal values, more) of the best partners of each set of a region."""
    node, size, component, signatures = rows
    if len(node) < 2 or (component == component[0]).all():
        return None
    found = []
    for i in range(len(node)):
        equal = _equal_values(signatures, i)
        close = (equal >= LEAST_ESTIMATE * VALUES) & (component != component[i])
        close &= 100 * np.minimum(size, size[i]) >= SIMILARITY * np.maximum(size, size[i])
        at = np.flatnonzero(close)
        more = len(at) > most
        if more:
            at = at[np.lexsort((node[at], -equal[at]))[:most]]
        if len(at):
            found.append((np.full(len(at), node[i]), node[at], equal[at], np.full(len(at), more)))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else None


def _partners(most: int):
    """A mapInArrow function over rows sorted by region."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            region = columns[0]
            starts = np.flatnonzero(np.r_[True, region[1:] != region[:-1]]) if len(region) else []
            parts = [_partners_in(tuple(c[a:b] for c in columns[1:]), most) for a, b in zip(starts, [*starts[1:], len(region)])]
            parts = [p for p in parts if p is not None]
            if parts:
                a, b, equal, more = (np.concatenate(x) for x in zip(*parts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a), pa.array(b), pa.array(equal.astype(np.int32)), pa.array(more)], names=["a", "b", "equal", "more"]
                )

        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = [batch.column(c).to_numpy() for c in ("region", "node", "n_shingles", "component")]
            fresh.append(np.frombuffer(b"".join(batch.column("signature").to_pylist()), dtype=np.uint16).reshape(-1, VALUES))
            columns = fresh if held is None else [np.concatenate(x) for x in zip(held, fresh)]
            last = int(np.searchsorted(columns[0], columns[0][-1]))  # the last region may go on in the next batch
            yield from emit([c[:last] for c in columns])
            held = [c[last:] for c in columns]
        if held is not None:
            yield from emit(held)

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(t) for t in texts_of(batch.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([fingerprint(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
            names=["node", "shingles"],
        )


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for left, right in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist()):
            a, b = np.frombuffer(left, dtype=np.uint64), np.frombuffer(right, dtype=np.uint64)
            both = overlap(a, b)
            keep.append(100 * both >= SIMILARITY * (len(a) + len(b) - both))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in ("a", "b")], names=["a", "b"])


def _sets_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of the ``wanted`` nodes."""
    ids = written(nodes.join(wanted, "node", "left_semi").select("doc_id"), "needed")
    texts = narrowed(docs.select("doc_id", "text"), ids, "doc_id")
    hashed = texts.mapInArrow(_sets, "node long, shingles binary").join(wanted, "node", "left_semi")
    return written(hashed.groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")


def _settled(rows: DataFrame, sets: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links between the components of each region, on the full sets of all its rows, in ``sets`` or not."""
    rest = written(rows.select("node").distinct().join(sets.select("node"), "node", "left_anti"), "rest")
    if not rest.isEmpty():
        sets = sets.unionByName(_sets_of(docs, nodes, rest))
    whole = rows.join(sets, "node").select("region", "node", "component", "shingles")
    return whole.repartition("region").sortWithinPartitions("region").mapInArrow(_settle, "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(_confirm, "a long, b long")


def _links_in(node: np.ndarray, component: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between components of a region, by exact overlaps, until every linked pair is joined."""
    sizes = np.array([len(s) for s in sets])
    numbers, places = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    at = np.unique(component, return_inverse=True)[1]
    largest = np.bincount(at).argmax()
    links = []
    for i in np.flatnonzero(at != largest):  # every pair of components has a set outside the largest
        mine = np.zeros(len(numbers), dtype=np.int64)
        mine[places[starts[i] : starts[i] + sizes[i]]] = 1
        both = np.add.reduceat(mine[places], starts)
        for j in np.flatnonzero((100 * both >= SIMILARITY * (sizes + sizes[i] - both)) & (at != at[i])):
            if at[j] != at[i]:
                links.append((int(node[i]), int(node[j])))
                at[at == at[j]] = at[i]
    return links


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of whole regions, from rows sorted by region."""

    def emit(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        links = _links_in(
            np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), [np.frombuffer(r[3], dtype=np.uint64) for r in rows]
        )
        if links:
            a, b = zip(*links)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    held: list[tuple] = []
    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in ("region", "node", "component", "shingles")]):
            if held and held[0][0] != row[0]:
                yield from emit(held)
                held = []
            held.append(row)
    if held:
        yield from emit(held)


def _crossed(crowds: DataFrame, component: DataFrame, crowd: int) -> DataFrame:
    """(region, node, component): the open crowds as regions of two blocks each, so that every pair of components meets.

    Sets of a crowd's largest component are dealt into blocks of their own, as they need not meet
    each other.
    """
    rows = written(_open(crowds, component), "open")
    sizes = rows.groupBy("region", "component").agg(F.count(F.lit(1)).alias("_m"))
    most = sizes.groupBy("region").agg(
        F.max_by("component", F.struct("_m", "component")).alias("_c"), F.max("_m").alias("_m"), F.sum("_m").alias("_n")
    )
    inside = F.ceil(2 * F.col("_m") / crowd).cast("int")
    outside = F.ceil(2 * (F.col("_n") - F.col("_m")) / crowd).cast("int")
    is_inside = F.col("component") == F.col("_c")
    # Blocks are numbered from 0 outside the largest component and from -1 down inside it.
    block = F.when(is_inside, -1 - F.pmod(F.xxhash64("node", F.lit(2)), inside)).otherwise(F.pmod(F.xxhash64("node", F.lit(2)), outside))
    partners = F.when(is_inside, F.sequence(F.lit(0), outside - 1)).otherwise(F.sequence(-inside, outside - 1))
    dealt = rows.join(most, "region").select("region", "node", "component", block.alias("_b"), F.explode(partners).alias("_o"))
    pair = F.xxhash64("region", F.least("_b", "_o").cast("long"), F.greatest("_b", "_o").cast("long"))
    return _mixed(dealt.select(pair.alias("region"), "node", "component"))


def _open(members: DataFrame, component: DataFrame) -> DataFrame:
    """Rows of the regions that hold several components."""
    return _mixed(members.join(component, "node"))


def _mixed(rows: DataFrame) -> DataFrame:
    mixed = rows.groupBy("region").agg(F.min("component").alias("_a"), F.max("component").alias("_b")).where("_a <> _b")
    return rows.join(mixed.select("region"), "region", "left_semi")


def classes(docs: DataFrame, crowd: int = CROWD, partners: tuple[int, ...] = PARTNERS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text; others are ignored).

    ``component_id`` is the least id of all documents reachable over links of 75 % or more. Equal
    sets are one node of the graph, so copies cost one row each. Documents without words, null
    texts and rows without an id are linked with nothing: their component is their own id.
    Repeated rows get equal results; an empty table gives an empty one.
    """
    return _judged(docs, crowd, partners).drop("content")


def _judged(docs: DataFrame, crowd: int = CROWD, partners: tuple[int, ...] = PARTNERS) -> DataFrame:
    """``classes`` with content, a hash of the text that tells rows with one id apart."""
    sketches = written(
        docs.select("doc_id", F.xxhash64("text").alias("content"), "text").mapInArrow(
            _sketch, "doc_id long, content long, n_shingles long, node long, signature binary"
        ),
        "sketches",
    )
    nodes = written(
        sketches.where("node is not null and doc_id is not null").groupBy("node").agg(
            F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")
        ),
        "nodes",
    )
    members, crowds = regions(nodes, crowd)
    members = written(members, "members")
    component = nodes.select("node", F.col("node").alias("component"))
    sets = tried = unsettled = None
    for most in partners:
        rows = members.join(component, "node") if tried is None else _open(members, component)
        described = rows.join(nodes.select("node", "n_shingles", "signature"), "node")
        sorted_ = described.repartition("region").sortWithinPartitions("region").select(
            "region", "node", "n_shingles", "component", "signature"
        )
        found = sorted_.mapInArrow(_partners(most), "a long, b long, equal int, more boolean").groupBy("a", "b").agg(
            F.max("equal").alias("equal"), F.max("more").alias("more")
        )
        best = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("equal"), "b"))
        found = written(found.withColumn("_place", best), "partners")
        unsettled = found.where(F.col("more") | (F.col("_place") > most)).select(F.col("a").alias("node")).distinct()
        pairs = found.where(F.col("_place") <= most).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = written(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        if sets is None:  # every later pair is among these sets, as its signatures are as close
            needed = found.select(F.col("a").alias("node")).union(found.select("b")).distinct()
            sets = _sets_of(docs, nodes, needed)
        fresh = written(_confirmed(pairs, sets), "confirmed")
        tried = pairs if tried is None else tried.unionByName(pairs)
        component = written(merged_components(component, fresh), "components")
    unsettled = written(unsettled, "unsettled")
    if not unsettled.isEmpty():
        # A region of which some set has untried partners is compared whole, on the sets themselves.
        rows = _open(members, component)
        at = rows.join(unsettled, "node", "left_semi").select("region").distinct()
        rows = written(rows.join(at, "region", "left_semi"), "whole")
        settled = _settled(rows, sets, docs, nodes)
        component = written(merged_components(component, written(settled, "settled")), "components")
    rows = written(_crossed(crowds, component, crowd), "crossed")
    if not rows.isEmpty():
        settled = _settled(rows, sets, docs, nodes)
        component = written(merged_components(component, written(settled, "settled")), "components")
    named = nodes.join(component, "node").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    labels = component.join(named, "component").select(F.col("node").alias("_node"), "component_id")
    usable = F.when(F.col("doc_id").isNotNull(), F.col("node"))
    return sketches.select("doc_id", "content", "n_shingles", usable.alias("_of")).join(labels, F.col("_of") == F.col("_node"), "left").select(
        "doc_id", "content", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def report(docs: DataFrame) -> DataFrame:
    """``classes`` with kept: whether the document is its component's least."""
    return classes(docs).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the first document of every component; columns as given.

    Of rows that share an id, those whose text is in an earlier document's component go; of the others one stays. Rows without an id all stay.
    """
    judged = _judged(docs).where("doc_id <> component_id")
    gone = judged.select(F.col("doc_id").alias("_gone"), F.col("content").alias("_content")).distinct()
    rows = docs.join(gone, (F.col("doc_id") == F.col("_gone")) & (F.xxhash64("text") == F.col("_content")), "left_anti")
    # Rows without an id all stay; they are spread by text, so that they are not one group.
    apart = F.when(F.col("doc_id").isNull(), F.xxhash64("text"))
    number = F.row_number().over(Window.partitionBy("doc_id", "_apart").orderBy(F.xxhash64("text")))
    marked = rows.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text", apart.alias("_apart")).withColumn("_n", number)
    return marked.where("_n = 1 or doc_id is null").select("_row.*")
