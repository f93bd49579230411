"""Hard negatives by an inverted multi-index over exact integer inner products.

A vector is cut into two halves, each with a codebook; the nearest codes of both halves name its cell.
The index keeps every row, in blocks that follow the cells: small cells share a block and a large
cell is dealt over several. For an anchor, a half's bound is its product with the code plus its norm
times the code's radius, the largest distance of any row from that code. A heap visits
the cells by the sum of both bounds, from the largest down, and stops at the first cell whose
bound lies under what the anchor has already found: no row beyond can be among its results. Anchors first look
into their best cells, which gives that limit, and then into all cells above it; first for
their positives, then for the windows under each positive's score.
"""

from __future__ import annotations

import heapq
import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import unit_hash
from ledgerlake.session import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCALE = 256
K = 5
ANCHOR_EVERY = 100
#: Rows whose label the report moves on by one, of so many labels.
MOVED_EVERY, LABELS = 7, 10
#: A window reaches from this percentage of the positive's score up to the score itself.
LEAST_PERCENT = 80
#: Codes of each half; rows that the codebooks are fitted to, those with the least hash of their id.
CODES = 32
SAMPLE = 16_384
#: Rows in a block at most, on average; anchors that meet a block in one task.
BLOCK_ROWS = 16_384
ANCHOR_ROWS = 512
#: Rows in an anchor's first cells.
FIRST_ROWS = 2_048
_ROUNDS = 10
_EXACT = 1 << 53
_LONG = 1 << 63
_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


class Book(NamedTuple):
    """Codes (codes, width of the half) and radii of both halves, and where each cell's rows lie."""

    codes: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    rows: np.ndarray  # (codes, codes): rows of each cell
    first: np.ndarray  # its first block
    blocks: np.ndarray  # how many


def quantised(embeddings: DataFrame, label: Column | None = None) -> DataFrame:
    """(vec_id, label, parts): the rows that take part, components as the integers floor(256 x).

    Left out: null ids, labels and vectors, and vectors with a null or non-finite component. Components
    of 2^62 / 256 and more stop the job with an error.
    """
    sound = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    whole = lambda x: F.floor(x.cast("double") * SCALE)
    small = lambda x: F.abs(x.cast("double") * SCALE) < float(1 << 62)
    parts = F.transform(
        "embedding", lambda x: F.when(small(x), whole(x)).otherwise(F.raise_error(F.lit("a component is too large for 64 bits")))
    )
    rows = embeddings.select("vec_id", (F.col("label") if label is None else label).cast("long").alias("label"), "embedding")
    kept = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & sound)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), "label", parts.alias("parts"))


def _matrix(column, width: int, kind=np.int64) -> np.ndarray:
    """Lists as rows of a matrix, shorter ones filled up with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width), dtype=kind)
    out[np.arange(width) < lengths[:, None]] = lists.flatten().to_numpy()
    return out


def _nearest(points: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each point's nearest code and its distance from it."""
    squares = (codes * codes).sum(axis=1)
    code = np.argmin(squares - 2 * (points @ codes.T), axis=1)
    return code, np.sqrt(((points - codes[code]) ** 2).sum(axis=1))


def codebook(points: np.ndarray, codes: int, seed: int) -> np.ndarray:
    """Centres of a half's sample by k-means; fewer if it has fewer different points."""
    different = np.unique(points, axis=0)
    rng = np.random.default_rng(seed)
    centres = different[np.sort(rng.choice(len(different), min(codes, len(different)), replace=False))]
    for _ in range(_ROUNDS):
        code, _ = _nearest(points, centres)
        counts = np.bincount(code, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, code, points)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def _halves(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    middle = values.shape[1] // 2
    return values[:, :middle].astype(np.float64), values[:, middle:].astype(np.float64)


def _assign(width: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [_nearest(points, codes) for points, codes in zip(_halves(_matrix(batch.column("parts"), width)), shared.value)]
            extra = [near[0][0].astype(np.int32), near[1][0].astype(np.int32), near[0][1], near[1][1]]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *map(pa.array, extra)], names=[*batch.schema.names, "left", "right", "left_far", "right_far"]
            )

    return run


def plan(cells: list, codes: tuple[np.ndarray, np.ndarray], block_rows: int) -> Book:
    """Radii and blocks from one row per filled cell: (left, right, n, left_far, right_far)."""
    shape = len(codes[0]), len(codes[1])
    rows, first, blocks = (np.zeros(shape, dtype=np.int64) for _ in range(3))
    radii = np.zeros(shape[0]), np.zeros(shape[1])
    at, room = -1, 0
    for left, right, n, left_far, right_far in sorted(tuple(c) for c in cells):
        rows[left, right] = n
        radii[0][left] = max(radii[0][left], left_far)
        radii[1][right] = max(radii[1][right], right_far)
        if n > room:
            at, room = at + 1, block_rows
        first[left, right], blocks[left, right] = at, max(1, -(-n // block_rows))
        at += int(blocks[left, right]) - 1
        room = room - n if n <= room else 0
    return Book(codes, radii, rows, first, blocks)


def visits(vector: np.ndarray, book: Book) -> Iterator[tuple[float, float, int, int]]:
    """Filled cells as (upper bound, lower bound, left, right), by upper bound from the largest down.

    No row of a cell has a product with ``vector`` outside its bounds.
    """
    sides = []
    for half, codes, radii in zip(_halves(vector[None]), book.codes, book.radii):
        product, reach = codes @ half[0], np.linalg.norm(half[0]) * radii
        order = np.argsort(-(product + reach), kind="stable")
        sides.append((order, (product + reach)[order].tolist(), (product - reach)[order].tolist()))
    (left, high_left, low_left), (right, high_right, low_right) = sides
    slack = 0.5 + 1e-9 * (abs(high_left[0]) + abs(high_right[0]) + abs(low_left[-1]) + abs(low_right[-1]))
    heap = [(-(high_left[0] + high_right[0]), 0, 0)]
    while heap:
        bound, s, t = heapq.heappop(heap)
        if t == 0 and s + 1 < len(left):
            heapq.heappush(heap, (-(high_left[s + 1] + high_right[0]), s + 1, 0))
        if t + 1 < len(right):
            heapq.heappush(heap, (-(high_left[s] + high_right[t + 1]), s, t + 1))
        i, j = int(left[s]), int(right[t])
        if book.rows[i, j]:
            yield -bound + slack, low_left[s] + low_right[t] - slack, i, j


def _blocks_of(vector: np.ndarray, book: Book, first_rows: int, least: int | None, most: int | None, rest: bool) -> list[int]:
    """Blocks of the first cells, or (``rest``) of the other cells that may hold a score from ``least`` to ``most``."""
    begun: set[int] = set()
    out: set[int] = set()
    seen = 0
    for high, low, i, j in visits(vector, book):
        here = range(int(book.first[i, j]), int(book.first[i, j] + book.blocks[i, j]))
        if seen < first_rows:
            begun.update(here)
            seen += int(book.rows[i, j])
        elif not rest or (least is not None and high < least):
            break
        elif most is None or low <= most:
            out.update(here)
    return sorted(out - begun) if rest else sorted(begun)


def _route(width: int, shared, first_rows: int, rest: bool):
    schema = pa.schema([("row", pa.int64()), ("block", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            least, most = batch.column("least").to_pylist(), batch.column("most").to_pylist()
            for row, vector, low, high in zip(batch.column("row").to_pylist(), _matrix(batch.column("parts"), width), least, most):
                blocks = _blocks_of(vector, shared.value, first_rows, low, high, rest)
                rows += [row] * len(blocks)
                found += blocks
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(found, pa.int64())], schema=schema)

    return run


def _pack(width: int, kind: str):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("vec_id", "ascending"), ("row", "ascending")])
        raw = [table.column(c).to_numpy().astype(np.int64).tobytes() for c in ("vec_id", "row", "label")]
        raw.append(_matrix(table.column("parts"), width).astype(kind).tobytes())
        return pa.table({"block": table.column("block")[:1]} | {c: pa.array([x], pa.binary()) for c, x in zip(("ids", "rows", "labels", "parts"), raw)})

    return run


def _products(points: np.ndarray, vector: np.ndarray, largest: int) -> np.ndarray:
    """Exact inner products; ``points`` are doubles where all sums are whole numbers in those."""
    if largest < _EXACT:
        return (points @ vector.astype(np.float64)).astype(np.int64)
    if largest < _LONG:
        return points @ vector
    scores = points.astype(object) @ vector.astype(object)
    if len(scores) and max(abs(int(s)) for s in scores) >= _LONG:
        raise OverflowError("a score does not fit in 64 bits")
    return scores.astype(np.int64)


def _first(scores: np.ndarray, inside: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` largest scores inside; of equal ones the first."""
    at = np.flatnonzero(inside)
    if len(at) > k:
        held = scores[at]
        least = np.partition(held, len(held) - k)[len(held) - k]
        at = at[held >= least]
        at = at[np.argsort(-scores[at], kind="stable")][:k]
    return at


def _scan(width: int, kind: str, largest: int, k: int):
    schema = pa.schema([("row", pa.int64()), ("slot", pa.int32()), ("vec_id", pa.int64()), ("found", pa.int64()), ("score", pa.int64())])

    def run(blocks: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if blocks.num_rows and anchors.num_rows:
            ids, rows, labels = (np.frombuffer(blocks.column(c)[0].as_py(), dtype=np.int64) for c in ("ids", "rows", "labels"))
            points = np.frombuffer(blocks.column("parts")[0].as_py(), dtype=kind).reshape(len(ids), width)
            points = points.astype(np.float64 if largest < _EXACT else np.int64)
            vectors = _matrix(anchors.column("parts"), width)
            for row, label, vector, windows in zip(
                anchors.column("row").to_pylist(), anchors.column("label").to_pylist(), vectors, anchors.column("windows").to_pylist()
            ):
                scores = _products(points, vector, largest)
                if windows is None:
                    asked = [(-1, (labels == label) & (rows != row))]
                else:
                    other = labels != label
                    asked = [(w["slot"], other & (scores >= w["low"]) & (scores <= w["high"])) for w in windows]
                for slot, inside in asked:
                    for at in _first(scores, inside, k).tolist():
                        out.append((row, slot, int(ids[at]), int(rows[at]), int(scores[at])))
        columns = list(zip(*out)) if out else [[]] * len(schema)
        return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(columns, schema.types)], schema=schema)

    return run


class Index:
    """Every row of ``rows`` (vec_id, label, parts) in blocks that follow the cells."""

    def __init__(self, rows: DataFrame, codes: int = CODES, sample: int = SAMPLE, block_rows: int = BLOCK_ROWS, first_rows: int = FIRST_ROWS):
        self.spark: SparkSession = rows.sparkSession
        self.first_rows = first_rows
        numbered = written(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
        shape = numbered.agg(
            F.count(F.lit(1)).alias("n"), F.max(F.size("parts")).alias("width"),
            F.min(F.array_min("parts")).alias("low"), F.max(F.array_max("parts")).alias("high"),
        ).first()
        self.size = shape["n"]
        if not self.size:
            return
        self.width = max(shape["width"], 2)
        most = max(-(shape["low"] or 0), shape["high"] or 0)
        self.largest = self.width * most * most
        self.kind = next(f"int{b}" for b in (16, 32, 64) if most < 1 << (b - 1))
        fitted = numbered.orderBy(unit_hash(F.col("vec_id")), "vec_id", "row").limit(sample).select("parts").toArrow()
        halves = _halves(_matrix(fitted.column("parts"), self.width))
        books = tuple(codebook(points, codes, seed) for seed, points in enumerate(halves))
        context = self.spark.sparkContext
        schema = "vec_id long, label long, parts array<long>, row long, left int, right int, left_far double, right_far double"
        placed = written(numbered.mapInArrow(_assign(self.width, context.broadcast(books)), schema), "placed")
        cells = placed.groupBy("left", "right").agg(F.count(F.lit(1)), F.max("left_far"), F.max("right_far")).collect()
        self.book = plan(cells, books, block_rows)
        where = self.spark.createDataFrame(
            [(int(i), int(j), int(self.book.first[i, j]), int(self.book.blocks[i, j])) for i, j in zip(*np.nonzero(self.book.rows))],
            "left int, right int, _first long, _blocks long",
        )
        dealt = placed.join(F.broadcast(where), ["left", "right"]).withColumn(
            "block", F.col("_first") + F.pmod(F.xxhash64("row"), F.col("_blocks"))
        )
        self.blocks = written(
            dealt.select("block", "vec_id", "row", "label", "parts").groupBy("block").applyInArrow(
                _pack(self.width, self.kind), "block long, ids binary, rows binary, labels binary, parts binary"
            ),
            "blocks",
        )
        self.rows = numbered
        self.shared = context.broadcast(self.book)

    def search(self, anchors: DataFrame, groups: int, rest: bool, k: int) -> tuple[DataFrame, DataFrame]:
        """What each anchor finds in the blocks it visits, and those (row, block) visits.

        ``anchors`` has row, label, parts, windows, least and most. Without windows the best ``k`` other
        rows of its label are found (slot -1); with windows (slot, low, high) the best of
        other labels inside each.
        """
        routed = anchors.select("row", "parts", "least", "most").mapInArrow(
            _route(self.width, self.shared, self.first_rows, rest), "row long, block long"
        )
        pairs = written(routed.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups))), "visits")
        visits = pairs.select("row", F.col("block").alias("_block"), F.col("group").alias("_group"))
        asked = visits.join(anchors.select("row", "label", "parts", "windows"), "row")
        spread = pairs.select("block", "group").distinct().join(self.blocks, "block")
        found = spread.groupBy("block", "group").cogroup(asked.groupBy("_block", "_group")).applyInArrow(
            _scan(self.width, self.kind, self.largest, k), "row long, slot int, vec_id long, found long, score long"
        )
        return written(found, "found"), pairs


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("row", "slot").orderBy(F.desc("score"), "vec_id", "found")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _limit(best: DataFrame, k: int, floor: Column) -> DataFrame:
    """(row, slot, least): the score that a later find must reach, the k-th so far or else ``floor``."""
    kth = F.max(F.when(F.col("place") == k, F.col("score")))
    return best.groupBy("row", "slot").agg(F.coalesce(kth, F.max(floor)).alias("least"))


def mine(rows: DataFrame, is_anchor: Column, k: int = K, least_percent: int = LEAST_PERCENT, **shape: int) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every anchor of ``rows``.

    ``rows`` comes from :func:`quantised`. Every row is one of its own, also where an id or a whole row
    repeats: an anchor's positives are its best ``k`` other rows of its label, and per positive the best
    ``k`` rows of another label from ``least_percent`` of its score up to it follow. Equal
    scores go to the least id. Anchors without positives, and positives without
    negatives, are in no result; no rows give an empty one. Scores that leave 64 bits stop the job.
    """
    return mined(Index(rows, **shape), is_anchor, k, least_percent)[0]


def mined(index: Index, is_anchor: Column, k: int = K, least_percent: int = LEAST_PERCENT) -> tuple[DataFrame, list[DataFrame]]:
    """:func:`mine` over an index, and the (row, block) visits of its four searches."""
    if not index.size:
        return index.spark.createDataFrame([], _RESULT), []
    nothing = F.lit(None).cast("long")
    none = F.lit(None).cast("array<struct<slot:int,low:bigint,high:bigint>>")
    anchors = index.rows.where(is_anchor).select("row", "vec_id", "label", "parts")
    groups = max(1, -(-anchors.count() // ANCHOR_ROWS))

    base = anchors.select("row", "label", "parts", none.alias("windows"), nothing.alias("least"), nothing.alias("most"))
    begun, first_visits = index.search(base, groups, False, k)
    limits = _limit(_best(begun, k), k, nothing).select("row", F.col("least").alias("_least"))
    narrowed = base.join(limits, "row", "left").withColumn("least", F.col("_least")).drop("_least")
    ended, rest_visits = index.search(narrowed, groups, True, k)
    positives = written(_best(begun.unionByName(ended), k).select("row", "place", F.col("vec_id").alias("positive_id"), "score"), "positives")

    low = F.ceil(F.col("score") * F.lit(least_percent).cast("decimal(3,0)") / F.lit(100).cast("decimal(3,0)")).cast("long")
    window = F.struct(F.col("place").cast("int").alias("slot"), low.alias("low"), F.col("score").alias("high"))
    asked = positives.where("score >= 0").groupBy("row").agg(F.sort_array(F.collect_list(window)).alias("windows"))
    wanted = written(
        anchors.select("row", "label", "parts").join(asked, "row")
        .withColumn("least", F.array_min(F.transform("windows", lambda w: w["low"])))
        .withColumn("most", F.array_max(F.transform("windows", lambda w: w["high"]))),
        "windows",
    )
    near, near_visits = index.search(wanted, groups, False, k)
    each = wanted.select("row", F.explode("windows").alias("_w")).select("row", F.col("_w.slot").alias("slot"), F.col("_w.low").alias("low"))
    best = each.join(_best(near, k).select("row", "slot", "place", "score"), ["row", "slot"], "left")
    reached = _limit(best, k, F.col("low")).groupBy("row").agg(F.min("least").alias("_least"))
    far, far_visits = index.search(
        wanted.join(reached, "row").withColumn("least", F.col("_least")).drop("_least"), groups, True, k
    )
    negatives = _best(near.unionByName(far), k).select(
        "row", "slot", F.col("place").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")
    )
    paired = positives.select("row", F.col("place").cast("int").alias("slot"), "positive_id", F.col("score").alias("positive_score"))
    out = negatives.join(paired, ["row", "slot"]).join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
    columns = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return out.select(*columns), [first_visits, rest_visits, near_visits, far_visits]


def report(embeddings: DataFrame, **shape: int) -> DataFrame:
    """Hard negatives of every row whose id is divisible by ``ANCHOR_EVERY``.

    Rows whose id is divisible by ``MOVED_EVERY`` take the next of the ``LABELS`` labels first.
    """
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % MOVED_EVERY == 0, (label + 1) % LABELS).otherwise(label)
    return mine(quantised(embeddings, moved), F.col("vec_id") % ANCHOR_EVERY == 0, **shape)
