"""Exact top-k search by integer inner product over a bit-sliced index.

Components become the integers floor(256 x). Rows are dealt into blocks; in a block every component
is a column of bit slices, one bitmap over the block's rows per binary digit. A query's inner
products with all rows of a block are one sum of shifted slices, added up by carry-save adders on
whole bitmaps; for a negative weight the slices are complemented. From the most significant slice of
the sum down, rows are split into those that are certainly among the best and those tied with the
boundary; ties left at the last slice go to the least ids. Each block sends its best ``k``.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.session import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCALE = 256
#: Rows in a block of the index, on average, and queries that a task takes at once.
BLOCK_ROWS = 32_768
QUERY_ROWS = 512
#: Integers are of 64 bits; sums of their products are as wide as they need be.
LIMIT = 1 << 63
K = 5
EVERY = 50


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, parts): one row per id that takes part.

    Left out: null ids and vectors, and vectors with a null or non-finite component. A component whose
    integer leaves 64 bits stops the job. Rows that repeat an id are one; of different vectors the least counts.
    """
    fits = lambda x: (x.cast("double") * SCALE < float(LIMIT)) & (x.cast("double") * SCALE >= -float(LIMIT))
    wide = F.transform(
        F.col(embedding),
        lambda x: F.when(fits(x), F.floor(x.cast("double") * SCALE)).otherwise(F.raise_error(F.lit("a component does not fit in 64 bits"))),
    )
    sound = F.forall(F.col(embedding), lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    rows = vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & sound)
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), wide.cast("array<long>").alias("parts")).groupBy("vec_id").agg(
        F.min("parts").alias("parts")
    )


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width), dtype=np.int64)
    out[np.arange(width) < lengths[:, None]] = lists.flatten().to_numpy()
    return out


def slices(values: np.ndarray, digits: int) -> np.ndarray:
    """(columns, digits, words): bitmaps over the rows of a matrix of whole numbers from 0."""
    rows, width = values.shape
    words = -(-rows // 64)
    out = np.zeros((width, digits, words * 8), dtype=np.uint8)
    for digit in range(digits):
        packed = np.packbits(((values >> digit) & 1).astype(np.uint8).T, axis=1, bitorder="little")
        out[:, digit, : packed.shape[1]] = packed
    return out.view(np.uint64)


def add_slices(index: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    """Slices, least significant first, of each row's sum of |weight| x value.

    Where a weight is negative the value's digits are complemented.
    """
    width, digits, words = index.shape
    heavy = weights.astype(np.uint64)
    heavy = np.where(weights < 0, np.uint64(0) - heavy, heavy)  # wraps to the absolute value
    flip = np.where(weights < 0, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
    places = int(heavy.max(initial=0)).bit_length()
    carried = np.empty((0, words), dtype=np.uint64)
    out: list[np.ndarray] = []
    level = 0
    while level < places + digits - 1 or len(carried):
        at = [carried]
        for digit in range(max(0, level - places + 1), min(digits, level + 1)):
            columns = np.flatnonzero((heavy >> (level - digit)) & 1)
            at.append(index[columns, digit] ^ flip[columns, None])
        here, up = np.concatenate(at), []
        while len(here) > 2:
            third = len(here) // 3
            a, b, c = here[:third], here[third : 2 * third], here[2 * third : 3 * third]
            either = a ^ b
            up.append((a & b) | (c & either))
            here = np.concatenate([either ^ c, here[3 * third :]])
        if len(here) == 2:
            up.append((here[0] & here[1])[None])
            here = (here[0] ^ here[1])[None]
        out.append(here[0] if len(here) else np.zeros(words, dtype=np.uint64))
        carried = np.concatenate(up) if up else np.empty((0, words), dtype=np.uint64)
        if len(carried) and not carried.any():
            carried = carried[:0]
        level += 1
    return out


def best_rows(sums: list[np.ndarray], allowed: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` allowed rows with the largest sums; of rows tied at the end, the first."""
    sure, tied = np.zeros_like(allowed), allowed.copy()
    for part in reversed(sums):
        grown = sure | (tied & part)
        found = int(np.bitwise_count(grown).sum())
        if found > k:
            tied &= part
        else:
            sure = grown
            tied &= ~part
            if found == k:
                break
    certain = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
    boundary = np.flatnonzero(np.unpackbits(tied.view(np.uint8), bitorder="little"))
    return np.concatenate([certain, boundary[: max(0, k - len(certain))]])


def _index_block(width: int, low: int, digits: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        # The differences fit in 64 bits without a sign.
        values = _matrix(table.column("parts"), width).astype(np.uint64) - np.uint64(low % (1 << 64))
        return pa.table(
            {
                "block": table.column("block")[:1],
                "ids": pa.array([table.column("vec_id").to_numpy().astype(np.int64).tobytes()], pa.binary()),
                "slices": pa.array([slices(values, digits).tobytes()], pa.binary()),
            }
        )

    return run


def _search_block(width: int, low: int, digits: int, k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(blocks: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if blocks.num_rows and queries.num_rows:
            ids = np.frombuffer(blocks.column("ids")[0].as_py(), dtype=np.int64)
            index = np.frombuffer(blocks.column("slices")[0].as_py(), dtype=np.uint64).reshape(width, digits, -1)
            present = np.packbits(np.ones(len(ids), dtype=np.uint8), bitorder="little")
            every = np.zeros(index.shape[2] * 8, dtype=np.uint8)
            every[: len(present)] = present
            every = every.view(np.uint64)
            most = (1 << digits) - 1
            for query, weights in zip(queries.column("query_id").to_pylist(), _matrix(queries.column("parts"), width)):
                sums = add_slices(index, weights)
                allowed = every
                own = int(np.searchsorted(ids, query))
                if own < len(ids) and ids[own] == query:
                    allowed = every.copy()
                    allowed[own // 64] &= ~np.uint64(1 << (own % 64))
                factors = weights.tolist()
                shift = most * sum(w for w in factors if w < 0) + low * sum(factors)
                for row in best_rows(sums, allowed, k).tolist():
                    total = sum(((int(s[row // 64]) >> (row % 64)) & 1) << i for i, s in enumerate(sums))
                    if not -LIMIT <= total + shift < LIMIT:
                        raise OverflowError(f"the score of {query} with {int(ids[row])} does not fit in 64 bits")
                    found.append((query, int(ids[row]), total + shift))
        columns = list(zip(*found)) if found else [[]] * len(schema)
        return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(columns, schema.types)], schema=schema)

    return run


def search(vectors: DataFrame, is_query: Column, k: int = K, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best other rows of every row of ``vectors`` that is a query.

    ``vectors`` comes from :func:`quantised` and ``is_query`` tells its queries. Shorter vectors
    count as filled up with zeros. Equal scores go to the least id; with fewer rows than ``k`` all
    are returned. No queries or rows give an empty result. ``score`` is exact; a best score of a block that
    leaves 64 bits stops the job. Queries and blocks are both split, so
    a task holds one block and one group of queries however many there are.
    """
    spark = vectors.sparkSession
    rows = written(vectors, "vectors")
    shape = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("queries"), F.max(F.size("parts")).alias("width"),
        F.min(F.array_min("parts")).alias("low"), F.max(F.array_max("parts")).alias("high"),
    ).first()
    if not shape["n"] or not shape["queries"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    low, high = min(shape["low"] or 0, 0), max(shape["high"] or 0, 0)
    width, digits = max(shape["width"], 1), max((high - low).bit_length(), 1)
    blocks, groups = -(-shape["n"] // block_rows), -(-shape["queries"] // query_rows)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    index = written(
        dealt.groupBy("block").applyInArrow(_index_block(width, low, digits), "block int, ids binary, slices binary"), "index"
    )
    asked = rows.where(is_query).select(
        F.col("vec_id").alias("query_id"), "parts", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(groups)).cast("int").alias("group"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
    )
    spread = index.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    found = spread.groupBy("block", "group").cogroup(asked.groupBy("block", "group")).applyInArrow(
        _search_block(width, low, digits, k), "query_id long, vec_id long, score long"
    )
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def report(embeddings: DataFrame) -> DataFrame:
    """The best five of every row whose id is divisible by ``EVERY``."""
    return search(quantised(embeddings), F.col("vec_id") % EVERY == 0)
