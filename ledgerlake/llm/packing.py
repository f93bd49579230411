"""Packing documents into batches of equal padded length.

Documents are cut into pieces of at most ``MAX_LENGTH`` words. From the histogram of piece lengths
over the whole table a dynamic program picks the ``BUCKETS`` boundaries that minimise padding in
total; a piece goes to the smallest bucket that holds it, and inside a bucket each batch takes as
many pieces as the word budget allows at the bucket's length.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import running_index, words

#: Longest piece in words. It also bounds the histogram that the driver reads.
MAX_LENGTH = 2048
BUCKETS = 8
#: Words in a batch, padding included.
BATCH_BUDGET = 32_768


def boundaries(histogram: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Upper bounds, rising, of at most ``buckets`` buckets with the least padding in total.

    Every bound is a length that occurs, since lowering a bound to the longest piece under it
    never adds padding. Ties go to the smaller last-but-one bound. Empty without lengths.
    """
    lengths = np.array(sorted(n for n in histogram if n > 0 and histogram[n] > 0), dtype=np.int64)
    if not len(lengths):
        return []
    counts = np.array([histogram[int(n)] for n in lengths], dtype=np.int64)
    # The words themselves are the same in any split, so the padded total is what to minimise.
    upto = np.concatenate([[0], np.cumsum(counts)])
    best = upto[1:] * lengths
    choices: list[np.ndarray] = []
    for _ in range(1, min(buckets, len(lengths))):
        start = np.concatenate([[0], best])[:-1]  # cost of everything before length i
        chosen = np.zeros(len(lengths), dtype=np.int64)
        fresh = np.empty_like(best)
        for last in range(len(lengths)):
            cost = start[: last + 1] + (upto[last + 1] - upto[: last + 1]) * lengths[last]
            chosen[last] = int(np.argmin(cost))
            fresh[last] = cost[chosen[last]]
        choices.append(chosen)
        best = fresh
    out, last = [], len(lengths) - 1
    for chosen in reversed(choices):
        out.append(int(lengths[last]))
        last = int(chosen[last]) - 1
        if last < 0:
            return out[::-1]
    out.append(int(lengths[last]))
    return out[::-1]


def pieces(docs: DataFrame, max_length: int = MAX_LENGTH, text: bool = False) -> DataFrame:
    """(doc_id, piece, start, length[, text]): every document cut after each ``max_length`` words.

    A document without words, or with a null text, is one piece of length 0. Repeated rows give
    repeated pieces. ``text`` adds the piece's words joined by single blanks.
    """
    listed = docs.select("doc_id", words(F.col("text")).alias("_w"))
    counted = listed.select("doc_id", "_w", F.size("_w").alias("_n"))
    parts = F.greatest(F.ceil(F.col("_n") / max_length), F.lit(1)).cast("int")
    cut = counted.select("doc_id", "_w", "_n", F.explode(F.sequence(F.lit(0), parts - 1)).alias("piece"))
    start = F.col("piece") * max_length
    columns = [F.col("doc_id"), F.col("piece"), start.cast("long").alias("start")]
    columns.append(F.least(F.lit(max_length), F.col("_n") - start).cast("int").alias("length"))
    if text:
        columns.append(F.array_join(F.slice("_w", start + 1, F.lit(max_length)), " ").alias("text"))
    return cut.select(*columns)


def _first_holding(bounds: list[int], length: Column) -> Column:
    out = F.lit(None).cast("int")
    for number in reversed(range(len(bounds))):
        out = F.when(length <= bounds[number], F.lit(number)).otherwise(out)
    return F.when(length > 0, out)


def pack(cut: DataFrame, buckets: int = BUCKETS, budget: int = BATCH_BUDGET, max_length: int = MAX_LENGTH) -> DataFrame:
    """``cut`` with bucket, bucket_length, batch and place.

    ``batch`` numbers the batches of a bucket from 0 and ``place`` the pieces of a batch. Pieces of
    length 0 belong to no bucket: these four are null. The histogram has at most ``max_length``
    rows; numbering runs over slices of a bucket, so a bucket may hold any share of the pieces. A
    batch holds at least one piece even if the budget is below its length.
    """
    histogram = cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).where(F.col("length").between(1, max_length))
    bounds = boundaries({r["length"]: r["n"] for r in histogram.collect()}, buckets)
    tagged = cut.withColumn("bucket", _first_holding(bounds, F.col("length")))
    limits = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array(F.lit(0))
    at = F.when(F.col("bucket").isNotNull(), F.element_at(limits, F.col("bucket") + 1))
    numbered = running_index(tagged, ["bucket"], [], ["doc_id", "piece"], ["doc_id", "piece"], slices=1024)
    each = F.greatest(F.floor(F.lit(budget) / at), F.lit(1))
    return numbered.select(
        *cut.columns, "bucket", at.alias("bucket_length"),
        F.when(at.isNotNull(), F.floor(F.col("_index") / each)).cast("long").alias("batch"),
        F.when(at.isNotNull(), F.col("_index") % each).cast("int").alias("place"),
    )
