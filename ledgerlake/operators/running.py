"""Running totals and row numbers that stay balanced when one key holds a large share of the rows.

Both are prefix scans in three steps: a key's rows are cut into slices at sampled places of its
order, every slice is scanned by itself, and the sums of the slices before it are carried in. Where
a key is cut comes from the data, so neither a busy key nor a burst within one second is one task.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows drawn to find the places to cut, and those between two cuts at least: a slice's size then
#: strays from the others' by a sixth or so.
SAMPLE_ROWS = 8192
LEAST_DRAWN = 32
#: Rows of a slice, about, below which a key stays whole.
SLICE_ROWS = 100_000


def sliced(rows: DataFrame, key: str, order: list[str], slice_rows: int = SLICE_ROWS) -> DataFrame | None:
    """``rows`` with ``_slice``: 0, 1, ... along ``order`` within each key; equal places share a slice.

    None if no key is large enough to be cut.

    One pass draws a bounded sample; the largest of its random numbers tells how many rows there
    are. Only keys with more than about ``slice_rows`` rows are cut, so the table of cuts has at
    most ``SAMPLE_ROWS`` / ``LEAST_DRAWN`` entries and is broadcast. What the sample holds decides
    the balance of the slices, never a result.
    """
    spot = F.struct(*order)
    drawn = rows.select(F.col(key).alias("_key"), spot.alias("_at"), F.rand(7).alias("_r")).orderBy("_r").limit(SAMPLE_ROWS)
    sample = drawn.collect()
    total = len(sample) if len(sample) < SAMPLE_ROWS else len(sample) / max(sample[-1]["_r"], 1e-18)
    step = max(LEAST_DRAWN, -(-len(sample) * slice_rows // max(int(total), 1)))
    if max(Counter(r["_key"] for r in sample).values(), default=0) < 2 * step:
        return None
    held = rows.sparkSession.createDataFrame([(r["_key"], r["_at"]) for r in sample], drawn.drop("_r").schema)
    places = held.groupBy("_key").agg(F.sort_array(F.collect_list("_at")).alias("_all")).where(F.size("_all") >= 2 * step)
    cuts = places.select(
        "_key", F.transform(F.sequence(F.lit(step), F.size("_all") - 1, F.lit(step)), lambda i: F.get("_all", i)).alias("_cuts")
    )
    joined = rows.join(F.broadcast(cuts), F.col(key).eqNullSafe(F.col("_key")), "left")
    before = F.size(F.filter("_cuts", lambda c: c < spot))
    return joined.withColumn("_slice", F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(before)).drop("_key", "_cuts")


def _before(parts: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """(_k, _s, out): the sum of ``value`` over a key's earlier slices, one row per key and slice."""
    earlier = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.coalesce(F.sum(value).over(earlier), F.lit(0))
    return parts.select(F.col(key).alias("_k"), F.col("_slice").alias("_s"), carried.alias(out))


def _same_slice(key: str) -> Column:
    return F.col(key).eqNullSafe(F.col("_k")) & (F.col("_slice") == F.col("_s"))


def running_total(rows: DataFrame, key: str, order: str, delta: Column, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Running sum of ``delta`` per ``key`` ordered by ``order``; equal times share one value.

    The result has one row per (key, time): ``running``, and ``n``, the rows at that time. It equals a
    window over the key with the default RANGE frame, nulls first. Rows of one key and time are summed,
    mostly before the shuffle; the sums run inside each (key, slice), and slice totals, one small
    row per key and slice, give the balance carried into a slice.
    """
    deltas = rows.select(F.col(key), F.col(order), delta.alias("_delta"))
    cut = sliced(deltas, key, [order], slice_rows)
    if cut is None:
        whole = deltas.groupBy(key, order).agg(F.sum("_delta").alias("_delta"), F.count(F.lit(1)).alias("n"))
        running = F.sum("_delta").over(Window.partitionBy(key).orderBy(order))
        return whole.select(key, order, "n", running.alias("running"))
    ticks = cut.groupBy(key, "_slice", order).agg(F.sum("_delta").alias("_delta"), F.count(F.lit(1)).alias("n"))
    # Both aggregates are kept so that this branch and the detail share one exchange.
    totals = ticks.groupBy(key, "_slice").agg(F.sum("_delta").alias("_total"), F.sum("n").alias("_rows"))
    carried = _before(totals.where(F.col("_rows") > 0), key, "_total", "_carried")
    inside = Window.partitionBy(key, "_slice").orderBy(order)
    return (
        ticks.withColumn("_inside", F.sum("_delta").over(inside))
        .join(carried, _same_slice(key))
        .select(key, order, "n", (F.col("_inside") + F.col("_carried")).alias("running"))
    )


def row_numbers(
    rows: DataFrame, key: str, order: str, tiebreak: str, out: str = "rn", slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Position of every row in its key by (``order``, ``tiebreak``), from 1.

    Rows are numbered inside (key, slice) and shifted by the counts of the key's earlier slices. Slices
    follow the tiebreak too, so many rows at one time are spread like any others.
    """
    cut = sliced(rows, key, [order, tiebreak], slice_rows)
    if cut is None:
        return rows.withColumn(out, F.row_number().over(Window.partitionBy(key).orderBy(order, tiebreak)))
    before = _before(cut.groupBy(key, "_slice").agg(F.count(F.lit(1)).alias("_n")), key, "_n", "_before")
    inside = Window.partitionBy(key, "_slice").orderBy(order, tiebreak)
    return (
        cut.withColumn("_inside", F.row_number().over(inside))
        .join(before, _same_slice(key))
        .withColumn(out, F.col("_before") + F.col("_inside"))
        .drop("_slice", "_inside", "_before", "_k", "_s")
    )
