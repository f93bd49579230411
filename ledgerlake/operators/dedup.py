"""First-arrival de-duplication, insert-only upserts and the bronze-to-silver backstop."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.operators.ranking import latest_per_key
from ledgerlake.operators.validate import check_messages, conform

# Workers get this module's functions with the task; they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def first_arrivals(
    rows: DataFrame, key: str, arrival: Sequence[Column]
) -> DataFrame:
    """The first row of every key in arrival order: once per key, however long ago that was."""
    return latest_per_key(rows, [key], arrival)


def _passing(ttl: int):
    """Of (key, time) in order, those that pass; the last one that did is carried from chunk to chunk."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = 0
        for frame in frames:
            passes = []
            for sure, at in zip(frame["_sure"].to_numpy(), frame["_at"].to_numpy()):
                passed = sure or at - kept >= ttl
                if passed:
                    kept = at
                passes.append(passed)
            yield frame.loc[passes, ["_key", "_at", "_known"]]

    return run


def first_within_ttl(rows: DataFrame, key: str, at: str, tiebreak: str, ttl_seconds: int) -> DataFrame:
    """Rows that pass a filter which forgets a key ``ttl_seconds`` after it let the key through.

    The batch twin of the stream's de-duplication, by the clock ``at``: a row passes if no row of its key
    passed within the TTL before it; one exactly the TTL later passes, and rows that are dropped do not
    prolong it. Of rows at one time only the least ``tiebreak`` counts. A null key is a key like any other;
    rows of a null time count as one moment before all others, which blocks nothing. A TTL of 0 keeps
    every row.

    Rows at one time are thinned inside the map tasks. A row at least the TTL behind the one before it
    passes by a window alone; the others depend on what passed before them, so each key's times, 8 bytes
    each, run in order through a task that remembers one of them, whatever the key's size.
    """
    if ttl_seconds == 0:
        return rows
    ttl = ttl_seconds * 1_000_000
    first = latest_per_key(rows, [key, at], [F.asc(tiebreak)])
    times = first.select(
        F.col(key).alias("_key"), F.coalesce(F.unix_micros(at), F.lit(0)).alias("_at"), F.col(at).isNotNull().alias("_known")
    ).repartition("_key")
    gap = F.col("_at") - F.lag(F.when(F.col("_known"), F.col("_at"))).over(Window.partitionBy("_key").orderBy("_known", "_at"))
    ordered = times.withColumn("_sure", F.coalesce(gap >= ttl, F.lit(True))).sortWithinPartitions("_key", "_known", "_at")
    passed = ordered.mapInPandas(_passing(ttl), ordered.drop("_sure").schema)
    same = (
        F.col(key).eqNullSafe(F.col("_key")) & (F.coalesce(F.unix_micros(at), F.lit(0)) == F.col("_at"))
        & (F.col(at).isNotNull() == F.col("_known"))
    )
    return first.join(passed, same, "left_semi")


def missing_rows(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Rows of ``source`` whose key ``target`` lacks: the inserts of an insert-only upsert."""
    return source.join(target.select(key), key, "left_anti")


def reconcile(bronze: DataFrame, silver: DataFrame) -> DataFrame:
    """Sound bronze messages that never reached silver, one per idempotency key."""
    sound = conform(check_messages(bronze), "message_id", "publish_time")
    once = first_arrivals(sound, "idempotency_key", [F.asc("publish_time"), F.asc("message_id")])
    return missing_rows(once, silver, "idempotency_key")
