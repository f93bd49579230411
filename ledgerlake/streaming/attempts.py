"""Deliveries that may fail: attempts counted per message, and messages set aside after too many.

Every round tries the messages that came in and those that wait from the round before. A message
whose delivery raises waits for the next round with one more attempt and its reason; after
``MAX_ATTEMPTS`` it is set aside. Its neighbours are delivered at once.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ledgerlake.session import discard, kept_while, names_in

# ---- fixed value: deliveries of a message before it is set aside ----
MAX_ATTEMPTS = 5

_ADDED = "attempts int, error string"

# Workers get this module's functions with the task; they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Deliver = Callable[[pd.DataFrame], None]


def require_json(frame: pd.DataFrame) -> None:
    """A delivery that fails on payloads that are not JSON, and names them."""
    failed = []
    for place, payload in enumerate(frame["data"]):
        try:
            json.loads(payload)
        except Exception as e:
            failed.append((place, e))
    if failed:
        error = failed[0][1]
        error.undelivered = [(place, _reason(e)) for place, e in failed]
        raise error


def _reason(error: Exception) -> str:
    return f"{type(error).__name__}: {error}"


def _tried(deliver: Deliver) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Each message once more attempted; ``error`` is null where it was delivered.

    If what a chunk raises names the messages at fault, the others were delivered. Else the chunk
    is halved until those messages stand alone, so one of n messages costs about 2 log n more calls,
    all inside its own task.
    """

    def parts(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        messages = frame.drop(columns=["attempts", "error"])
        reasons = np.full(len(frame), None, dtype=object)
        waiting = [(0, len(frame))]
        while waiting:
            start, stop = waiting.pop()
            try:
                deliver(messages.iloc[start:stop])
            except Exception as e:  # whatever a delivery raises is the reason
                if named := getattr(e, "undelivered", None):
                    for place, reason in named:
                        reasons[start + place] = reason
                elif stop - start == 1:
                    reasons[start] = _reason(e)
                else:
                    middle = (start + stop) // 2
                    waiting += [(middle, stop), (start, middle)]
        yield frame.assign(error=reasons)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                frame = frame.assign(attempts=frame["attempts"] + 1)
                yield from parts(frame)

    return run


def attempted(messages: DataFrame, deliver: Deliver) -> DataFrame:
    """``messages`` (with attempts and error) after one more attempt; a null error means delivered."""
    return messages.mapInPandas(_tried(deliver), messages.schema)


def _with_attempts(messages: DataFrame) -> DataFrame:
    clash = {"attempts", "error"} & set(messages.columns)
    if clash:
        raise ValueError(f"messages already have columns {sorted(clash)}")
    return messages.withColumns({"attempts": F.lit(0), "error": F.lit(None).cast("string")})


def _schema(messages: StructType) -> StructType:
    return StructType([*messages.fields, *StructType.fromDDL(_ADDED).fields])


def _done(spark: SparkSession, path: str) -> list[str]:
    """Rounds that were written to their end, in order; what waits is written last in a round."""
    folder = f"{path}/waiting"
    rounds = [n.removeprefix("round=") for n in names_in(spark, folder) if n.startswith("round=")]
    return [r for r in rounds if "_SUCCESS" in names_in(spark, f"{folder}/round={r}")]


def _round(messages: DataFrame, deliver: Deliver, path: str, name: str, limit: int) -> None:
    spark, fields = messages.sparkSession, messages.schema
    before = [r for r in _done(spark, path) if r < name]
    tries = _with_attempts(messages)
    if before:
        tries = tries.unionByName(spark.read.schema(_schema(fields)).parquet(f"{path}/waiting/round={before[-1]}"))
    # The outcome is kept, so that a message is tried once however often the outcome is read.
    with kept_while(attempted(tries, deliver), "attempted") as tried:
        failed = F.col("error").isNotNull()
        aside = failed & (F.col("attempts") >= limit)
        tried.where(~failed).drop("error").write.mode("overwrite").parquet(f"{path}/delivered/round={name}")
        tried.where(aside).write.mode("overwrite").parquet(f"{path}/aside/round={name}")
        tried.where(failed & ~aside).write.mode("overwrite").parquet(f"{path}/waiting/round={name}")
    for old in before[:-1]:
        discard(spark, f"{path}/waiting/round={old}")


def deliver_stream(
    messages: DataFrame, deliver: Deliver, path: str, checkpoint: str, limit: int = MAX_ATTEMPTS
) -> StreamingQuery:
    """Deliver a stream of messages; every batch is a round, and retries what waits from the one before.

    Under ``path``, ``delivered``, ``aside`` and ``waiting`` hold a folder per round. A round reads
    only what waits from the last complete round before it and overwrites its own folders, so a replayed
    batch counts no attempt twice. ``deliver`` takes a pandas frame of messages and raises if any of them
    cannot be delivered; as with any at-least-once feed it may see a message again, after a lost task too.
    One that delivers what it can gives its exception a list ``undelivered`` of (place in the frame, reason):
    then only those wait, and none is searched for.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        _round(batch, deliver, path, f"{batch_id:012d}", limit)

    writer = messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def redeliver(spark: SparkSession, schema: StructType, deliver: Deliver, path: str, limit: int = MAX_ATTEMPTS) -> bool:
    """One round over what waits, while no batch runs; whether any message still waits after it.

    For feeds that fall silent: without a new batch nothing would be tried again. ``schema`` is the messages'.
    """
    rounds = _done(spark, path)
    if not rounds:
        return False
    batch, _, nth = rounds[-1].partition(".")
    name = f"{batch}.{int(nth or 0) + 1:06d}"
    _round(spark.createDataFrame([], schema), deliver, path, name, limit)
    return not spark.read.schema(_schema(schema)).parquet(f"{path}/waiting/round={name}").isEmpty()


def outcomes(spark: SparkSession, schema: StructType, path: str) -> DataFrame:
    """Every message with its attempts, reason and outcome: delivered, set aside, or waiting for the next round."""
    full, rounds = _schema(schema), _done(spark, path)

    def read(kind: str, outcome: str) -> DataFrame:
        # A round that is not complete counts for nothing yet; of what waits, only the last round does.
        last = f"round={rounds[-1]}"
        names = [n for n in names_in(spark, f"{path}/{kind}") if n <= last and (kind != "waiting" or n == last)]
        return spark.read.schema(full).parquet(*[f"{path}/{kind}/{n}" for n in names]).withColumn("outcome", F.lit(outcome))

    if not rounds:
        return spark.createDataFrame([], full).withColumn("outcome", F.lit(""))
    return read("delivered", "delivered").unionByName(read("aside", "set aside")).unionByName(read("waiting", "waiting"))
