"""The ingest as Structured Streaming queries, through the batch validators.

Two queries read the source on their own checkpoints: one lands the raw messages, the
other validates, de-duplicates and writes silver rows and dead letters.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ledgerlake import schemas
from ledgerlake.operators.dedup import first_arrivals
from ledgerlake.operators.deident import deidentify_column
from ledgerlake.operators.validate import check_messages, conform, dead_letters, stamp_lineage
from ledgerlake.session import discard, file_system, kept_while, names_in
from ledgerlake.sources import merge

DEDUP_TTL_SECONDS = 3600


def unseen(rows: DataFrame, kept: DataFrame, arrived: datetime, ttl_seconds: int = DEDUP_TTL_SECONDS) -> DataFrame:
    """Of sound rows that arrived together, the first of each key that was not kept within the TTL.

    ``kept`` has the keys of earlier batches and the time each arrived: arrival is the clock of
    the ingest, never the time in the message, so a late or out-of-order message is judged like
    any other. Among deliveries of one batch the first by (publish_time, message_id) stays. The
    window takes one row per key and map task, so a key of any size is thinned before it is shuffled.
    A TTL of 0 keeps every row.
    """
    if ttl_seconds == 0:
        return rows
    first = first_arrivals(rows, "idempotency_key", [F.asc("publish_time"), F.asc("message_id")])
    recent = kept.where(F.col("arrived") > F.lit(arrived - timedelta(seconds=ttl_seconds)))
    return first.join(recent.select("idempotency_key"), "idempotency_key", "left_anti")


def land_bronze(messages: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append every raw message with its metadata, by publish day."""
    return (
        messages.withColumn("publish_date", F.to_date("publish_time"))
        .writeStream.format("parquet")
        .partitionBy("publish_date")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )


#: The folder that is there before any key is, so that the keys can always be read.
_NO_HOUR = 0


def _hour(at: datetime) -> int:
    return int(at.timestamp() // 3600)


_KEYS = "idempotency_key string, arrived timestamp, hour int, batch long"


def _kept_keys(spark: SparkSession, path: str, batch_id: int, since: datetime) -> DataFrame:
    """Keys that batches before ``batch_id`` kept from the hour of ``since`` on; older folders are not read."""
    keys = spark.read.schema(_KEYS).parquet(path)
    return keys.where((F.col("hour") >= _hour(since)) & (F.col("batch") < batch_id))


def drop_expired_keys(spark: SparkSession, path: str, since: datetime) -> list[int]:
    """Delete the hours of keys that all arrived before ``since``; planned from folder names, no row is read."""
    hours = [int(n.removeprefix("hour=")) for n in names_in(spark, path) if n.startswith("hour=")]
    old = [h for h in hours if _NO_HOUR < h < _hour(since)]
    for hour in old:
        discard(spark, f"{path}/hour={hour}")
    return old


def run_ingest(
    messages: DataFrame,
    silver_path: str,
    dlq_path: str,
    keys_path: str,
    checkpoint: str,
    ttl_seconds: int = DEDUP_TTL_SECONDS,
    source_system: str = "synthetic-generator",
    secret: str | None = None,
    rate: float = 0.1,
    continuous: str | None = None,
    clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc),
) -> StreamingQuery:
    """Start the validating query: drains the source and stops, or runs every ``continuous`` interval.

    A batch is checked once: its rows wait in a scratch folder until they are dealt to the tables. Rejected
    messages go to the dead letters, all of them, before anything is de-duplicated. Of sound ones
    :func:`unseen` rows become silver; their keys are written under ``keys_path`` by hour of arrival, a
    batch reads the hours within its TTL only, and hours that no later batch can need are deleted, so
    the keys on disk are those of one TTL. How much a batch takes is the source's matter
    (``maxFilesPerTrigger`` and the like). Everything a batch writes goes under its own number with
    overwrite and it never reads its own keys, so silver and dead letters of a replay replace
    what the failed attempt left; keys that such an attempt left under an earlier hour are the same ones.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, arrived = batch.sparkSession, clock()
        since = arrived - timedelta(seconds=ttl_seconds)
        target = f"{silver_path}/batch={batch_id}"
        with kept_while(check_messages(batch), "checked") as checked:
            dead_letters(checked).write.mode("overwrite").parquet(f"{dlq_path}/batch={batch_id}")
            kept = conform(checked, "message_id", "publish_time")
            if ttl_seconds:
                none = spark.createDataFrame([], "idempotency_key string, arrived timestamp")
                none.write.mode("overwrite").parquet(f"{keys_path}/hour={_NO_HOUR}/batch=-1")
                kept = unseen(kept, _kept_keys(spark, keys_path, batch_id, since), arrived, ttl_seconds)
            if secret is not None:
                kept = deidentify_column(kept, "counterparty_account", "idempotency_key", secret, rate)
            silver = stamp_lineage(kept, source_system).select(*schemas.TRANSACTION.names)
            silver.withColumn("event_date", F.to_date("event_time")).write.mode("overwrite").partitionBy("event_date").parquet(target)
        if ttl_seconds:
            names = spark.read.schema(schemas.TRANSACTION).parquet(target).select("idempotency_key")
            fresh = names.withColumn("arrived", F.lit(arrived))
            fresh.write.mode("overwrite").parquet(f"{keys_path}/hour={_hour(arrived)}/batch={batch_id}")
            drop_expired_keys(spark, keys_path, since)

    writer = messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": continuous} if continuous else {"availableNow": True}
    return writer.trigger(**trigger).start()


# ---- health of the feed ----

# ---- fixed values: service levels ----
SILVER_LAG_SECONDS = 900
STREAM_LAG_SECONDS = 300


def freshness(silver: DataFrame) -> DataFrame:
    """Lag of silver behind the events: of the newest rows, the average, and the worst row."""
    lag = F.unix_seconds("ingest_time") - F.unix_seconds("event_time")
    return silver.agg(
        (F.unix_seconds(F.max("ingest_time")) - F.unix_seconds(F.max("event_time"))).alias("newest_lag_seconds"),
        F.max(lag).alias("worst_lag_seconds"),
        F.round(F.avg(lag), 3).alias("avg_lag_seconds"),
        F.count_if(lag > STREAM_LAG_SECONDS).alias("over_stream_target"),
        F.count_if(lag > SILVER_LAG_SECONDS).alias("over_silver_target"),
    )


def dead_letter_backlog(letters: DataFrame, at: str = "failed_at", minutes: int = 5) -> DataFrame:
    """Dead letters per tumbling window; any at all raises the alert."""
    return (
        letters.groupBy(F.window(at, f"{minutes} minutes").alias("_w"))
        .agg(F.count(F.lit(1)).alias("letters"))
        .select(F.col("_w.start").alias("window_start"), "letters", (F.col("letters") > 0).alias("alert"))
    )


def stream_backlog(letters: DataFrame, path: str, checkpoint: str, at: str = "failed_at", minutes: int = 5, late: str = "1 day") -> StreamingQuery:
    """:func:`dead_letter_backlog` kept up to date from a stream of dead letters.

    Counts per window are state of the query until the watermark, ``late`` behind the newest letter,
    has passed the window; a letter later than that is not counted. Each batch's changed windows are
    merged into the table at ``path``, a replayed batch to the same values.
    """
    spark = letters.sparkSession
    columns = "window_start timestamp, letters long, alert boolean"
    if not merge.is_table(spark, path):
        merge.create_table(spark.createDataFrame([], columns), path, ["window_start"], buckets=4)

    def update(batch: DataFrame, _: int) -> None:
        merge.merge(batch, path)

    counts = dead_letter_backlog(letters.withWatermark(at, late), at, minutes)
    writer = counts.writeStream.outputMode("update").foreachBatch(update).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


class ProgressLog(StreamingQueryListener):
    """Writes one small JSON file per finished batch, named by run and batch, under ``path``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        row = {
            "query_id": str(p.id), "run_id": str(p.runId), "batch_id": p.batchId, "started_at": p.timestamp,
            "input_rows": p.numInputRows, "duration_ms": int(p.batchDuration),
            "state_rows": sum(s.numRowsTotal for s in p.stateOperators),
        }
        system, file = file_system(self.spark, f"{self.path}/{row['run_id']}-{p.batchId}.json")
        out = system.create(file, True)
        out.write(bytearray((json.dumps(row) + "\n").encode()))
        out.close()


_PROGRESS = "query_id string, run_id string, batch_id long, started_at timestamp, input_rows long, duration_ms long, state_rows long"


def batch_lag(progress: DataFrame) -> DataFrame:
    """Each batch's rows, time and state, and whether it took longer than a message may."""
    return progress.select(
        "query_id", "run_id", "batch_id", "input_rows", "duration_ms", "state_rows",
        (F.col("duration_ms") > STREAM_LAG_SECONDS * 1000).alias("over_stream_target"),
    )


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """The batches that a :class:`ProgressLog` wrote."""
    return spark.read.schema(_PROGRESS).json(path)
