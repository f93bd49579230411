"""Readers and writers of the platform's tables: JSON lines, NDJSON corpora, Parquet."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# ---- fixed values: days each table keeps ----
RETENTION_DAYS = {"bronze": 400, "serving": 30, "dead_letter": 7}


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines as raw messages: ``data`` holds the untouched line."""
    return spark.read.text(path).select(F.col("value").alias("data"))


def stream_messages(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The same messages as a stream over a folder of JSON-lines files, ready for the ingest.

    A line is published when its file was written; equal lines of a file are one message. Options
    such as ``maxFilesPerTrigger`` bound what one batch takes.
    """
    lines = spark.readStream.options(**options).text(path).select("value", "_metadata")
    return lines.select(
        F.sha2(F.concat_ws("\n", "_metadata.file_path", "value"), 256).alias("message_id"),
        F.col("_metadata.file_modification_time").alias("publish_time"),
        F.col("value").alias("data"),
    )


def stream_topic(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """Messages of a Kafka topic with their metadata; needs Spark's Kafka package."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .options(**options)
        .load()
    )
    return raw.select(
        F.col("topic").alias("subscription_name"),
        F.concat_ws("-", "topic", "partition", "offset").alias("message_id"),
        F.col("timestamp").alias("publish_time"),
        F.col("value").cast("string").alias("data"),
        F.lit(None).cast("string").alias("attributes"),
    )


def load_corpus(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """NDJSON corpus read with a declared schema; a malformed line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Write ``df`` as the whole content of a table."""
    df.write.mode("overwrite").parquet(path)


def append_rows(df: DataFrame, path: str, schema: StructType | None = None, partition_by: str | None = None) -> None:
    """Append to an insert-only table, in the declared column order and types if given."""
    if schema is not None:
        missing = [f.name for f in schema.fields if f.name not in df.columns]
        required = [f.name for f in schema.fields if f.name in missing and not f.nullable]
        if required:
            raise ValueError(f"required columns missing: {required}")
        df = df.select(
            *[
                (F.lit(None) if f.name in missing else F.col(f.name)).cast(f.dataType).alias(f.name)
                for f in schema.fields
            ],
            *([partition_by] if partition_by and partition_by not in schema.names else []),
        )
    writer = df.write.mode("append")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """An evolving table read with today's schema: columns older files lack read as null."""
    return spark.read.schema(schema).parquet(path)


def write_clustered(df: DataFrame, path: str, day_of: str, cluster_by: list[str], mode: str = "append") -> None:
    """Write day partitions with rows of like keys together, so file statistics can skip.

    Rows go by a hash of the first clustering key and the day; a day of one busy key may
    still be large, so files are cut at a fixed number of rows.
    """
    dated = df.withColumn("event_date", F.to_date(day_of))
    (
        dated.repartition("event_date", F.pmod(F.hash(*cluster_by, F.expr(f"unix_seconds({day_of}) div 3600")), F.lit(64)))
        .sortWithinPartitions("event_date", *cluster_by)
        .write.mode(mode)
        .option("maxRecordsPerFile", 5_000_000)
        .partitionBy("event_date")
        .parquet(path)
    )


def between_days(df: DataFrame, time_column: str, start: datetime, end: datetime) -> DataFrame:
    """Rows with ``start <= time < end`` of a table partitioned by ``event_date``; prunes partitions."""
    t = F.col(time_column)
    return df.where(
        (F.col("event_date") >= F.to_date(F.lit(start)))
        & (F.col("event_date") <= F.to_date(F.lit(end)))
        & (t >= F.lit(start))
        & (t < F.lit(end))
    )


def write_key_sorted(df: DataFrame, path: str, key: str = "row_key", partitions: int | None = None) -> None:
    """Serving projection: range-partitioned and sorted by key, so a prefix read touches few files."""
    ranged = df.repartitionByRange(partitions, key) if partitions else df.repartitionByRange(key)
    ranged.sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def prefix_scan(serving: DataFrame, account_id: str, limit: int = 50) -> DataFrame:
    """Newest rows of one account from the key-sorted projection; file statistics skip the rest."""
    prefix = f"{account_id}#"
    return (
        serving.where((F.col("row_key") >= prefix) & (F.col("row_key") < f"{account_id}$"))
        .orderBy("row_key")
        .limit(limit)
    )


def retained(df: DataFrame, date_column: str, today: date, table: str) -> DataFrame:
    """Rows a table still keeps; on its partition column this prunes whole days."""
    return df.where(F.col(date_column) >= F.date_sub(F.lit(today), RETENTION_DAYS[table]))
