"""Personal-data scans and de-identification over tables of text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions import pii
from ledgerlake.functions.hashing import sampled


def scan(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Occurrences of each kind of personal data per key: key, info_type, findings, distinct_values."""
    return (
        texts.select(key, F.explode(pii.found(F.col(text))).alias("f"))
        .select(key, "f.info_type", "f.value")
        .groupBy(key, "info_type")
        .agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("value").alias("distinct_values"))
    )


def deidentify_column(
    rows: DataFrame, column: str, key: str, secret: str, rate: float = 1.0
) -> DataFrame:
    """De-identify ``column`` in the ``rate`` share of rows picked by their key; keep all rows."""
    return rows.withColumn(
        column,
        F.when(sampled(F.col(key), rate), pii.deidentify(F.col(column), secret)).otherwise(F.col(column)),
    )
