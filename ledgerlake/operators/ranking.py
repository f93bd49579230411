"""Latest-row and top-N selection.

All of them filter a ``row_number`` so that Spark limits each group inside every map
task before the shuffle; a group holding most of the rows then sends only N rows per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.operators.running import row_numbers


def top_n_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of every group in ``order``, with their position as ``rn``."""
    if n < 1:
        raise ValueError("n must be at least 1")
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(window)).where(F.col("rn") <= n)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of every group in ``order``."""
    return top_n_per_key(df, keys, order, 1).drop("rn")


def next_versions(
    new_rows: DataFrame, history: DataFrame, key: str, order: str, tiebreak: str
) -> DataFrame:
    """``new_rows`` numbered as the next versions of their key in an append-only table.

    A key's next version is one more than the rows ``history`` holds for it.
    """
    used = history.groupBy(key).agg(F.count(F.lit(1)).alias("_used"))
    return (
        row_numbers(new_rows, key, order, tiebreak, out="_nth")
        .join(used, key, "left")
        .withColumn("version", F.coalesce(F.col("_used"), F.lit(0)) + F.col("_nth"))
        .drop("_used", "_nth")
    )
