"""Trailing windows over daily sketches, so that raw rows are read once for every window and length.

One sketch per day is a few kilobytes whatever the day's rows, and is built inside each map task;
a day's sketch is then sent to the windows that hold the day and merged there. A window of ``days``
ends on every day that has rows, and on the days after it up to ``last``.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: log2 of the buckets of a distinct-count sketch: a relative standard error of 1.04 / sqrt(2^12), 1.6 %.
DISTINCT_BITS = 12
#: Size of a quantile sketch: ranks are within 0.7 % with a probability of 99 %.
QUANTILE_SIZE = 400


def _windows(daily: DataFrame, days: int, last: date) -> DataFrame:
    if days < 1:
        raise ValueError("a window has at least one day")
    upto = F.least(F.date_add("day", days - 1), F.lit(last))
    return daily.where(F.col("day") <= F.lit(last)).withColumn("window_end", F.explode(F.sequence("day", upto)))


def daily_distinct(rows: DataFrame, time: str, value: str) -> DataFrame:
    """(day, sketch): one sketch per day of the values seen; nulls count for nothing."""
    return (
        rows.where(F.col(time).isNotNull() & F.col(value).isNotNull())
        .groupBy(F.to_date(time).alias("day"))
        .agg(F.hll_sketch_agg(value, DISTINCT_BITS).alias("sketch"))
    )


def trailing_distinct(daily: DataFrame, days: int, last: date) -> DataFrame:
    """(window_end, distinct_values): about how many values each window of ``days`` days saw."""
    return (
        _windows(daily, days, last)
        .groupBy("window_end")
        .agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_values"))
    )


def daily_quantiles(rows: DataFrame, time: str, value: str) -> DataFrame:
    """(day, n, sketch): one quantile sketch per day of a whole-number column; nulls are left out."""
    return (
        rows.where(F.col(time).isNotNull() & F.col(value).isNotNull())
        .groupBy(F.to_date(time).alias("day"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.kll_sketch_agg_bigint(F.col(value).cast("long"), QUANTILE_SIZE).alias("sketch"),
        )
    )


def trailing_quantiles(daily: DataFrame, days: int, last: date, ranks: dict[str, float]) -> DataFrame:
    """(window_end, n, and a column per named rank): quantiles of each window of ``days`` days."""

    def at(rank: float) -> Column:
        return F.kll_sketch_get_quantile_bigint("_merged", F.lit(float(rank)))

    merged = _windows(daily, days, last).groupBy("window_end").agg(
        F.sum("n").alias("n"), F.kll_merge_agg_bigint("sketch", QUANTILE_SIZE).alias("_merged")
    )
    return merged.select("window_end", "n", *[at(rank).alias(name) for name, rank in ranks.items()])
