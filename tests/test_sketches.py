from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import sketches
from ledgerlake.plans import evals, semantic

FIRST, LAST = date(2024, 1, 1), date(2024, 2, 9)


@pytest.fixture(scope="module")
def rows(spark):
    """40 days with a day without rows; a third of the rows fall on one day."""
    n = F.col("id")
    day = F.when(n % 3 == 0, F.lit(11)).otherwise(F.pmod(F.xxhash64(n), F.lit(40)))
    made = spark.range(120_000).select(
        (F.lit(datetime(2024, 1, 1)) + F.make_dt_interval(days=day.cast("int"), hours=(n % 24).cast("int"))).alias("ts"),
        F.concat(F.lit("c"), F.pmod(F.xxhash64(n, F.lit(1)), F.lit(30_000))).alias("who"),
        F.pmod(F.xxhash64(n, F.lit(2)), F.lit(5000)).alias("latency_ms"),
    )
    made = made.where(F.to_date("ts") != F.lit(date(2024, 1, 21)))
    return made.unionByName(spark.createDataFrame([(None, "c1", 1), (datetime(2024, 1, 3), None, None)], made.schema)).cache()


def window(rows, days, end):
    return rows.where(F.to_date("ts").between(F.lit(end - timedelta(days - 1)), F.lit(end)))


@pytest.mark.parametrize("days", [1, 7, 30, 90])
def test_distinct_values_of_every_window(spark, rows, days):
    got = {r.window_end: r.distinct_values for r in sketches.trailing_distinct(sketches.daily_distinct(rows, "ts", "who"), days, LAST).collect()}
    seen = rows.select(F.to_date("ts").alias("day"), "who").distinct().where("day IS NOT NULL AND who IS NOT NULL").collect()
    ends = {FIRST + timedelta(i) for i in range(40)} - ({date(2024, 1, 21)} if days == 1 else set())
    assert set(got) == ends
    for end in ends:
        exact = len({r.who for r in seen if end - timedelta(days) < r.day <= end})
        assert abs(got[end] - exact) <= 0.05 * exact  # three standard errors


@pytest.mark.parametrize("days", [1, 7, 40])
def test_quantiles_of_every_window(rows, days):
    got = evals.rolling_latency(rows, LAST, days).collect()
    values = {}
    for r in rows.where("ts IS NOT NULL AND latency_ms IS NOT NULL").select(F.to_date("ts").alias("day"), "latency_ms").collect():
        values.setdefault(r.day, []).append(r.latency_ms)
    assert len(got) == (39 if days == 1 else 40)
    for r in got:
        held = [v for d, vs in values.items() if r.window_end - timedelta(days) < d <= r.window_end for v in vs]
        assert r.n == len(held)
        for at, rank in ((r.latency_p50_ms, 0.5), (r.latency_p95_ms, 0.95)):
            below, upto = sum(v < at for v in held) / len(held), sum(v <= at for v in held) / len(held)
            assert below - 0.02 <= rank <= upto + 0.02


def test_last_window_is_the_exact_report(bank):
    # Few customers are counted exactly.
    last = datetime(2024, 1, 31)
    rolling = semantic.rolling_active_customers(bank.transaction, bank.account, bank.bank_customer, 90, last.date())
    exact = semantic.active_customers(bank.transaction, bank.account, bank.bank_customer, last, 90).first()[0]
    newest = rolling.orderBy(F.desc("window_end")).first()
    assert abs(newest.active_customers - exact) <= max(1, 0.05 * exact)


def test_no_rows_and_no_days(rows):
    assert sketches.trailing_distinct(sketches.daily_distinct(rows.where("false"), "ts", "who"), 7, LAST).count() == 0
    assert evals.rolling_latency(rows.where("false"), LAST).count() == 0
    with pytest.raises(ValueError):
        evals.rolling_latency(rows, LAST, 0)
