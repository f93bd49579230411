import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlake.functions.money import balance_delta
from ledgerlake.operators.ranking import latest_per_key, next_versions, top_n_per_key
from ledgerlake.operators.running import row_numbers, running_total, sliced
from ledgerlake.plans import gold, semantic
from ledgerlake.session import scratch_dir
from ledgerlake.sources import files

SCHEMA = (
    "transaction_id string, account_id string, txn_type string, amount decimal(18,2), currency string, "
    "status string, event_time timestamp, counterparty_account string"
)
T0 = datetime(2024, 1, 1)


def txns(spark, rows):
    full = [
        (f"t{i:04d}", a, kind, Decimal(str(amount)), "USD", status, T0 + timedelta(seconds=at), None)
        for i, (a, kind, amount, status, at) in enumerate(rows)
    ]
    return spark.createDataFrame(full, SCHEMA)


def accounts(spark, ids):
    return spark.createDataFrame(
        [(i, "c-" + i, "CHECKING", "USD", "ACTIVE") for i in ids],
        "account_id string, customer_id string, account_type string, currency string, status string",
    )


def test_ties_share_a_running_balance(spark):
    rows = [("a", "DEPOSIT", 5, "POSTED", 1), ("a", "FEE", 9, "POSTED", 1), ("a", "DEPOSIT", 1, "POSTED", 2)]
    out = sorted((r.event_time, float(r.running), r.n) for r in gold.running_balance(txns(spark, rows)).collect())
    assert out == [(T0 + timedelta(seconds=1), -4.0, 2), (T0 + timedelta(seconds=2), -3.0, 1)]
    od = gold.overdraft_history(txns(spark, rows)).first()
    assert (od.overdraft_events, float(od.lowest_balance), od.overdraft_ratio) == (3, -4.0, 1.0)


@pytest.mark.parametrize("slice_rows", [1, 150, 10**6])
def test_running_total_equals_a_window_with_a_hot_key(spark, slice_rows):
    rng = random.Random(5)
    rows = [
        (
            "hot" if rng.random() < 0.4 else f"a{rng.randrange(20)}",
            rng.choice(["DEPOSIT", "WITHDRAWAL", "FEE", "TRANSFER"]),
            rng.randrange(1, 100),
            "POSTED",
            rng.randrange(0, 200),
        )
        for _ in range(1500)
    ]
    df = txns(spark, rows)
    delta = balance_delta(F.col("txn_type"), F.col("amount"))
    window = Window.partitionBy("account_id").orderBy("event_time")
    expected = {
        tuple(r)
        for r in df.select("account_id", "event_time", F.sum(delta).over(window).alias("running")).distinct().collect()
    }
    got = running_total(df, "account_id", "event_time", delta, slice_rows)
    assert {(r.account_id, r.event_time, r.running) for r in got.collect()} == expected
    assert got.agg(F.sum("n")).first()[0] == 1500


def test_row_numbers_equal_a_window(spark):
    rng = random.Random(7)
    rows = [("k" if rng.random() < 0.5 else f"k{rng.randrange(5)}", T0 + timedelta(seconds=rng.randrange(300)), f"id{i:04d}") for i in range(500)]
    df = spark.createDataFrame(rows, "key string, at timestamp, id string")
    expected = df.withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy("at", "id")))
    got = row_numbers(df, "key", "at", "id", slice_rows=20)
    assert sorted(map(tuple, got.select("key", "at", "id", "rn").collect())) == sorted(map(tuple, expected.collect()))


def burst(spark, rows=60_000):
    """Half of all rows on one account within one hour, a third of those at one time; nulls too."""
    at = f"timestamp_micros(cast(1704067200000000 + if(id % 3 = 0, 1800, id * 3600 / {rows}) * 1000000 as bigint))"
    return spark.range(rows).selectExpr(
        "if(id % 2 = 0, 'hot', if(id % 101 = 0, null, concat('a', id % 500))) as account_id",
        f"if(id % 997 = 0, null, {at}) as event_time", "cast(id % 19 - 9 as decimal(18,2)) as amount", "concat('t', id) as id",
    )


def test_running_total_of_a_burst(spark):
    """Slices of one busy hour are even, and the totals reuse the exchange of the detail."""
    df = burst(spark)
    window = Window.partitionBy("account_id").orderBy("event_time")
    expected = df.select("account_id", "event_time", F.sum("amount").over(window).alias("running")).distinct()
    got = running_total(df, "account_id", "event_time", F.col("amount"), slice_rows=2000)
    assert sorted(map(str, got.select("account_id", "event_time", "running").collect())) == sorted(map(str, expected.collect()))
    got.collect()
    assert "ReusedExchange" in got._jdf.queryExecution().executedPlan().toString()
    ticks = df.select("account_id", "event_time").distinct()
    sizes = [r["count"] for r in sliced(ticks, "account_id", ["event_time"], 2000).where("account_id = 'hot'").groupBy("_slice").count().collect()]
    assert len(sizes) > 5 and max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]


def test_row_numbers_of_a_burst(spark):
    """Rows at one time are spread over slices by the tiebreak."""
    df = burst(spark)
    expected = df.withColumn("rn", F.row_number().over(Window.partitionBy("account_id").orderBy("event_time", "id")))
    got = row_numbers(df, "account_id", "event_time", "id", slice_rows=2000)
    assert sorted(map(str, got.select("id", "rn").collect())) == sorted(map(str, expected.select("id", "rn").collect()))
    sizes = [r["count"] for r in sliced(df, "account_id", ["event_time", "id"], 2000).where("account_id = 'hot'").groupBy("_slice").count().collect()]
    assert len(sizes) > 10 and max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]


def test_small_keys_stay_whole(spark, bank):
    """Without a busy account there is one window over the account and no join."""
    assert sliced(burst(spark, 600), "account_id", ["event_time"]) is None
    plan = gold.overdraft_history(bank.transaction)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_top_n_is_limited_before_the_shuffle(spark, bank):
    plan = gold.newest_per_account(bank.transaction, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_balances(spark):
    rows = [
        ("a", "DEPOSIT", 100, "POSTED", 1),
        ("a", "TRANSFER", 30, "POSTED", 2),
        ("a", "FEE", 1, "PENDING", 3),
        ("b", "DEPOSIT", 7, "REJECTED", 4),
    ]
    t, a = txns(spark, rows), accounts(spark, ["a", "b", "c"])
    balance = {r.account_id: (float(r.balance), r.last_activity_at) for r in gold.account_balance(a, t).collect()}
    assert balance == {"a": (70.0, T0 + timedelta(seconds=2)), "b": (0.0, None), "c": (0.0, None)}
    summary = {r.account_id: r for r in gold.account_summary(a, t).collect()}
    assert (summary["a"].deposit_count, summary["a"].fee_count, float(summary["a"].net_balance)) == (1, 1, 99.0)
    assert (summary["b"].deposit_count, float(summary["b"].net_balance)) == (1, 7.0)
    assert (summary["c"].deposit_count, float(summary["c"].net_balance)) == (0, 0.0)


def test_account_reads(spark):
    rows = [("a", "DEPOSIT", i, "POSTED", i * 3600) for i in range(1, 60)] + [("b", "FEE", 1, "POSTED", 5)]
    t, a = txns(spark, rows), accounts(spark, ["a", "b"])
    newest = gold.newest_transactions(t, "a", 3).collect()
    assert [float(r.amount) for r in newest] == [59.0, 58.0, 57.0]
    recent = gold.recent_activity(t, "a", T0 + timedelta(hours=59), days=1).collect()
    assert [float(r.amount) for r in recent] == [float(i) for i in range(59, 34, -1)]
    view = gold.account_balance(a, t)
    assert float(gold.balance_of(view, "b").first().balance) == -1.0
    assert gold.summary_of(gold.account_summary(a, t), "b").first().fee_count == 1
    for bad in (0, -1):
        with pytest.raises(ValueError):
            gold.newest_transactions(t, "a", bad)
    for bad in (0, -1):
        with pytest.raises(ValueError):
            gold.recent_activity(t, "a", T0, bad)


def test_point_read_filters_both_inputs(spark, bank):
    view = gold.account_balance(bank.account, bank.transaction)
    plan = gold.balance_of(view, "acct-3")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("acct-3") >= 2


def test_serving_keys_sort_newest_first(spark):
    rows = [("a", "DEPOSIT", i, "POSTED", i) for i in range(5)] + [("ab", "FEE", 1, "POSTED", 9)]
    path = scratch_dir(spark, "serving")
    files.write_key_sorted(gold.txn_by_account(txns(spark, rows)), path)
    got = files.prefix_scan(spark.read.parquet(path), "a", 3).collect()
    assert [float(r.amount) for r in got] == [4.0, 3.0, 2.0]
    assert all(len(r.row_key.split("#")[1]) == 10 for r in got)


def test_latest_and_versions(spark):
    history = spark.createDataFrame([("l1", 1), ("l1", 2), ("l2", 1)], "loan_id string, version int")
    latest = latest_per_key(history, ["loan_id"], [F.desc("version")])
    assert sorted(map(tuple, latest.collect())) == [("l1", 2), ("l2", 1)]
    new = spark.createDataFrame(
        [("l1", "d1", T0), ("l1", "d0", T0), ("l3", "d2", T0)], "loan_id string, id string, at timestamp"
    )
    got = next_versions(new, history, "loan_id", "at", "id")
    assert sorted((r.loan_id, r.id, r.version) for r in got.collect()) == [("l1", "d0", 3), ("l1", "d1", 4), ("l3", "d2", 1)]
    with pytest.raises(ValueError):
        top_n_per_key(history, ["loan_id"], [F.desc("version")], 0)


def test_clustered_days_prune(spark):
    rows = [("a", "DEPOSIT", i, "POSTED", i * 86400) for i in range(5)]
    path = scratch_dir(spark, "days")
    files.write_clustered(txns(spark, rows), path, "event_time", ["account_id", "txn_type"])
    df = files.between_days(spark.read.parquet(path), "event_time", T0 + timedelta(days=1), T0 + timedelta(days=3))
    assert sorted(float(r.amount) for r in df.collect()) == [1.0, 2.0]
    assert "PartitionFilters: [isnotnull(event_date" in df._jdf.queryExecution().executedPlan().toString()


def test_customers_with_one_hot_owner(spark):
    """Segments stay right when one customer owns most accounts."""
    rows = [(f"a{i}", "DEPOSIT", 1, "POSTED", i) for i in range(30)]
    account = spark.createDataFrame(
        [(f"a{i}", "big" if i < 25 else f"c{i}") for i in range(30)], "account_id string, customer_id string"
    )
    customer = spark.createDataFrame(
        [("big", "S1")] + [(f"c{i}", "S2") for i in range(25, 30)], "customer_id string, segment string"
    )
    out = {r.segment: float(r.net_transaction_amount) for r in semantic.net_amount_by_segment(txns(spark, rows), account, customer).collect()}
    assert out == {"S1": 25.0, "S2": 5.0}
