"""Gold views over silver tables, and the reads served from them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.money import balance_delta, net_delta
from ledgerlake.operators.ranking import top_n_per_key
from ledgerlake.operators.running import SLICE_ROWS, running_total

#: A stored event time at or after this many seconds cannot be keyed newest-first.
REVERSE_EPOCH = 9_999_999_999


def posted(transaction: DataFrame) -> DataFrame:
    return transaction.where(F.col("status") == "POSTED")


def account_balance(account: DataFrame, transaction: DataFrame) -> DataFrame:
    """Balance of every account from its posted transactions; 0 without any.

    Transactions are summed per account before the join, so a busy account crosses the
    network as one partial row per map task.
    """
    totals = (
        posted(transaction)
        .groupBy("account_id")
        .agg(
            F.sum(balance_delta(F.col("txn_type"), F.col("amount"))).alias("_balance"),
            F.max("event_time").alias("_last"),
        )
    )
    return (
        account.select("account_id", "customer_id", "currency")
        .join(totals, "account_id", "left")
        .groupBy("account_id", "customer_id", "currency")
        .agg(
            F.sum(F.coalesce("_balance", F.lit(0))).alias("balance"),
            F.max("_last").alias("last_activity_at"),
        )
    )


def account_summary(account: DataFrame, transaction: DataFrame) -> DataFrame:
    """Counts by type and net amount of every account, over transactions of any status."""
    kind = F.col("txn_type")
    totals = transaction.groupBy("account_id").agg(
        F.count_if(kind == "DEPOSIT").alias("_deposits"),
        F.count_if(kind == "WITHDRAWAL").alias("_withdrawals"),
        F.count_if(kind == "FEE").alias("_fees"),
        F.sum(net_delta(kind, F.col("amount"))).alias("_net"),
        F.max("event_time").alias("_last"),
    )

    def total(name: str) -> Column:
        return F.sum(F.coalesce(name, F.lit(0)))

    return (
        account.select("account_id", "customer_id", "account_type", "currency", "status")
        .join(totals, "account_id", "left")
        .groupBy("account_id", "customer_id", "account_type", "currency", "status")
        .agg(
            total("_deposits").alias("deposit_count"),
            total("_withdrawals").alias("withdrawal_count"),
            total("_fees").alias("fee_count"),
            total("_net").alias("net_balance"),
            F.max("_last").alias("last_activity_at"),
        )
    )


def running_balance(transaction: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Posted running balance per account and time; rows at one time share a value."""
    return running_total(
        posted(transaction),
        key="account_id",
        order="event_time",
        delta=balance_delta(F.col("txn_type"), F.col("amount")),
        slice_rows=slice_rows,
    )


def overdraft_history(transaction: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Overdraft profile per account: posted rows that left the running balance negative."""
    negative = F.sum(F.when(F.col("running") < 0, F.col("n")).otherwise(F.lit(0)))
    return (
        running_balance(transaction, slice_rows)
        .groupBy("account_id")
        .agg(
            negative.alias("overdraft_events"),
            F.min("running").alias("lowest_balance"),
            F.try_divide(negative.cast("double"), F.sum("n").cast("double")).alias("overdraft_ratio"),
        )
    )


# ---- reads of one account ----


def balance_of(account_balance_view: DataFrame, account_id: str) -> DataFrame:
    """One account's balance; push this filter below the view by passing filtered inputs."""
    return account_balance_view.where(F.col("account_id") == account_id).select(
        "account_id", "currency", "balance", "last_activity_at"
    )


def balances_of(account_balance_view: DataFrame, account_ids: DataFrame) -> DataFrame:
    """Balances of the accounts listed in ``account_ids``."""
    wanted = account_ids.select("account_id")
    return account_balance_view.join(wanted, "account_id", "left_semi").select(
        "account_id", "currency", "balance", "last_activity_at"
    )


def summary_of(account_summary_view: DataFrame, account_id: str) -> DataFrame:
    return account_summary_view.where(F.col("account_id") == account_id)


def summaries_of(account_summary_view: DataFrame, account_ids: DataFrame) -> DataFrame:
    """Summaries of the accounts listed in ``account_ids``."""
    return account_summary_view.join(account_ids.select("account_id"), "account_id", "left_semi")


_READ_COLUMNS = ("transaction_id", "txn_type", "amount", "currency", "status", "event_time")


def newest_transactions(transaction: DataFrame, account_id: str, limit: int = 50) -> DataFrame:
    """The newest ``limit`` transactions of one account."""
    if limit < 1:
        raise ValueError("limit must be positive")
    return (
        transaction.where(F.col("account_id") == account_id)
        .select(*_READ_COLUMNS)
        .orderBy(F.desc("event_time"), "transaction_id")
        .limit(limit)
    )


def activity_since(transaction: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """Every account's transactions of the last ``days`` days."""
    if days < 1:
        raise ValueError("days must be positive")
    since = F.lit(as_of) - F.make_dt_interval(days=F.lit(days))
    return transaction.where(F.col("event_time") >= since).select("account_id", *_READ_COLUMNS)


def recent_activity(transaction: DataFrame, account_id: str, as_of: datetime, days: int = 30) -> DataFrame:
    """One account's transactions of the last ``days`` days, newest first."""
    return (
        activity_since(transaction.where(F.col("account_id") == account_id), as_of, days)
        .select(*_READ_COLUMNS)
        .orderBy(F.desc("event_time"), "transaction_id")
    )


def newest_per_account(transaction: DataFrame, n: int = 5) -> DataFrame:
    """The newest ``n`` transactions of every account."""
    return top_n_per_key(
        transaction.select("account_id", *_READ_COLUMNS),
        ["account_id"],
        [F.desc("event_time"), F.asc("transaction_id")],
        n,
    )


def most_recently_active(account_balance_view: DataFrame, n: int = 5) -> DataFrame:
    """Accounts by last activity, newest first."""
    return (
        account_balance_view.select("account_id", "last_activity_at")
        .orderBy(F.desc_nulls_last("last_activity_at"), "account_id")
        .limit(n)
    )


# ---- serving projections ----


def row_key(account_id: Column, event_time: Column, transaction_id: Column) -> Column:
    """``account#reversed-seconds#id``: newest sorts first inside an account, and no two rows share a key."""
    reverse = F.lpad((F.lit(REVERSE_EPOCH) - F.unix_seconds(event_time)).cast("string"), 10, "0")
    return F.concat_ws("#", account_id, reverse, transaction_id)


def txn_by_account(transaction: DataFrame) -> DataFrame:
    """Key-value projection of transactions; a transaction delivered twice keeps its newest value."""
    keyed = transaction.select(
        row_key(F.col("account_id"), F.col("event_time"), F.col("transaction_id")).alias("row_key"),
        "account_id",
        *_READ_COLUMNS,
    )
    return top_n_per_key(
        keyed, ["row_key"], [F.desc("event_time"), F.asc("transaction_id")], 1
    ).drop("rn")


def balance_projection(account_balance_view: DataFrame, as_of: datetime) -> DataFrame:
    """One version per key of the balance served by point reads, as text cells."""
    latest = account_balance_view.groupBy("account_id").agg(
        F.max_by(
            F.struct("balance", "currency", "last_activity_at"),
            F.struct("last_activity_at", "customer_id"),
        ).alias("v")
    )
    return latest.select(
        F.col("account_id").alias("row_key"),
        F.col("v.balance").alias("balance"),
        F.coalesce("v.currency", F.lit("USD")).alias("currency"),
        F.coalesce("v.last_activity_at", F.lit(as_of)).alias("as_of"),
    )
