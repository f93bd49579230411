"""Customer-level rollups and the analyst's reports over transactions, accounts and customers.

Facts are summed per account before any join, so the bridge from transactions through
accounts to customers moves one row per account however busy the account is.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.hashing import fingerprint
from ledgerlake.functions.money import net_delta
from ledgerlake.operators import sketches
from ledgerlake.plans.gold import posted


def customer_360(
    customer: DataFrame,
    account: DataFrame,
    transaction: DataFrame,
    overdraft_history: DataFrame,
    loan_request: DataFrame,
) -> DataFrame:
    """One row per customer with account, transaction, overdraft and loan rollups."""
    activity = transaction.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("_txns"),
        F.sum(net_delta(F.col("txn_type"), F.col("amount"))).alias("_net"),
    )
    loans = loan_request.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("_loans"), F.sum("amount").alias("_loan_amount")
    )
    rollup = (
        account.select("account_id", "customer_id")
        .join(activity, "account_id", "left")
        .join(
            overdraft_history.select("account_id", "overdraft_events", "lowest_balance"),
            "account_id",
            "left",
        )
        .join(loans, "account_id", "left")
        .groupBy("customer_id")
        .agg(
            F.count(F.lit(1)).alias("account_count"),
            F.sum("_txns").alias("transaction_count"),
            F.sum("_net").alias("net_transaction_amount"),
            F.sum("overdraft_events").alias("overdraft_events"),
            F.min("lowest_balance").alias("lowest_balance"),
            F.sum("_loans").alias("loan_count"),
            F.sum("_loan_amount").alias("total_loan_amount"),
        )
    )

    def or_zero(name: str):
        return F.coalesce(name, F.lit(0)).alias(name)

    return customer.select("customer_id", "segment", F.col("created_at").alias("customer_since")).join(
        rollup, "customer_id", "left"
    ).select(
        "customer_id",
        "segment",
        "customer_since",
        or_zero("account_count"),
        or_zero("transaction_count"),
        or_zero("net_transaction_amount"),
        or_zero("overdraft_events"),
        "lowest_balance",
        or_zero("loan_count"),
        or_zero("total_loan_amount"),
    )


def with_customer(per_account: DataFrame, account: DataFrame, customer: DataFrame, *measures: str) -> DataFrame:
    """Per-account rows bridged to customers: the sum of each measure, per customer, with the segment.

    Summing per customer before the last join keeps its keys single on both sides, also
    when one customer owns a large share of the accounts.
    """
    per_customer = (
        per_account.join(account.select("account_id", "customer_id"), "account_id")
        .groupBy("customer_id")
        .agg(F.count(F.lit(1)).alias("_accounts"), *[F.sum(m).alias(m) for m in measures])
    )
    return per_customer.join(customer.select("customer_id", "segment"), "customer_id")


def net_amount_by_segment(transaction: DataFrame, account: DataFrame, customer: DataFrame) -> DataFrame:
    """Posted deposits less withdrawals and fees, per segment."""
    per_account = (
        posted(transaction)
        .groupBy("account_id")
        .agg(F.sum(net_delta(F.col("txn_type"), F.col("amount"))).alias("_net"))
    )
    return (
        with_customer(per_account, account, customer, "_net")
        .groupBy("segment")
        .agg(F.sum("_net").alias("net_transaction_amount"))
    )


def deposits_by_segment(transaction: DataFrame, account: DataFrame, customer: DataFrame) -> DataFrame:
    """Deposit total and number of transactions of any type, per segment."""
    per_account = transaction.groupBy("account_id").agg(
        F.sum(F.when(F.col("txn_type") == "DEPOSIT", F.col("amount")).otherwise(F.lit(0))).alias("_deposits"),
        F.count("transaction_id").alias("_txns"),
    )
    return (
        with_customer(per_account, account, customer, "_deposits", "_txns")
        .groupBy("segment")
        .agg(F.sum("_deposits").alias("total_deposits"), F.sum("_txns").alias("txns"))
        .orderBy(F.desc("total_deposits"), "segment")
    )


def daily_volume(transaction: DataFrame) -> DataFrame:
    return (
        transaction.groupBy(F.to_date("event_time").alias("day"), "txn_type")
        .agg(F.count(F.lit(1)).alias("txns"), F.sum("amount").alias("total"))
        .orderBy(F.desc("day"), "txn_type")
    )


def monthly_fee_revenue(transaction: DataFrame) -> DataFrame:
    return (
        transaction.where(F.col("txn_type") == "FEE")
        .groupBy(F.trunc("event_time", "month").alias("month"))
        .agg(F.sum("amount").alias("fee_revenue"))
        .orderBy("month")
    )


def most_active_accounts(transaction: DataFrame, n: int = 20) -> DataFrame:
    return (
        transaction.groupBy("account_id")
        .agg(F.count(F.lit(1)).alias("txns"), F.sum("amount").alias("total_amount"))
        .orderBy(F.desc("txns"), "account_id")
        .limit(n)
    )


def new_customers_per_month(customer: DataFrame) -> DataFrame:
    return (
        customer.groupBy(F.trunc("created_at", "month").alias("month"))
        .agg(F.count(F.lit(1)).alias("new_customers"))
        .orderBy("month")
    )


def customers_by_segment(customer: DataFrame) -> DataFrame:
    return (
        customer.groupBy("segment")
        .agg(F.count(F.lit(1)).alias("customers"))
        .orderBy(F.desc("customers"), "segment")
    )


def highest_risk_accounts(overdraft_history: DataFrame, n: int = 20) -> DataFrame:
    return (
        overdraft_history.select("account_id", "overdraft_events", "lowest_balance", "overdraft_ratio")
        .orderBy(F.desc("overdraft_events"), F.asc("lowest_balance"), "account_id")
        .limit(n)
    )


def overdraft_portfolio(overdraft_history: DataFrame) -> DataFrame:
    return overdraft_history.agg(
        F.count(F.lit(1)).alias("accounts"),
        F.sum("overdraft_events").alias("total_events"),
        F.round(F.avg("overdraft_ratio"), 3).alias("avg_ratio"),
        F.min("lowest_balance").alias("worst_balance"),
    )


def most_overdrafts(customer_360_view: DataFrame, n: int = 20) -> DataFrame:
    """Customers by overdraft events, most first."""
    return (
        customer_360_view.select("customer_id", "segment", "overdraft_events")
        .orderBy(F.desc("overdraft_events"), "customer_id")
        .limit(n)
    )


def active_customers(
    transaction: DataFrame, account: DataFrame, customer: DataFrame, as_of: datetime, days: int = 90
) -> DataFrame:
    """Number of customers with a posted transaction in the ``days`` before ``as_of``."""
    since = F.lit(as_of) - F.make_dt_interval(days=F.lit(days))
    recent = posted(transaction).where(F.col("event_time") >= since).select("account_id").distinct()
    return with_customer(recent, account, customer).agg(
        F.countDistinct("customer_id").alias("active_customers")
    )


def rolling_active_customers(
    transaction: DataFrame, account: DataFrame, customer: DataFrame, days: int, last: date
) -> DataFrame:
    """(window_end, active_customers): about how many customers had a posted transaction in the ``days`` days to each.

    The twin of :func:`active_customers` for a series of days, from one sketch per day.
    """
    # One row per account and day reaches the joins, however busy the account is.
    active = posted(transaction).select("account_id", F.to_date("event_time").alias("event_date")).distinct()
    bridged = active.join(account.select("account_id", "customer_id"), "account_id")
    owned = bridged.join(customer.select("customer_id"), "customer_id", "left_semi")
    daily = sketches.daily_distinct(owned, "event_date", "customer_id")
    return sketches.trailing_distinct(daily, days, last).withColumnRenamed("distinct_values", "active_customers")


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of each named table."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        for name, df in tables.items()
    ]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out


# ---- dimensions seeded from the ledger ----

# ---- fixed values: codes the seeded rows rotate through ----
SEED_SEGMENTS = ("RETAIL", "PREMIER", "STUDENT", "BUSINESS")
SEED_ACCOUNT_TYPES = ("CHECKING", "SAVINGS")
SEED_VERSION = "seed-1.0.0"


def ledger_accounts(transaction: DataFrame) -> DataFrame:
    """Every account seen in the ledger, with one currency."""
    return transaction.groupBy("account_id").agg(F.min("currency").alias("currency"))


def _choose(codes: tuple[str, ...], account_id) -> Column:
    return F.get(F.array(*[F.lit(c) for c in codes]), F.pmod(fingerprint(account_id), F.lit(len(codes))))


def seeded_customers(accounts: DataFrame, as_of: datetime) -> DataFrame:
    """One synthetic customer per ledger account."""
    account_id, now = F.col("account_id"), F.lit(as_of)
    return accounts.select(
        F.concat(F.lit("cust-"), account_id).alias("customer_id"),
        F.sha2(account_id, 256).alias("customer_natural_key"),
        F.concat(F.lit("Customer "), F.upper(account_id)).alias("full_name"),
        F.concat(F.lit("user_"), account_id, F.lit("@example.com")).alias("email"),
        _choose(SEED_SEGMENTS, account_id).alias("segment"),
        (now - F.make_dt_interval(days=F.lit(400))).alias("created_at"),
        now.alias("ingest_time"),
        F.lit(SEED_VERSION).alias("pipeline_version"),
    )


def seeded_accounts(accounts: DataFrame, as_of: datetime) -> DataFrame:
    """The account record of every ledger account."""
    account_id, now = F.col("account_id"), F.lit(as_of)
    number = fingerprint(account_id) + F.lit(10**18)  # always 19 digits
    return accounts.select(
        "account_id",
        number.cast("string").alias("account_number"),
        F.concat(F.lit("cust-"), account_id).alias("customer_id"),
        _choose(SEED_ACCOUNT_TYPES, account_id).alias("account_type"),
        "currency",
        F.lit("ACTIVE").alias("status"),
        (now - F.make_dt_interval(days=F.lit(365))).alias("opened_at"),
        now.alias("ingest_time"),
        F.lit(SEED_VERSION).alias("pipeline_version"),
    )
