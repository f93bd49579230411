"""Loan requests, assessments, decisions and the view of their current state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake import schemas
from ledgerlake.operators.ranking import latest_per_key, next_versions
from ledgerlake.operators.scorecard import AUTO_APPROVE_MAX, dti_ratio, score_loans
from ledgerlake.plans.semantic import with_customer

# ---- fixed values: loan status that follows each decision ----
STATUS_AFTER = {
    "APPROVE": "APPROVED",
    "REJECT": "REJECTED",
    "REQUEST_MODIFICATION": "MODIFIED",
    "COUNTEROFFER": "MODIFIED",
}


def latest_version(history: DataFrame, *columns: str) -> DataFrame:
    """The row of the highest version of every loan."""
    newest = latest_per_key(history, ["loan_id"], [F.desc("version")])
    return newest.select("loan_id", *columns)


def loan_status(loan_request: DataFrame, risk_assessment: DataFrame, approval_decision: DataFrame) -> DataFrame:
    """Every request with its latest assessment and latest decision."""
    risk = latest_version(risk_assessment, "risk_score", "recommendation", "reasons", "factors")
    decision = latest_version(
        approval_decision,
        F.col("decision").alias("final_decision"),
        "counteroffer_amount",
        "approver",
        "decided_at",
    )
    return (
        loan_request.select(
            "loan_id", "customer_name", "amount", "term_months", "status", "submitted_at", "updated_at"
        )
        .join(risk, "loan_id", "left")
        .join(decision, "loan_id", "left")
    )


# ---- submission ----

# ---- fixed values: limits of a submission, wording of automatic decisions ----
MIN_TERM_MONTHS = 6
MAX_TERM_MONTHS = 360
AUTO_APPROVER = "auto-policy"
AUTO_APPROVED_TEXT = "auto-approved low risk "
AUTO_DECLINED_TEXT = "auto-declined by policy"


def check_submissions(submissions: DataFrame) -> DataFrame:
    """Add ``errors``: the submission rules a row breaks, empty when it may proceed."""
    rules = (
        ("customer_name must not be empty", F.coalesce(F.col("customer_name"), F.lit("")) != ""),
        ("amount must be greater than 0", F.col("amount") > 0),
        ("term_months must be 6 to 360", F.col("term_months").between(MIN_TERM_MONTHS, MAX_TERM_MONTHS)),
    )
    return submissions.withColumn("errors", _broken(rules))


def check_decisions(decisions: DataFrame) -> DataFrame:
    """Add ``errors``: unknown decisions, and counteroffers without an amount."""
    offered = F.coalesce(F.col("counteroffer_amount"), F.lit(0)) != 0
    rules = (
        ("unknown decision", F.col("decision").isin(*schemas.LOAN_DECISIONS)),
        ("counteroffer_amount required for COUNTEROFFER", (F.col("decision") != "COUNTEROFFER") | offered),
    )
    return decisions.withColumn("errors", _broken(rules))


def _broken(rules: Sequence[tuple[str, Column]]) -> Column:
    marks = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(text)) for text, ok in rules])
    return F.filter(marks, lambda m: m.isNotNull())


# ---- assessment ----


def overdraft_input(loan_request: DataFrame, overdraft_history: DataFrame) -> DataFrame:
    """Loans with the overdraft events of their account; 0 without a history."""
    events = overdraft_history.select("account_id", "overdraft_events")
    return loan_request.join(events, "account_id", "left").withColumn(
        "overdraft_events", F.coalesce("overdraft_events", F.lit(0))
    )


def overdraft_proxy(loan_request: DataFrame, account_summary: DataFrame) -> DataFrame:
    """Loans with the coarse signal: withdrawals of an account whose net balance is negative."""
    signal = account_summary.select(
        "account_id",
        F.when(F.col("net_balance") < 0, F.col("withdrawal_count")).otherwise(F.lit(0)).alias("overdraft_events"),
    )
    return loan_request.join(signal, "account_id", "left").withColumn(
        "overdraft_events", F.coalesce("overdraft_events", F.lit(0))
    )


def assess(loans_with_overdraft: DataFrame, credit_profile: DataFrame) -> DataFrame:
    """Score every loan from its credit profile and overdraft events."""
    profile = credit_profile.select("loan_id", "credit_score", "annual_income", "existing_debt")
    loans = loans_with_overdraft.join(profile, "loan_id").withColumn(
        "dti_ratio",
        dti_ratio(F.col("annual_income"), F.col("existing_debt"), F.col("amount"), F.col("term_months")),
    )
    return score_loans(loans)


def route(scored: DataFrame) -> DataFrame:
    """Add the automatic decision: ``decision``, ``approver``, ``rationale``; null means a human decides."""
    approve = (F.col("recommendation") == "APPROVE") & (F.col("risk_score") <= AUTO_APPROVE_MAX)
    decline = F.col("recommendation") == "DECLINE"
    return scored.withColumns(
        {
            "decision": F.when(approve, "APPROVE").when(decline, "REJECT"),
            "approver": F.when(approve | decline, AUTO_APPROVER),
            "rationale": F.when(
                approve, F.concat(F.lit(AUTO_APPROVED_TEXT), F.col("risk_score").cast("string"))
            ).when(decline, AUTO_DECLINED_TEXT),
        }
    )


# ---- decisions and audit ----


def status_after(decision: Column) -> Column:
    chosen = F.lit("PENDING_APPROVAL")
    for name, status in STATUS_AFTER.items():
        chosen = F.when(decision == name, status).otherwise(chosen)
    return chosen


def version_decisions(new_decisions: DataFrame, approval_decision: DataFrame) -> DataFrame:
    """New decisions with the version each takes in its loan's history, and the status after it."""
    return next_versions(
        new_decisions, approval_decision, "loan_id", "decided_at", "decision_id"
    ).withColumn("status_after", status_after(F.col("decision")))


def decision_audit(decisions: DataFrame) -> DataFrame:
    """Audit rows of decisions, to be appended to the log."""
    return decisions.select(
        F.concat(F.lit("aud-"), F.col("decision_id")).alias("audit_id"),
        "loan_id",
        F.col("approver").alias("actor"),
        F.concat(F.lit("DECISION_"), F.col("decision")).alias("action"),
        F.col("rationale").alias("detail"),
        F.col("decided_at").alias("event_time"),
    )


def audit_trail(loan_audit_log: DataFrame, loan_id: str) -> DataFrame:
    """One loan's audit rows in time order."""
    return loan_audit_log.where(F.col("loan_id") == loan_id).orderBy("event_time", "audit_id")


def list_loans(loan_status_view: DataFrame, status: str | None = None, limit: int | None = None) -> DataFrame:
    """Loans, newest first, of one status if given; ``limit`` keeps the newest."""
    chosen = loan_status_view if status is None else loan_status_view.where(F.col("status") == status)
    ordered = chosen.orderBy(F.desc("submitted_at"), "loan_id")
    return ordered if limit is None else ordered.limit(limit)


def get_loan(loan_status_view: DataFrame, loan_id: str) -> DataFrame:
    return loan_status_view.where(F.col("loan_id") == loan_id)


# ---- reports ----


def outcome_breakdown(loan_status_view: DataFrame) -> DataFrame:
    return (
        loan_status_view.groupBy(F.coalesce("final_decision", "status").alias("outcome"))
        .agg(F.count(F.lit(1)).alias("loans"), F.sum("amount").alias("amount"))
        .orderBy(F.desc("loans"), "outcome")
    )


def average_risk(loan_status_view: DataFrame) -> DataFrame:
    return (
        loan_status_view.groupBy("status")
        .agg(F.count(F.lit(1)).alias("loans"), F.round(F.avg("risk_score"), 1).alias("avg_risk"))
        .orderBy(F.desc("loans"), "status")
    )


def approved_exposure(loan_status_view: DataFrame) -> DataFrame:
    return loan_status_view.where(F.col("final_decision") == "APPROVE").agg(
        F.sum("amount").alias("approved_exposure"), F.count(F.lit(1)).alias("approved_loans")
    )


def pending_by_segment(loan_request: DataFrame, account: DataFrame, customer: DataFrame) -> DataFrame:
    """Loans pending approval per customer segment, counted per account before the joins."""
    pending = (
        loan_request.where(F.col("status") == "PENDING_APPROVAL")
        .groupBy("account_id")
        .agg(F.count(F.lit(1)).alias("_loans"))
    )
    return (
        with_customer(pending, account, customer, "_loans")
        .groupBy("segment")
        .agg(F.sum("_loans").alias("pending_loans"))
    )
