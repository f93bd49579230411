from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import scorecard
from ledgerlake.plans import evals, loans, steward

# ---- fixed values: labelled scorecard cases (id, credit, income, debt, dti, amount, overdrafts, label, score) ----
CASES = [
    ("strong-1", 790, 160000.0, 8000.0, 0.14, 12000.0, 0, "APPROVE", 0),
    ("strong-2", 760, 120000.0, 15000.0, 0.2, 10000.0, 0, "APPROVE", 0),
    ("weak-1", 575, 28000.0, 22000.0, 0.6, 55000.0, 6, "DECLINE", 100),
    ("weak-2", 600, 35000.0, 20000.0, 0.5, 45000.0, 4, "DECLINE", 95),
    ("mid-1", 665, 62000.0, 18000.0, 0.34, 24000.0, 1, "REVIEW", 52),
    ("mid-2", 690, 70000.0, 16000.0, 0.36, 22000.0, 2, "REVIEW", 52),
    ("overdraft-heavy", 720, 90000.0, 12000.0, 0.25, 15000.0, 7, "REVIEW", 30),
    ("large-strong", 800, 200000.0, 10000.0, 0.18, 60000.0, 0, "APPROVE", 10),
]


@pytest.fixture(scope="module")
def scored(spark):
    df = spark.createDataFrame(
        [c[:8] for c in CASES],
        "loan_id string, credit_score int, annual_income double, existing_debt double, dti_ratio double, "
        "amount double, overdraft_events int, expected string",
    )
    return scorecard.score_loans(df)


def test_scores(scored):
    assert {r.loan_id: r.risk_score for r in scored.collect()} == {c[0]: c[8] for c in CASES}


def test_accuracy_against_labels(scored):
    row = evals.label_accuracy(scored, "recommendation", "expected", "approval_recommendation_accuracy").first()
    assert (row.n, row.accuracy, row.passed) == (8, 0.875, True)


def test_points_add_up_and_explain(scored):
    for r in scored.collect():
        assert sum(f.points for f in r.factors) == r.risk_score
        assert [f.code for f in r.factors] == ["CREDIT", "DTI", "OVERDRAFT", "LOAN_SIZE"]
        assert r.reasons == [f.note for f in r.factors]
        assert all(0 <= f.points <= f.max_points for f in r.factors)
        assert all((f.impact == "increases risk") == (f.points > 0) for f in r.factors)


def test_principal_reasons(scored):
    reasons = {r.loan_id: r.principal_reasons for r in scored.collect()}
    assert reasons["strong-1"] == []
    assert reasons["mid-1"] == [
        "CREDIT: fair credit (665)",
        "DTI: elevated DTI (0.34)",
        "OVERDRAFT: 1 overdraft event(s)",
        "LOAN_SIZE: moderate loan amount",
    ]
    assert reasons["overdraft-heavy"] == ["OVERDRAFT: frequent overdrafts (7)", "CREDIT: good credit (720)"]


def test_values_as_text(scored):
    values = {r.loan_id: [f.value for f in r.factors] for r in scored.collect()}
    assert values["mid-2"] == ["690", "0.36", "2", "22000.0"]


def test_rows_for_the_history(scored):
    row = scorecard.assessment_rows(scored).where("loan_id = 'strong-1'").first()
    assert row.reasons == '["excellent credit (790)","healthy DTI (0.14)","no overdraft history","modest loan amount"]'
    assert row.factors.startswith('[{"code":"CREDIT","label":"Credit score","value":"790","points":0,')


def test_dti(spark):
    df = spark.createDataFrame([(60000.0, 12000.0, 12000.0, 12), (0.0, 1200.0, 100.0, 0)], "i double, d double, a double, t int")
    out = df.select(scorecard.dti_ratio(F.col("i"), F.col("d"), F.col("a"), F.col("t"))).collect()
    assert [r[0] for r in out] == [0.4, 200.0]


def test_routing(spark):
    df = spark.createDataFrame(
        [("a", "APPROVE", 20), ("b", "APPROVE", 21), ("c", "DECLINE", 65), ("d", "REVIEW", 50)],
        "loan_id string, recommendation string, risk_score long",
    )
    out = {r.loan_id: (r.decision, r.approver, r.rationale) for r in loans.route(df).collect()}
    assert out == {
        "a": ("APPROVE", "auto-policy", "auto-approved low risk 20"),
        "b": (None, None, None),
        "c": ("REJECT", "auto-policy", "auto-declined by policy"),
        "d": (None, None, None),
    }


def test_submission_rules(spark):
    rows = [("Ann", 1.0, 6), ("", 0.0, 5), (None, None, 361), ("Bo", 5.0, None)]
    df = spark.createDataFrame(rows, "customer_name string, amount double, term_months int")
    out = [len(r.errors) for r in loans.check_submissions(df).collect()]
    assert out == [0, 3, 3, 1]


def test_decision_rules(spark):
    rows = [("APPROVE", None), ("COUNTEROFFER", None), ("COUNTEROFFER", 0.0), ("COUNTEROFFER", 5.0), ("MAYBE", None)]
    df = spark.createDataFrame(rows, "decision string, counteroffer_amount double")
    assert [len(r.errors) for r in loans.check_decisions(df).collect()] == [0, 1, 1, 0, 1]


def test_status_after(spark):
    rows = [("APPROVE",), ("REJECT",), ("REQUEST_MODIFICATION",), ("COUNTEROFFER",), ("OTHER",)]
    df = spark.createDataFrame(rows, "d string").select(loans.status_after(F.col("d")))
    assert [r[0] for r in df.collect()] == ["APPROVED", "REJECTED", "MODIFIED", "MODIFIED", "PENDING_APPROVAL"]


def test_loan_status_shows_the_latest_versions(spark):
    at = datetime(2024, 1, 1)
    request = spark.createDataFrame(
        [("l1", "Ann", "a", Decimal(5), 12, "CREATED", at, at), ("l2", "Bo", "a", Decimal(6), 12, "CREATED", at, at)],
        "loan_id string, customer_name string, account_id string, amount decimal(38,9), term_months long, "
        "status string, submitted_at timestamp, updated_at timestamp",
    )
    risk = spark.createDataFrame(
        [("l1", 1, 50, "REVIEW", "r", "f"), ("l1", 2, 10, "APPROVE", "r", "f")],
        "loan_id string, version long, risk_score long, recommendation string, reasons string, factors string",
    )
    decision = spark.createDataFrame(
        [("l1", 1, "COUNTEROFFER", Decimal(4), "x", at), ("l1", 2, "APPROVE", None, "y", at)],
        "loan_id string, version long, decision string, counteroffer_amount decimal(38,9), approver string, decided_at timestamp",
    )
    view = loans.loan_status(request, risk, decision)
    rows = {r.loan_id: (r.risk_score, r.final_decision, r.counteroffer_amount, r.approver) for r in view.collect()}
    assert rows == {"l1": (10, "APPROVE", None, "y"), "l2": (None, None, None, None)}
    assert loans.get_loan(view, "l1").count() == 1
    assert [r.loan_id for r in loans.list_loans(view, limit=1).collect()] == ["l1"]


def test_overdraft_inputs(spark):
    request = spark.createDataFrame([("l1", "a"), ("l2", "b"), ("l3", None)], "loan_id string, account_id string")
    history = spark.createDataFrame([("a", 3)], "account_id string, overdraft_events long")
    got = {r.loan_id: r.overdraft_events for r in loans.overdraft_input(request, history).collect()}
    assert got == {"l1": 3, "l2": 0, "l3": 0}
    summary = spark.createDataFrame(
        [("a", 4, -1.0), ("b", 5, 1.0)], "account_id string, withdrawal_count long, net_balance double"
    )
    got = {r.loan_id: r.overdraft_events for r in loans.overdraft_proxy(request, summary).collect()}
    assert got == {"l1": 4, "l2": 0, "l3": 0}


def test_audit_trail(spark):
    at = datetime(2024, 1, 1)
    decisions = spark.createDataFrame(
        [("d1", "l1", "APPROVE", "ann", "ok", at)],
        "decision_id string, loan_id string, decision string, approver string, rationale string, decided_at timestamp",
    )
    row = loans.audit_trail(loans.decision_audit(decisions), "l1").first()
    assert (row.actor, row.action, row.detail) == ("ann", "DECISION_APPROVE", "ok")


def test_steward_views(spark):
    at = datetime(2024, 1, 1)
    runs = spark.createDataFrame(
        [("r1", "g", "DONE", at, at), ("r2", "g", "PLANNED", at, at)],
        "run_id string, goal string, status string, started_at timestamp, updated_at timestamp",
    )
    steps = spark.createDataFrame(
        [("r1", 0, "t0", 0.9, "applied", "ann"), ("r1", 1, "t1", 0.8, "timeout_auto_defer", None)],
        "run_id string, step_index long, task string, eval_score double, resolution string, approver string",
    )
    got = {r.run_id: (r.last_step, r.last_task) for r in steward.steward_status(runs, steps).collect()}
    assert got == {"r1": (1, "t1"), "r2": (None, None)}
    summary = steward.run_summary(steps).first()
    assert summary.summary == "2 failing rule(s); 1 remediation order(s) approved, 1 deferred/rejected."
