"""Steward runs: the view of each run's latest step, and the outcome counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.operators.ranking import latest_per_key


# ---- fixed values: wording of the run summary ----
SUMMARY_TEXT = "%d failing rule(s); %d remediation order(s) approved, %d deferred/rejected."


def steward_status(steward_run: DataFrame, steward_decision: DataFrame) -> DataFrame:
    """Every run with its latest step."""
    last = latest_per_key(steward_decision, ["run_id"], [F.desc("step_index")]).select(
        "run_id",
        F.col("step_index").alias("last_step"),
        F.col("task").alias("last_task"),
        F.col("eval_score").alias("last_score"),
        F.col("resolution").alias("last_resolution"),
        F.col("approver").alias("last_approver"),
    )
    return steward_run.select("run_id", "goal", "status", "started_at", "updated_at").join(last, "run_id", "left")


def run_summary(steward_decision: DataFrame) -> DataFrame:
    """Rules, applied orders, deferred ones and a sentence, per run with decisions."""
    counts = steward_decision.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("rules"), F.count_if(F.col("resolution") == "applied").alias("applied")
    )
    deferred = F.col("rules") - F.col("applied")
    return counts.withColumn("deferred", deferred).withColumn(
        "summary",
        F.format_string(
            SUMMARY_TEXT,
            "rules",
            "applied",
            "deferred",
        ),
    )


def findings_with_history(findings: DataFrame, steward_decision: DataFrame) -> DataFrame:
    """Scan findings with the latest recorded step for the same task, if any."""
    latest = latest_per_key(
        steward_decision, ["task"], [F.desc("decided_at"), F.desc("decision_id")]
    ).select(F.col("task").alias("label"), "resolution", "approver", "decided_at")
    return findings.join(latest, "label", "left")
