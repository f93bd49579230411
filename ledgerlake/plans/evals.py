"""Evaluation of logged conversations, regression checks and unit economics."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.text import numbers
from ledgerlake.operators import sketches

# ---- fixed values: tolerances and thresholds of the evaluation ----
SUCCESS_THRESHOLD = 0.7
TOLERANCE = {"grounding_accuracy": 0.10, "tool_utilization": 0.10, "hallucination_rate": 0.05}
INVERTED = ("hallucination_rate",)
REFUSED = "can't|cannot|unable|not able|don't have"
REFUSED_WRONGLY = "can't|cannot|unable"
ACCURACY_FLOORS = {"grounding_accuracy": 0.9, "tool_utilization": 0.9, "approval_recommendation_accuracy": 0.8}
HALLUCINATION_CEILING = 0.05
#: Characters that the log keeps of a question and of an answer.
QUESTION_WIDTH, ANSWER_WIDTH = 4000, 8000


def _since(as_of: datetime, **span: int) -> Column:
    return F.lit(as_of) - F.make_dt_interval(**{unit: F.lit(n) for unit, n in span.items()})


# ---- conversation log ----


def log_rows(turns: DataFrame, widths: Mapping[str, int] | None = None) -> DataFrame:
    """Turns as they are logged, whole; turns without a question are not logged.

    ``widths`` cuts the named columns for a log whose columns are that narrow.
    """
    logged = turns.where(F.trim(F.coalesce("question", F.lit(""))) != "").withColumn("answer", F.coalesce("answer", F.lit("")))
    return logged.withColumns({c: F.substring(c, 1, n) for c, n in (widths or {}).items()})


def log_page(
    conversation_log: DataFrame, scores: DataFrame, as_of: datetime, hours: int, limit: int, offset: int,
    shown: int | None = None,
) -> DataFrame:
    """One page of the log, newest first, with scores where a turn has them.

    A left join only adds rows, so the page comes from the first ``offset + limit`` turns;
    just their scores are looked up. ``shown`` cuts longer texts, marked with an ellipsis.
    """
    newest = [F.desc("ts"), F.asc("conversation_id")]
    turns = (
        conversation_log.where(F.col("ts") >= _since(as_of, hours=hours)).orderBy(*newest).limit(offset + limit)
    )
    verdicts = scores.join(turns.select("conversation_id"), "conversation_id", "left_semi").select(
        "conversation_id", "overall", "groundedness", "safety"
    )

    def shortened(name: str) -> Column:
        text = F.col(name)
        if shown is None:
            return text
        return F.when(F.length(text) > shown, F.concat(F.substring(text, 1, shown), F.lit("…"))).otherwise(text)

    return (
        turns.join(verdicts, "conversation_id", "left")
        .orderBy(*newest)
        .offset(offset)
        .limit(limit)
        .withColumn("question", shortened("question"))
        .withColumn("answer", shortened("answer"))
    )


def log_total(conversation_log: DataFrame, as_of: datetime, hours: int) -> DataFrame:
    """Turns of the window the pages run over."""
    return conversation_log.where(F.col("ts") >= _since(as_of, hours=hours)).agg(F.count(F.lit(1)).alias("total"))


def unscored_turns(
    conversation_log: DataFrame, scores: DataFrame, as_of: datetime, hours: int = 168, limit: int | None = 50
) -> DataFrame:
    """Answered turns of the window without a score, newest first. Errors are not scored."""
    candidates = (
        conversation_log.where(F.col("ts") >= _since(as_of, hours=hours))
        .where(F.col("question").isNotNull() & (F.coalesce("answer", F.lit("")) != ""))
        .where(~F.col("answer").startswith("[error]"))
        .join(scores.select("conversation_id"), "conversation_id", "left_anti")
        .select("conversation_id", "ts", "channel", "question", "answer", "context")
        .orderBy(F.desc("ts"), "conversation_id")
    )
    return candidates if limit is None else candidates.limit(limit)


def composite_scores(verdicts: DataFrame) -> DataFrame:
    """Judge verdicts with ``overall``: mean of the present metrics, each brought to 0..1.

    Ratings run 1 to 5; safety is 0 or 1 and counts as 1 when the judge left it out.
    """
    normal = [
        F.round((F.col(name) - 1) / 4, 3) for name in ("groundedness", "instruction_following", "coherence")
    ]
    safety = F.coalesce(F.col("safety"), F.lit(1.0))
    present = F.filter(F.array(*normal, safety), lambda v: v.isNotNull())
    total = F.aggregate(present, F.lit(0.0), lambda acc, v: acc + v)
    return verdicts.withColumn("safety", safety).withColumn("overall", F.round(total / F.size(present), 3))


def eval_summary(scores: DataFrame, conversation_log: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """Rolling averages of the scores, and latency percentiles over all turns, as one row."""
    since = _since(as_of, days=days)

    def normal(name: str) -> Column:
        return F.avg((F.col(name) - 1) / 4)

    quality = scores.where(F.col("scored_at") >= since).agg(
        F.count(F.lit(1)).alias("n"),
        F.max("scored_at").alias("last_scored_at"),
        F.round(normal("groundedness"), 3).alias("grounding_accuracy"),
        F.round(1 - normal("groundedness"), 3).alias("hallucination_rate"),
        F.round(normal("instruction_following"), 3).alias("instruction_following"),
        F.round(normal("coherence"), 3).alias("coherence"),
        F.round(F.avg("safety"), 3).alias("safety"),
        F.round(F.avg("overall"), 3).alias("overall"),
        F.lit(1).alias("_one"),
    )
    latency = (
        conversation_log.where(F.col("latency_ms").isNotNull() & (F.col("ts") >= since))
        .agg(F.percentile_approx("latency_ms", [0.5, 0.95], 10000).alias("_p"), F.lit(1).alias("_one"))
        .select("_one", F.get("_p", 0).alias("latency_p50_ms"), F.get("_p", 1).alias("latency_p95_ms"))
    )
    return quality.join(latency, "_one").drop("_one")


def rolling_latency(conversation_log: DataFrame, last: date, days: int = 7) -> DataFrame:
    """(window_end, n, latency_p50_ms, latency_p95_ms): latencies of the ``days`` days to each day, from daily sketches."""
    daily = sketches.daily_quantiles(conversation_log, "ts", "latency_ms")
    return sketches.trailing_quantiles(daily, days, last, {"latency_p50_ms": 0.5, "latency_p95_ms": 0.95})


# ---- grounding and refusals ----


def grounding(turns: DataFrame) -> DataFrame:
    """Turns (answer, facts array, account_id) with the numbers no fact supports.

    A number inside the account's own id is not a claim.
    """
    unsupported = F.filter(
        numbers(F.col("answer")),
        lambda n: ~F.array_contains(F.col("facts"), n) & ~F.coalesce(F.col("account_id"), F.lit("")).contains(n),
    )
    return turns.withColumn("unsupported", unsupported).withColumn("grounded", F.size("unsupported") == 0)


def score_turns(turns: DataFrame) -> DataFrame:
    """Canary scoring of (answer, expected_tool, expected_grounded, account_id): three flags.

    Without an expected tool the right answer is a refusal. Otherwise the answer must name
    its account, and refusing counts against tool use only.
    """
    answer = F.lower(F.coalesce("answer", F.lit("")))
    account = F.lower(F.coalesce("account_id", F.lit("")))
    refusal_wanted = F.col("expected_tool").isNull()
    refused = answer.rlike(REFUSED)
    on_topic = (F.trim(answer) != "") & answer.contains(account)
    missed = F.coalesce("expected_grounded", F.lit(False)) & ~on_topic
    return turns.withColumns(
        {
            "tool_ok": F.when(refusal_wanted, refused).when(missed, False).otherwise(~answer.rlike(REFUSED_WRONGLY)),
            "grounded": F.when(refusal_wanted, refused).otherwise(on_topic),
            "hallucinated": F.when(refusal_wanted, ~refused).otherwise(missed),
        }
    )


def run_metrics(scored_turns: DataFrame, *keys: str) -> DataFrame:
    """Canary metrics per run: shares of grounded, well-tooled and hallucinated turns."""

    def share(flag: str) -> Column:
        return F.round(F.avg(F.col(flag).cast("double")), 3)

    return scored_turns.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        share("grounded").alias("grounding_accuracy"),
        share("tool_ok").alias("tool_utilization"),
        share("hallucinated").alias("hallucination_rate"),
    )


def evaluation_gate(metrics: DataFrame, key: str) -> DataFrame:
    """(key, metric, value, bound, passed): metrics of each run against floors, hallucination against its ceiling.

    A metric that a run lacks does not pass.
    """
    limits = {**{m: (f, False) for m, f in ACCURACY_FLOORS.items()}, "hallucination_rate": (HALLUCINATION_CEILING, True)}
    cells = [
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(limit).alias("bound"), F.lit(most).alias("_most"))
        for m, (limit, most) in limits.items()
        if m in metrics.columns
    ]
    held = F.when(F.col("_most"), F.col("value") <= F.col("bound")).otherwise(F.col("value") >= F.col("bound"))
    return metrics.select(key, F.inline(F.array(*cells))).withColumn("passed", F.coalesce(held, F.lit(False))).drop("_most")


def regressions(current: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """Metrics of each run that moved past their tolerance against the run's baseline.

    Both inputs have one row per ``key`` with the metric columns; a metric missing on
    either side is skipped.
    """

    def long(df: DataFrame, value: str) -> DataFrame:
        cells = [
            F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(value), F.lit(t).alias("tolerance"))
            for m, t in TOLERANCE.items()
            if m in df.columns
        ]
        return df.select(key, F.inline(F.array(*cells)))

    both = long(current, "current").join(long(baseline, "baseline").drop("tolerance"), [key, "metric"])
    delta = F.col("current") - F.col("baseline")
    worse = F.when(F.col("metric").isin(*INVERTED), delta > F.col("tolerance")).otherwise(
        delta < -F.col("tolerance")
    )
    return (
        both.where(F.col("current").isNotNull() & F.col("baseline").isNotNull())
        .withColumn("delta", delta)
        .where(worse)
        .withColumn(
            "message",
            F.format_string(
                "%s: %.3f -> %.3f (%+.3f, tolerance %s)",
                "metric",
                "baseline",
                "current",
                "delta",
                F.col("tolerance").cast("string"),
            ),
        )
    )


def version_change(served: Column, baseline_served: Column) -> Column:
    """``old -> new`` when both served versions are known and differ; unknown is no change."""
    known = (F.coalesce(served, F.lit("")) != "") & (F.coalesce(baseline_served, F.lit("")) != "")
    return F.when(known & (served != baseline_served), F.concat_ws(" -> ", baseline_served, served))


def label_accuracy(results: DataFrame, predicted: str, expected: str, metric: str) -> DataFrame:
    """Share of rows whose prediction equals the label, against the metric's floor."""
    floor = ACCURACY_FLOORS[metric]
    return results.agg(
        F.lit(metric).alias("metric"),
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg((F.col(predicted) == F.col(expected)).cast("double")), 3).alias("accuracy"),
    ).withColumn("passed", F.col("accuracy") >= floor)


# ---- unit economics ----


def session_cost(requests: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """Tokens per session, agent, workload, principal, tier and model of completed calls."""
    return (
        requests.where((F.col("outcome") == "ok") & (F.col("surface") == "complete"))
        .where((F.col("ts") >= _since(as_of, days=days)) & F.col("session_id").isNotNull())
        .groupBy("session_id", "agent_id", "workload_class", "on_behalf_of", "tier", "model")
        .agg(
            F.sum(F.coalesce("input_tokens", F.lit(0))).alias("input_tokens"),
            F.sum(F.coalesce("output_tokens", F.lit(0))).alias("output_tokens"),
        )
    )


def unit_economics(
    requests: DataFrame, scores: DataFrame, as_of: datetime, days: int = 7, by_model: bool = True
) -> DataFrame:
    """Tasks, successes and tokens per workload; a task without a score is unjudged, not failed."""
    quality = scores.where(F.col("scored_at") >= _since(as_of, days=days)).select(
        F.col("conversation_id").alias("session_id"), "overall"
    )
    initiated = F.when(F.col("on_behalf_of").isNull(), "autonomous").otherwise("user-initiated")
    keys = ["workload_class", *(["model"] if by_model else []), "initiated_by"]
    return (
        session_cost(requests, as_of, days)
        .join(quality, "session_id", "left")
        .withColumn("initiated_by", initiated)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("tasks"),
            F.count_if(F.col("overall").isNull()).alias("unjudged"),
            F.count_if(F.col("overall") >= SUCCESS_THRESHOLD).alias("successful"),
            F.sum("input_tokens").alias("input_tokens"),
            F.sum("output_tokens").alias("output_tokens"),
            F.round(F.avg("overall"), 3).alias("avg_quality"),
        )
        .orderBy(F.desc("tasks"), *keys)
    )


def priced(economics: DataFrame, prices: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Unit economics with cost, cost per success and a TOTAL row.

    ``prices`` maps a model to USD per million input and output tokens; ``_default`` serves
    the models without an entry.
    """
    table = F.create_map(
        *[
            x
            for model, (per_in, per_out) in prices.items()
            for x in (F.lit(model), F.struct(F.lit(float(per_in)).alias("i"), F.lit(float(per_out)).alias("o")))
        ]
    )
    price = F.coalesce(F.try_element_at(table, F.col("model")), F.try_element_at(table, F.lit("_default")))
    cost = F.col("input_tokens") / 1_000_000.0 * price["i"] + F.col("output_tokens") / 1_000_000.0 * price["o"]
    rows = economics.withColumn("cost", cost).select(
        "workload_class",
        "model",
        "initiated_by",
        "tasks",
        "unjudged",
        "successful",
        (F.col("input_tokens") + F.col("output_tokens")).alias("tokens"),
        "cost",
    )
    total = rows.agg(
        F.lit("TOTAL").alias("workload_class"),
        F.lit(None).cast("string").alias("model"),
        F.lit(None).cast("string").alias("initiated_by"),
        *[F.sum(c).alias(c) for c in ("tasks", "unjudged", "successful", "tokens", "cost")],
    )
    return (
        rows.unionByName(total)
        .withColumn("cost_per_success", F.try_divide(F.col("cost"), F.col("successful").cast("double")))
        .withColumn("unjudged_pct", F.round(F.try_divide(F.col("unjudged") * 100.0, F.col("tasks").cast("double"))))
    )


# ---- agents ----


def consequential_actions(agent_action_log: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    return (
        agent_action_log.where(F.col("consequential") & (F.col("ts") >= _since(as_of, days=days)))
        .select("ts", "agent_id", "owner", "tool", "authorized", "hitl_approver", "model_version")
        .orderBy(F.desc("ts"), "agent_id")
    )


def unauthorized_calls(agent_action_log: DataFrame) -> DataFrame:
    return (
        agent_action_log.where(~F.col("authorized"))
        .groupBy("agent_id", "tool")
        .agg(F.count(F.lit(1)).alias("calls"))
        .orderBy(F.desc("calls"), "agent_id", "tool")
    )


def registry_by_due_date(registry: DataFrame) -> DataFrame:
    return registry.orderBy("recert_due", "agent_id")
