from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerlake.plans import evals

NOW = datetime(2024, 1, 31)


def test_composite_skips_what_is_missing(spark):
    df = spark.createDataFrame(
        [(None, 5.0, 3.0, 1.0), (1.0, 1.0, 1.0, 0.0), (4.0, 4.0, 4.0, None)],
        "groundedness double, instruction_following double, coherence double, safety double",
    )
    assert [r.overall for r in evals.composite_scores(df).collect()] == [0.833, 0.0, 0.813]


def log(spark, rows):
    full = [(i, NOW - timedelta(hours=h), q, a, "kb", None, 10) for i, h, q, a in rows]
    return spark.createDataFrame(
        full, "conversation_id string, ts timestamp, question string, answer string, channel string, context string, latency_ms long"
    )


def test_unscored_turns(spark):
    rows = [("a", 1, "q", "x"), ("b", 2, "q", "x"), ("c", 3, "q", ""), ("d", 4, "q", None), ("e", 5, "q", "[error] x"),
            ("f", 6, None, "x"), ("g", 300, "q", "x"), ("h", 7, "q", "x")]
    scores = spark.createDataFrame([("b",)], "conversation_id string")
    got = evals.unscored_turns(log(spark, rows), scores, NOW)
    assert [r.conversation_id for r in got.collect()] == ["a", "h"]
    assert [r.conversation_id for r in evals.unscored_turns(log(spark, rows), scores, NOW, limit=1).collect()] == ["a"]


def test_log_rows_are_whole(spark):
    df = spark.createDataFrame([("q" * 5000, "a" * 9000, None), ("  ", "a", None)], "question string, answer string, context string")
    for widths, expected in ((None, (5000, 9000)), ({"question": 4000}, (4000, 9000))):
        rows = evals.log_rows(df, widths).collect()
        assert [(len(r.question), len(r.answer)) for r in rows] == [expected]


def test_log_page(spark):
    rows = [(f"c{i}", i, "q" * 700, "a") for i in range(10)]
    scores = spark.createDataFrame([("c4", 0.5, 3.0, 1.0)], "conversation_id string, overall double, groundedness double, safety double")
    page = evals.log_page(log(spark, rows), scores, NOW, 168, limit=3, offset=3, shown=600).orderBy(F.desc("ts")).collect()
    assert [(r.conversation_id, r.overall) for r in page] == [("c3", None), ("c4", 0.5), ("c5", None)]
    assert page[0].question == "q" * 600 + "…"


def test_grounding(spark):
    df = spark.createDataFrame(
        [("Balance 125.50 on acct-001", ["125.50"], "acct-001"), ("You have 99", ["125.50"], "acct-001"), ("hello", [], None)],
        "answer string, facts array<string>, account_id string",
    )
    assert [r.grounded for r in evals.grounding(df).collect()] == [True, False, True]


@pytest.mark.parametrize(
    "answer, tool, grounded, account, expected",
    [
        ("I can't help with that", None, False, None, (True, True, False)),
        ("Sure, 5", None, False, None, (False, False, True)),
        ("Balance of ACCT-1 is 5", "t", True, "acct-1", (True, True, False)),
        ("Balance is 5", "t", True, "acct-1", (False, False, True)),
        ("I cannot read acct-1", "t", True, "acct-1", (False, True, False)),
        ("", "t", False, None, (True, False, False)),
    ],
)
def test_turn_scores(spark, answer, tool, grounded, account, expected):
    df = spark.createDataFrame(
        [(answer, tool, grounded, account)], "answer string, expected_tool string, expected_grounded boolean, account_id string"
    )
    row = evals.score_turns(df).first()
    assert (row.tool_ok, row.grounded, row.hallucinated) == expected


def metrics(spark, grounding, tool, hallucination):
    return spark.createDataFrame(
        [("r", grounding, tool, hallucination)],
        "run string, grounding_accuracy double, tool_utilization double, hallucination_rate double",
    )


def test_regressions(spark):
    base = metrics(spark, 1.0, 1.0, 0.0)

    def fired(current, against=base):
        return {r.metric: r.message for r in evals.regressions(current, against, "run").collect()}

    assert fired(metrics(spark, 0.95, 1.0, 0.0)) == {}
    assert fired(metrics(spark, 0.85, 1.0, 0.0)) == {
        "grounding_accuracy": "grounding_accuracy: 1.000 -> 0.850 (-0.150, tolerance 0.1)"
    }
    assert set(fired(metrics(spark, 1.0, 1.0, 0.2))) == {"hallucination_rate"}
    assert fired(metrics(spark, 1.0, 1.0, 0.0), metrics(spark, 1.0, 1.0, 0.2)) == {}
    assert fired(metrics(spark, None, 1.0, 0.0)) == {}
    assert fired(base.drop("tool_utilization")) == {}


def test_version_change(spark):
    df = spark.createDataFrame([("b", "a"), ("a", "a"), (None, "a"), ("b", None), ("", "a")], "s string, o string")
    got = [r[0] for r in df.select(evals.version_change(F.col("s"), F.col("o"))).collect()]
    assert got == ["a -> b", None, None, None, None]


def requests(spark):
    rows = [
        ("s1", "kb", None, "m1", 100, 10, "ok", "complete"),
        ("s1", "kb", None, "m1", 100, None, "ok", "complete"),
        ("s2", "kb", None, "m1", 50, 5, "ok", "complete"),
        ("s3", "kb", "u", "m2", 1_000_000, 0, "ok", "complete"),
        ("s4", "kb", "u", "m2", 7, 7, "error", "complete"),
        (None, "kb", "u", "m2", 7, 7, "ok", "complete"),
    ]
    full = [(s, "ag", w, o, "t", m, i, out, oc, su, NOW) for s, w, o, m, i, out, oc, su in rows]
    return spark.createDataFrame(
        full,
        "session_id string, agent_id string, workload_class string, on_behalf_of string, tier string, model string, "
        "input_tokens long, output_tokens long, outcome string, surface string, ts timestamp",
    )


def test_unjudged_is_not_failed(spark):
    scores = spark.createDataFrame([("s1", 0.9, NOW)], "conversation_id string, overall double, scored_at timestamp")
    economics = evals.unit_economics(requests(spark), scores, NOW)
    got = {(r.model, r.initiated_by): r for r in economics.collect()}
    auto, user = got[("m1", "autonomous")], got[("m2", "user-initiated")]
    assert (auto.tasks, auto.unjudged, auto.successful, auto.input_tokens, auto.output_tokens) == (2, 1, 1, 250, 15)
    assert (user.tasks, user.unjudged, user.successful, user.avg_quality) == (1, 1, 0, None)
    priced = {r.workload_class + str(r.model): r for r in evals.priced(economics, {"m1": (2.0, 4.0), "_default": (1.0, 1.0)}).collect()}
    assert priced["kbm2"].cost == 1.0 and priced["kbm2"].cost_per_success is None
    assert priced["kbm1"].cost == pytest.approx(250 / 1e6 * 2 + 15 / 1e6 * 4)
    total = priced["TOTALNone"]
    assert (total.tasks, total.unjudged, total.successful, total.unjudged_pct) == (3, 2, 1, 67.0)


def test_eval_summary(spark):
    scores = evals.composite_scores(
        spark.createDataFrame(
            [("a", NOW, 5.0, 5.0, 5.0, 1.0), ("b", NOW, None, 1.0, 3.0, 1.0), ("c", NOW - timedelta(days=8), 1.0, 1.0, 1.0, 0.0)],
            "conversation_id string, scored_at timestamp, groundedness double, instruction_following double, coherence double, safety double",
        )
    )
    row = evals.eval_summary(scores, log(spark, [("a", 1, "q", "x"), ("b", 2, "q", "x")]), NOW).first()
    assert (row.n, row.grounding_accuracy, row.hallucination_rate, row.instruction_following) == (2, 1.0, 0.0, 0.5)
    assert (row.safety, row.latency_p50_ms, row.latency_p95_ms) == (1.0, 10, 10)


def test_agent_reports(spark):
    rows = [(NOW, "a", "o", "t", False, True, None, "v"), (NOW - timedelta(days=9), "a", "o", "t", True, True, None, "v"), (NOW, "b", "o", "u", True, False, None, "v")]
    df = spark.createDataFrame(
        rows, "ts timestamp, agent_id string, owner string, tool string, authorized boolean, consequential boolean, hitl_approver string, model_version string"
    )
    assert [r.agent_id for r in evals.consequential_actions(df, NOW).collect()] == ["a"]
    assert [tuple(r) for r in evals.unauthorized_calls(df).collect()] == [("a", "t", 1)]
