from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from ledgerlake import schemas
from ledgerlake.operators import graph, rules, security
from ledgerlake.operators.rules import Rule
from ledgerlake.session import scratch_dir


@pytest.fixture(scope="module")
def table(spark):
    rows = [
        ("k1", "DEPOSIT", 5.0, "POSTED"),
        ("k2", "BRIBE", None, "POSTED"),
        ("k2", "FEE", 50.0, "PENDING"),
        ("k3", None, None, "PENDING"),
    ]
    return spark.createDataFrame(rows, "idempotency_key string, txn_type string, amount double, status string")


RULES = (
    Rule("amount", "VALIDITY", "non_null"),
    Rule("txn_type", "VALIDITY", "set", values=("DEPOSIT", "FEE")),
    Rule("idempotency_key", "UNIQUENESS", "unique", severity="blocking"),
    Rule("amount", "VALIDITY", "range", low=0, high=10),
    Rule("amount", "COMPLETENESS", "non_null", where="status = 'POSTED'"),
    Rule("status", "UNIQUENESS", "unique"),
)


def test_scan(table):
    got = {r.rule: (r.evaluated, r.passed_count, r.passed) for r in rules.scan(table, "s", "t", RULES).collect()}
    assert got == {0: (4, 2, False), 1: (4, 2, False), 2: (4, 2, False), 3: (4, 1, False), 4: (2, 1, False), 5: (4, 0, False)}


def test_failing_queries_select_the_failing_rows(spark, table):
    table.createOrReplaceTempView("scanned_rows")
    results = rules.scan(table, "s", "scanned_rows", RULES)
    for r in results.collect():
        assert spark.sql(r.failing_rows_query).count() == r.evaluated - r.passed_count


def test_scan_of_an_empty_table(table):
    got = rules.scan(table.where(F.lit(False)), "s", "t", RULES).collect()
    assert all(r.evaluated == 0 and r.passed for r in got)


def test_scores_and_findings(spark):
    at = datetime(2024, 1, 1)
    results = spark.createDataFrame(
        [("s", 0, "VALIDITY", "amount", "warn", 1000, 987, "q", False), ("s", 1, "VALIDITY", "x", "warn", 10, 10, "q", True)],
        "scan string, rule int, dimension string, column string, severity string, evaluated long, "
        "passed_count long, failing_rows_query string, passed boolean",
    )
    score = rules.score(results, F.lit(at)).first()
    assert (score.score, score.outcome, score.published) == (50.0, "FAIL", "50.0% (FAIL)")
    found = rules.propose(rules.assess(rules.findings(results))).collect()
    assert len(found) == 1
    assert found[0].confidence == 0.97
    assert found[0].reason == "small blast radius (1.3% rows) — low-risk remediation"
    assert found[0].label == "Remediate s: VALIDITY on amount failed"
    assert found[0].proposal.startswith("Quarantine the 13 failing row(s) on amount, ")


@pytest.mark.parametrize(
    "evaluated, passed, confidence, start",
    [(100, 100, 1.0, "rule failed but"), (0, 0, 1.0, "rule failed but"), (100, 95, 0.9, "large blast"), (100, 10, 0.0, "large blast")],
)
def test_confidence_bands(spark, evaluated, passed, confidence, start):
    df = spark.createDataFrame([(evaluated, passed)], "evaluated long, passed_count long")
    row = rules.assess(df).first()
    assert row.confidence == confidence and row.reason.startswith(start)


def test_referential_integrity(spark):
    child = spark.createDataFrame([("a",), ("a",), ("x",)], "account_id string")
    parent = spark.createDataFrame([("a",), ("b",)], "account_id string")
    row = rules.referential_result(child, "account_id", parent, "account_id", "s").first()
    assert (row.evaluated, row.passed_count, row.passed) == (3, 2, False)
    assert [r.account_id for r in rules.orphans(child, "account_id", parent, "account_id").collect()] == ["x"]


def test_quarantine(table):
    sound, failing = rules.quarantine(table, RULES[:5])
    assert sorted(r.idempotency_key for r in sound.collect()) == ["k1"]
    assert failing.count() == 3
    marks = {(r.idempotency_key, r.status): r.failed_rules for r in failing.collect()}
    assert "idempotency_key:unique" in marks[("k2", "POSTED")]
    assert marks[("k2", "PENDING")] == ["amount:range", "idempotency_key:unique"]


def test_gate(spark):
    assets = spark.createDataFrame([("a", "s1"), ("b", "s2"), ("c", "s3")], "asset string, scan string")
    results = spark.createDataFrame(
        [("s1", "blocking", "D", "x", False), ("s2", "warn", "D", "y", False), ("s2", "blocking", "D", "z", True)],
        "scan string, severity string, dimension string, column string, passed boolean",
    )
    got = {r.asset: (r.answerable, r.caveats) for r in rules.gate(assets, results).collect()}
    assert got == {"a": (False, []), "b": (True, ["D on y"]), "c": (True, [])}


def test_profile(table):
    got = {r.column: r for r in rules.profile(table, ["txn_type", "amount"]).collect()}
    assert (got["amount"].rows, got["amount"].nulls, got["amount"].distinct_values, got["amount"].null_ratio) == (4, 2, 2, 0.5)
    assert got["txn_type"].top_values == "BRIBE=1; DEPOSIT=1; FEE=1"
    quick = {r.column: r for r in rules.quick_profile(table, ["idempotency_key"]).collect()}
    assert (quick["idempotency_key"].distinct_values, quick["idempotency_key"].top_values[0]) == (3, "k2")


def test_contract(spark, table):
    columns = (("idempotency_key", "STRING", True), ("amount", "NUMERIC", True), ("status", "STRING", True), ("gone", "STRING", False), ("txn_type", "STRING", True))
    got = {r.column: (r.present, r.type_matches, r.nulls, r.conforms) for r in rules.contract_conformance(table, "c", columns).collect()}
    assert got["idempotency_key"] == (True, True, 0, True)
    assert got["amount"] == (True, False, 2, False)
    assert got["gone"] == (False, False, 4, False)
    assert got["txn_type"] == (True, True, 1, False)


def test_recertification(spark):
    rows = [("a", "HIGH", date(2024, 1, 1)), ("b", "MEDIUM", date(2024, 1, 1)), ("c", "LOW", date(2023, 4, 25)), ("d", "LOW", date(2023, 1, 1))]
    df = spark.createDataFrame(rows, "agent_id string, risk_tier string, last_recertified date")
    got = {r.agent_id: (r.recert_due, r.finding) for r in rules.recertification(df, date(2024, 4, 10)).collect()}
    assert got == {
        "a": (date(2024, 3, 31), "fail"),
        "b": (date(2024, 6, 29), "ok"),
        "c": (date(2024, 4, 24), "warn"),
        "d": (date(2024, 1, 1), "fail"),
    }


def test_masking(spark):
    df = spark.createDataFrame([("t", 5.0, "acc")], "transaction_id string, amount double, counterparty_account string")
    masked = security.masked_view(df, "transaction", {"PII_FINANCIAL": "masked"})
    assert masked.schema == df.schema or [f.dataType for f in masked.schema] == [f.dataType for f in df.schema]
    assert tuple(masked.first()) == ("t", None, None)
    assert tuple(security.masked_view(df, "transaction", {"PII_FINANCIAL": "clear"}).first()) == ("t", 5.0, "acc")
    with pytest.raises(PermissionError):
        security.masked_view(df, "transaction", {})
    assert tuple(security.masked_view(df.select("transaction_id"), "transaction", {}).first()) == ("t",)


def test_row_policy(spark):
    df = spark.createDataFrame([("POSTED",), ("PENDING",)], "status string")
    assert security.posted_rows_only(df, granted=True).count() == 1
    assert security.posted_rows_only(df, granted=False).count() == 0


def test_perimeter_has_no_protected_identifiers():
    tables = {"dim_customer": "customer", "dim_account": "account", "fact_transaction": "transaction"}
    shown = {(tables[v], c) for v, columns in schemas.PERIMETER.items() for c in columns}
    assert {pair for pair in shown if pair in schemas.COLUMN_TAGS} == {("transaction", "amount")}


def test_assignments_declared_and_deployed_agree(spark):
    declared = spark.createDataFrame(
        [("full_name", "PII_DIRECT"), ("email", "PII_DIRECT"), ("account_number", "PII_FINANCIAL"),
         ("amount", "PII_FINANCIAL"), ("counterparty_account", "PII_FINANCIAL")],
        "column string, tag string",
    )
    silver = [(c, tag) for (t, c), tag in schemas.COLUMN_TAGS.items() if t in ("customer", "account", "transaction")]
    deployed = spark.createDataFrame(silver, "column string, tag string")
    assert security.assignment_differences(declared, deployed).count() == 0
    extra = deployed.union(spark.createDataFrame([("ssn", "PII_DIRECT")], "column string, tag string"))
    assert [tuple(r) for r in security.assignment_differences(declared, extra).collect()] == [("ssn", "PII_DIRECT", "deployed")]


def test_join_paths():
    assert graph.join_path("fact_transaction", "dim_customer") == [
        ("fact_transaction", "account_id", "dim_account", "account_id"),
        ("dim_account", "customer_id", "dim_customer", "customer_id"),
    ]
    with pytest.raises(ValueError):
        graph.join_path("dim_customer", "fact_transaction")


def test_relationship_table(spark):
    assert graph.relationships(spark).count() == 4


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def test_walks_around_a_hub(spark):
    pairs = [(f"s{i}", "hub") for i in range(50)] + [("hub", f"t{i}") for i in range(40)] + [("t0", "end")]
    got = {r.node: (r.walks_1, r.walks_2, r.walks_3) for r in graph.walk_counts(edges(spark, pairs), 3).collect()}
    assert got["s0"] == (1, 40, 1)
    assert got["hub"] == (40, 1, 0)
    assert got["t0"] == (1, 0, 0)


def test_hops(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")]
    seeds = spark.createDataFrame([("a",)], "node string")
    got = {r.node: r.hops for r in graph.hops_from(seeds, edges(spark, pairs), 3).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_deposit_pattern_equals_the_bridge(bank):
    from ledgerlake.plans import semantic

    pattern = graph.deposits_by_owner_segment(bank.bank_customer, bank.account, bank.transaction)
    bridge = semantic.deposits_by_segment(bank.transaction, bank.account, bank.bank_customer)
    assert {(r.segment, r.total) for r in pattern.collect()} == {(r.segment, r.total_deposits) for r in bridge.collect()}


def test_quarantine_to_a_side_table(spark):
    path = scratch_dir(spark, "side")
    checks = [Rule("v", "VALIDITY", "non_null"), Rule("k", "UNIQUENESS", "unique")]
    first = spark.createDataFrame([("a", 1), ("b", None), (None, 2)], "k string, v int")
    second = spark.createDataFrame([("c", 3), ("c", None)], "k string, v int")
    sound = [rules.quarantine_to(load, checks, path).collect() for load in (first, second)]
    assert [sorted(r.v for r in part) for part in sound] == [[1, 2], []]
    side = {(r.k, r.v): sorted(r.failed_rules) for r in spark.read.parquet(path).collect()}
    assert side == {("b", None): ["v:non_null"], ("c", 3): ["k:unique"], ("c", None): ["k:unique", "v:non_null"]}
