"""Data-quality rules, scans, profiles and contract checks.

A scan evaluates all rules of a table together: row rules are counted while grouping by
the first unique column, so one read and one shuffle serve the whole rule set.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.operators.ranking import top_n_per_key
from ledgerlake.session import written
from ledgerlake.sources.files import append_rows


@dataclass(frozen=True)
class Rule:
    """One rule on one column. ``where`` limits the rows it applies to."""

    column: str
    dimension: str
    kind: str  # non_null | set | unique | range
    values: tuple = ()
    low: float | None = None
    high: float | None = None
    where: str | None = None
    severity: str = "warn"

    def condition(self) -> str:
        """SQL condition a sound row meets."""
        if self.kind == "non_null":
            return f"{self.column} IS NOT NULL"
        if self.kind == "set":
            return f"{self.column} IN ({', '.join(repr(v) for v in self.values)})"
        if self.kind == "range":
            bounds = []
            if self.low is not None:
                bounds.append(f"{self.column} >= {self.low}")
            if self.high is not None:
                bounds.append(f"{self.column} <= {self.high}")
            return " AND ".join(bounds)
        raise ValueError(f"{self.kind} has no row condition")

    def passes(self) -> Column:
        """True for a row meeting the condition; a null column does not meet it."""
        return F.coalesce(F.expr(self.condition()), F.lit(False))

    def applies(self) -> Column:
        return F.lit(True) if self.where is None else F.coalesce(F.expr(self.where), F.lit(False))

    def failing_query(self, table: str) -> str:
        if self.kind == "unique":
            return (
                f"SELECT * FROM {table} WHERE {self.column} IN "
                f"(SELECT {self.column} FROM {table} GROUP BY {self.column} HAVING COUNT(*) > 1)"
            )
        scope = f"({self.where}) AND " if self.where else ""
        return f"SELECT * FROM {table} WHERE {scope}NOT COALESCE({self.condition()}, FALSE)"


# ---- fixed values: quality rules of the contracts, allowed values of their columns, platform rules ----
CONTRACT_RULES = {
    "deposit-transactions": (
        Rule("amount", "VALIDITY", "non_null"),
        Rule("txn_type", "VALIDITY", "set", values=("DEPOSIT", "WITHDRAWAL", "TRANSFER", "FEE")),
        Rule("idempotency_key", "UNIQUENESS", "unique"),
        Rule("transaction_id", "UNIQUENESS", "unique", severity="blocking"),
        Rule("amount", "COMPLETENESS", "non_null", where="status = 'POSTED'"),
    ),
    "customer-master": (
        Rule("customer_id", "UNIQUENESS", "unique"),
        Rule("customer_natural_key", "VALIDITY", "non_null"),
        Rule("segment", "COMPLETENESS", "non_null"),
    ),
    "loan-master": (
        Rule("loan_id", "UNIQUENESS", "unique"),
        Rule("risk_score", "VALIDITY", "range", low=0, high=1000, where="risk_score IS NOT NULL"),
        Rule("recommendation", "VALIDITY", "set", values=("APPROVE", "DECLINE", "REVIEW"), where="recommendation IS NOT NULL"),
        Rule("final_decision", "VALIDITY", "set", values=("APPROVE", "DECLINE", "REVIEW"), where="final_decision IS NOT NULL"),
    ),
    "overdraft-history": (
        Rule("account_id", "UNIQUENESS", "unique"),
        Rule("overdraft_events", "VALIDITY", "non_null"),
    ),
    "bank-knowledge-base": (
        Rule("doc_id", "UNIQUENESS", "unique"),
        Rule("content", "VALIDITY", "non_null"),
    ),
}


def scan(df: DataFrame, scan_name: str, table: str, rules: Sequence[Rule]) -> DataFrame:
    """One result row per rule: evaluated and passed counts, passed flag, query of failing rows."""
    indexed = list(enumerate(rules))
    unique = [(i, r) for i, r in indexed if r.kind == "unique"]
    per_row = [(i, r) for i, r in indexed if r.kind != "unique"]
    passes = []
    first = unique[0] if unique else None
    if per_row or first:
        passes.append(_one_pass(df, scan_name, table, per_row, first))
    passes += [_one_pass(df, scan_name, table, [], extra) for extra in unique[1:]]
    out = passes[0]
    for more in passes[1:]:
        out = out.unionByName(more)
    return out


def _one_pass(
    df: DataFrame, scan_name: str, table: str, per_row: list[tuple[int, Rule]], unique: tuple[int, Rule] | None
) -> DataFrame:
    counts: list[Column] = []
    for i, rule in per_row:
        counts += [
            F.count_if(rule.applies()).alias(f"_e{i}"),
            F.count_if(rule.applies() & rule.passes()).alias(f"_p{i}"),
        ]
    if unique:
        i = unique[0]
        grouped = df.groupBy(unique[1].column).agg(F.count(F.lit(1)).alias("_n"), *counts)
        totals = [F.sum(f"_{side}{j}").alias(f"_{side}{j}") for j, _ in per_row for side in "ep"]
        row = grouped.agg(
            F.sum("_n").alias(f"_e{i}"), F.count_if(F.col("_n") == 1).alias(f"_p{i}"), *totals
        )
    else:
        row = df.agg(*counts)
    chosen = sorted(per_row + ([unique] if unique else []), key=lambda pair: pair[0])
    results = [
        F.struct(
            F.lit(scan_name).alias("scan"),
            F.lit(i).alias("rule"),
            F.lit(rule.dimension).alias("dimension"),
            F.lit(rule.column).alias("column"),
            F.lit(rule.severity).alias("severity"),
            F.coalesce(F.col(f"_e{i}"), F.lit(0)).alias("evaluated"),
            F.coalesce(F.col(f"_p{i}"), F.lit(0)).alias("passed_count"),
            F.lit(rule.failing_query(table)).alias("failing_rows_query"),
        )
        for i, rule in chosen
    ]
    return row.select(F.inline(F.array(*results))).withColumn(
        "passed", F.col("evaluated") == F.col("passed_count")
    )


def referential_result(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str, scan_name: str) -> DataFrame:
    """Result row of a blocking rule: every child key resolves to a parent.

    Child rows are counted per key first, so a busy key is one row in the join.
    """
    per_key = child.groupBy(F.col(child_key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    known = parent.select(F.col(parent_key).alias("_key")).distinct().withColumn("_known", F.lit(True))
    return (
        per_key.join(known, "_key", "left")
        .agg(
            F.coalesce(F.sum("_n"), F.lit(0)).alias("evaluated"),
            F.coalesce(F.sum(F.when(F.col("_known"), F.col("_n"))), F.lit(0)).alias("passed_count"),
        )
        .select(
            F.lit(scan_name).alias("scan"),
            F.lit("INTEGRITY").alias("dimension"),
            F.lit(child_key).alias("column"),
            F.lit("blocking").alias("severity"),
            "evaluated",
            "passed_count",
            (F.col("evaluated") == F.col("passed_count")).alias("passed"),
        )
    )


def orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose key has no parent."""
    return child.join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def quarantine(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """Split into (sound rows, failing rows); failing rows list the columns at fault.

    The rows are written once, so what derives them runs once for the counts and both parts.
    """
    marks = [
        F.when(r.applies() & ~r.passes(), F.lit(f"{r.column}:{r.kind}")) for r in rules if r.kind != "unique"
    ]
    checked = df = written(df, "checked")
    for i, rule in enumerate(r for r in rules if r.kind == "unique"):
        repeated = (
            df.groupBy(F.col(rule.column).alias(f"_key{i}"))
            .agg(F.count(F.lit(1)).alias("_n"))
            .where(F.col("_n") > 1)
            .select(f"_key{i}", F.lit(True).alias(f"_dup{i}"))
        )
        # Null keys repeat like any other, as in the scan.
        checked = checked.join(repeated, F.col(rule.column).eqNullSafe(F.col(f"_key{i}")), "left")
        marks.append(F.when(F.col(f"_dup{i}"), F.lit(f"{rule.column}:unique")))
    marked = checked.withColumn("failed_rules", F.filter(F.array(*marks), lambda m: m.isNotNull())).select(
        *df.columns, "failed_rules"
    )
    sound = marked.where(F.size("failed_rules") == 0).drop("failed_rules")
    return sound, marked.where(F.size("failed_rules") > 0)


def quarantine_to(df: DataFrame, rules: Sequence[Rule], side_table: str) -> DataFrame:
    """Sound rows of ``df``; the failing ones are appended to the table at ``side_table`` with the columns at fault."""
    sound, failing = quarantine(df, rules)
    append_rows(failing, side_table)
    return sound


# ---- over scan results ----

# ---- fixed values: wording of scores, findings and remediation orders ----
PASS, FAIL = "PASS", "FAIL"
SCORE_TEXT = "%.1f%% (%s)"
FINDING_LABEL = "Remediate %s: %s on %s failed"
NOT_QUANTIFIED = "rule failed but no rows quantified — review the scan"
SMALL_RADIUS = "small blast radius (%s rows) — low-risk remediation"
LARGE_RADIUS = "large blast radius (%s rows) — review carefully before approving"
SMALL_RATIO = 0.05
WHOLE_TABLE = "the table"
ORDER_TEXT = (
    "Quarantine the %d failing row(s) on %s, request an upstream backfill from the owning team, "
    "then re-run %s to verify. (dimension: %s)"
)


def score(results: DataFrame, run_time: Column) -> DataFrame:
    """Share of rules passed per scan, PASS or FAIL, and the text published with the run time."""
    share = F.avg(F.col("passed").cast("double")) * 100
    outcome = F.when(F.bool_and("passed"), PASS).otherwise(FAIL)
    return (
        results.groupBy("scan")
        .agg(share.alias("score"), outcome.alias("outcome"))
        .withColumn("published", F.format_string(SCORE_TEXT, "score", "outcome"))
        .withColumn("last_run", run_time)
    )


def findings(results: DataFrame) -> DataFrame:
    """One row per failed rule."""
    return results.where(~F.col("passed")).withColumns(
        {
            "finding_id": F.concat(F.col("scan"), F.lit("#"), F.col("rule").cast("string")),
            "label": F.format_string(FINDING_LABEL, "scan", "dimension", "column"),
        }
    )


def assess(found: DataFrame) -> DataFrame:
    """Add fail ratio, confidence and its reason to findings."""
    ratio = F.coalesce(
        F.try_divide((F.col("evaluated") - F.col("passed_count")).cast("double"), F.col("evaluated").cast("double")),
        F.lit(0.0),
    )
    share = F.format_string("%.1f%%", ratio * 100)
    return found.withColumns(
        {
            "fail_ratio": ratio,
            "confidence": F.round(F.greatest(F.lit(0.0), 1 - ratio * 2), 2),
            "reason": F.when(ratio == 0, NOT_QUANTIFIED)
            .when(ratio < SMALL_RATIO, F.format_string(SMALL_RADIUS, share))
            .otherwise(F.format_string(LARGE_RADIUS, share)),
        }
    )


def propose(found: DataFrame) -> DataFrame:
    """Add the remediation order put to the approver."""
    bad = F.greatest(F.lit(0), F.col("evaluated") - F.col("passed_count"))
    return found.withColumn(
        "proposal",
        F.format_string(
            ORDER_TEXT,
            bad,
            F.when(F.coalesce("column", F.lit("")) == "", WHOLE_TABLE).otherwise(F.col("column")),
            "scan",
            "dimension",
        ),
    )


def gate(assets: DataFrame, results: DataFrame) -> DataFrame:
    """Per asset: may it be answered from, and which caveats apply.

    ``assets`` has ``asset`` and ``scan``. A failed blocking rule withholds the asset; a
    failed warn rule only adds a caveat.
    """
    failed = ~F.coalesce(F.col("passed"), F.lit(True))
    blocking = failed & (F.col("severity") == "blocking")
    caveat = F.when(failed & (F.col("severity") != "blocking"), F.concat_ws(" on ", "dimension", "column"))
    return (
        assets.join(results.select("scan", "severity", "dimension", "column", "passed"), "scan", "left")
        .groupBy("asset")
        .agg(
            (~F.coalesce(F.bool_or(blocking), F.lit(False))).alias("answerable"),
            F.array_sort(F.collect_set(caveat)).alias("caveats"),
        )
    )


# ---- profile ----


def profile(df: DataFrame, columns: Sequence[str], top: int = 5) -> DataFrame:
    """Exact profile per column: rows, nulls, distinct values, min, max and the top values.

    Every (column, value) pair is counted once, combining inside each map task first, so
    a value filling the column costs one row per task.
    """
    cells = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
        ).alias("c")
    ).select("c.column", "c.value")
    counted = cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    summary = counted.groupBy("column").agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
        F.count("value").alias("distinct_values"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
    )
    common = top_n_per_key(
        counted.where(F.col("value").isNotNull()), ["column"], [F.desc("n"), F.asc("value")], top
    )
    listed = common.groupBy("column").agg(
        F.array_sort(F.collect_list(F.struct("rn", "value", "n"))).alias("_top")
    )
    return (
        summary.join(listed, "column", "left")
        .withColumn("null_ratio", F.try_divide(F.col("nulls").cast("double"), F.col("rows").cast("double")))
        .withColumn(
            "distinct_ratio", F.try_divide(F.col("distinct_values").cast("double"), F.col("rows").cast("double"))
        )
        .withColumn(
            "top_values",
            F.array_join(F.transform("_top", lambda t: F.concat_ws("=", t["value"], t["n"].cast("string"))), "; "),
        )
        .drop("_top")
    )


def quick_profile(df: DataFrame, columns: Sequence[str], top: int = 5) -> DataFrame:
    """Approximate profile of all columns in one pass without shuffling values."""
    aggregates = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(columns):
        text = F.col(c).cast("string")
        aggregates += [
            F.count_if(F.col(c).isNull()).alias(f"_nulls{i}"),
            F.approx_count_distinct(text).alias(f"_distinct{i}"),
            F.min(text).alias(f"_min{i}"),
            F.max(text).alias(f"_max{i}"),
            F.expr(f"approx_top_k(CAST({c} AS STRING), {int(top)})").alias(f"_top{i}"),
        ]
    row = df.agg(*aggregates)
    return row.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column"),
                        F.col("_rows").alias("rows"),
                        F.col(f"_nulls{i}").alias("nulls"),
                        F.col(f"_distinct{i}").alias("distinct_values"),
                        F.col(f"_min{i}").alias("min_value"),
                        F.col(f"_max{i}").alias("max_value"),
                        F.transform(f"_top{i}", lambda t: t["item"]).alias("top_values"),
                    )
                    for i, c in enumerate(columns)
                ]
            )
        )
    )


# ---- contracts ----

_FAMILIES = {
    "STRING": (T.StringType,),
    "NUMERIC": (T.DecimalType,),
    "INT64": (T.LongType, T.IntegerType, T.ShortType, T.ByteType),
    "FLOAT64": (T.DoubleType, T.FloatType),
    "BOOL": (T.BooleanType,),
    "TIMESTAMP": (T.TimestampType, T.TimestampNTZType),
    "DATE": (T.DateType,),
    "ARRAY": (T.ArrayType,),
}


def contract_conformance(df: DataFrame, contract: str, columns: Sequence[tuple[str, str, bool]]) -> DataFrame:
    """One row per declared column: present, of the declared type, and without nulls if required."""
    actual = {f.name: f.dataType for f in df.schema.fields}
    present = [name for name, _, _ in columns if name in actual]
    row = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.col(name).isNull()).alias(f"_null_{name}") for name in present],
    )
    results = []
    for name, family, required in columns:
        here = name in actual
        typed = here and isinstance(actual[name], _FAMILIES[family])
        nulls = F.col(f"_null_{name}") if here else F.col("_rows")
        results.append(
            F.struct(
                F.lit(contract).alias("contract"),
                F.lit(name).alias("column"),
                F.lit(family).alias("declared_type"),
                F.lit(here).alias("present"),
                F.lit(typed).alias("type_matches"),
                nulls.alias("nulls"),
                (F.lit(here and typed) & ((nulls == 0) if required else F.lit(True))).alias("conforms"),
            )
        )
    return row.select(F.inline(F.array(*results)))


# ---- recertification ----

# ---- fixed values: days between recertifications by risk tier ----
RECERTIFY_DAYS: Mapping[str, int] = {"HIGH": 90, "MEDIUM": 180, "LOW": 365}
WARN_DAYS = 14


def recertification(registry: DataFrame, today: date) -> DataFrame:
    """Due date of every agent's recertification; overdue fails, due within 14 days warns."""
    days = F.create_map(*[F.lit(x) for pair in RECERTIFY_DAYS.items() for x in pair])
    due = F.date_add(F.col("last_recertified"), F.element_at(days, F.col("risk_tier")))
    left = F.datediff(F.col("recert_due"), F.lit(today))
    return (
        registry.withColumn("recert_due", due)
        .withColumn("days_left", left)
        .withColumn(
            "finding",
            F.when(F.col("days_left") < 0, "fail").when(F.col("days_left") <= WARN_DAYS, "warn").otherwise("ok"),
        )
    )
