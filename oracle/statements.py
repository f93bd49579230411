"""DuckDB statements the reports must equal.

``t_name`` is a banking table, ``v_name`` a view of this module; both become CTEs. The
views state the semantics in plain SQL, without the pre-aggregation the Spark jobs use.
"""

from __future__ import annotations

import re

from ledgerlake.catalog import PRICES, REPORT_SECRET, SILVER_RULES
from ledgerlake.functions import pii
from ledgerlake.functions.text import NUMBER_PATTERN, TOKEN_PATTERN
from ledgerlake.operators import intent
from ledgerlake.schemas import RELATIONSHIPS
from ledgerlake.sources import banking_sql

def _txt(column: str, name: str | None = None) -> str:
    return f"CAST({column} AS VARCHAR) AS {name or column.split('.')[-1]}"


def _dbl(expression: str, name: str) -> str:
    return f"CAST({expression} AS DOUBLE) AS {name}"


def _int(expression: str, name: str) -> str:
    return f"CAST({expression} AS BIGINT) AS {name}"


# ---- message validation ----

_REQUIRED = ("transaction_id", "idempotency_key", "account_id", "txn_type", "amount", "currency", "status", "event_time")

_CHECKED = f"""
  SELECT *,
    CASE
      WHEN NOT sound THEN 'unparseable payload'
      WHEN json_type(doc) <> 'OBJECT' THEN 'payload is not a JSON object'
      WHEN len(absent) > 0 THEN 'missing required fields: [''' || array_to_string(absent, ''', ''') || ''']'
      WHEN txn_type NOT IN ('DEPOSIT', 'WITHDRAWAL', 'TRANSFER', 'FEE') THEN 'invalid txn_type: ' || txn_type
      WHEN status NOT IN ('POSTED', 'PENDING', 'REJECTED') THEN 'invalid status: ' || status
      WHEN NOT regexp_full_match(amount, '[0-9]+(\\.[0-9]{{1,2}})?') THEN 'invalid amount format: ' || amount
      WHEN NOT regexp_full_match(currency, '[A-Z]{{3}}') THEN 'invalid currency: ' || currency
      WHEN TRY_CAST(replace(replace(event_time, 'Z', ''), 'T', ' ') AS TIMESTAMP) IS NULL
        THEN 'invalid event_time: ' || event_time
    END AS error
  FROM (
    SELECT *,
      list_filter([{', '.join(f"CASE WHEN coalesce({f}, '') = '' THEN '{f}' END" for f in _REQUIRED)}],
                  lambda x: x IS NOT NULL) AS absent
    FROM (
      SELECT message_id, publish_time, data, sound, doc,
        {', '.join(f"json_extract_string(doc, '$.{f}') AS {f}" for f in (*_REQUIRED, "counterparty_account"))}
      FROM (SELECT *, json_valid(data) AS sound, CASE WHEN json_valid(data) THEN data ELSE '{{}}' END AS doc
            FROM t_transaction_event) AS readable
    ) AS fields
  ) AS listed
"""

_SILVER_COLUMNS = f"""
  message_id, transaction_id, idempotency_key, account_id, txn_type, {_dbl("amount", "amount")}, currency,
  counterparty_account, status,
  {_txt("CAST(replace(replace(event_time, 'Z', ''), 'T', ' ') AS TIMESTAMP)", "event_time")},
  {_txt("publish_time", "ingest_time")}, 'event-feed' AS source_system, '1.0.0' AS pipeline_version
"""

# ---- personal data ----


def _q(text: str) -> str:
    return text.replace("'", "''")


_LUHN = """(list_sum(list_transform(
    list_reverse(list_filter(string_split(regexp_replace({m}, '[^0-9]', '', 'g'), ''), lambda d: d <> '')),
    lambda d, i: CASE WHEN i % 2 = 1 THEN CAST(d AS INT)
                      ELSE (CAST(d AS INT) * 2) % 10 + (CAST(d AS INT) * 2) // 10 END)) % 10 = 0)"""


def _found(kind: str, pattern: str) -> str:
    return f"SELECT doc_id, '{kind}' AS info_type, unnest(regexp_extract_all(content, '{_q(pattern)}')) AS value FROM t_kb_raw"


def _replaced(text: str, pattern: str, value: str) -> str:
    """Text with each match m replaced by the SQL expression ``value``."""
    parts = f"string_split_regex({text}, '{_q(pattern)}')"
    hits = f"list_transform(regexp_extract_all({text}, '{_q(pattern)}'), lambda m: {value})"
    return (
        f"array_to_string(list_transform(list_zip({parts}, {hits}), lambda z: coalesce(z[1], '') || coalesce(z[2], '')), '')"
    )


_HIDDEN = (
    f"CASE WHEN contains(m, '@') OR regexp_full_match(m, '{_q(pii.PHONE)}') THEN repeat('#', length(m)) "
    f"WHEN regexp_full_match(m, '{_q(pii.CARD)}') AND NOT {_LUHN.format(m='m')} THEN m "
    f"ELSE '{pii.TOKEN_LABEL}(' || sha256('{REPORT_SECRET}' || m) || ')' END"
)
_DEIDENTIFIED = f"SELECT doc_id, content AS original, {_replaced('content', pii.ANY, _HIDDEN)} AS content FROM t_kb_raw"

# ---- loans ----

_SCORED = """
  SELECT *, cs_points + dti_points + od_points + size_points AS risk_score FROM (
    SELECT *,
      CASE WHEN credit_score >= 760 THEN 0 WHEN credit_score >= 700 THEN 10 WHEN credit_score >= 640 THEN 22 ELSE 40 END AS cs_points,
      CASE WHEN credit_score >= 760 THEN 'excellent credit (' WHEN credit_score >= 700 THEN 'good credit ('
           WHEN credit_score >= 640 THEN 'fair credit (' ELSE 'poor credit (' END || credit_score || ')' AS cs_note,
      CASE WHEN dti_ratio <= 0.28::DOUBLE THEN 0 WHEN dti_ratio <= 0.43::DOUBLE THEN 15 ELSE 30 END AS dti_points,
      CASE WHEN dti_ratio <= 0.28::DOUBLE THEN 'healthy DTI (' WHEN dti_ratio <= 0.43::DOUBLE THEN 'elevated DTI ('
           ELSE 'high DTI (' END || dti_ratio || ')' AS dti_note,
      CASE WHEN events = 0 THEN 0 WHEN events <= 2 THEN 10 ELSE 20 END AS od_points,
      CASE WHEN events = 0 THEN 'no overdraft history' WHEN events <= 2 THEN events || ' overdraft event(s)'
           ELSE 'frequent overdrafts (' || events || ')' END AS od_note,
      CASE WHEN amount > 50000 THEN 10 WHEN amount > 20000 THEN 5 ELSE 0 END AS size_points,
      CASE WHEN amount > 50000 THEN 'large loan amount' WHEN amount > 20000 THEN 'moderate loan amount'
           ELSE 'modest loan amount' END AS size_note
    FROM (
      SELECT l.loan_id, l.amount, p.credit_score, CAST(coalesce({events}, 0) AS BIGINT) AS events,
        round((p.existing_debt / 12.0::DOUBLE + CAST(l.amount AS DOUBLE) / greatest(l.term_months, 1))
              / greatest(p.annual_income / 12.0::DOUBLE, 1.0::DOUBLE), 3) AS dti_ratio
      FROM t_loan_request l JOIN t_credit_profile p ON l.loan_id = p.loan_id
      LEFT JOIN {source} o ON l.account_id = o.account_id
    ) AS inputs
  ) AS pointed
"""
_RECOMMEND = "CASE WHEN risk_score <= 35 THEN 'APPROVE' WHEN risk_score >= 65 THEN 'DECLINE' ELSE 'REVIEW' END"
_IMPACT = "CASE WHEN {p} > 0 THEN 'increases risk' ELSE 'favorable' END"


def _reason(place: int, points: str, code: str, note: str) -> str:
    return f"CASE WHEN {points} > 0 THEN {{'k': -{points}, 'i': {place}, 't': '{code}: ' || {note}}} END"


_PRINCIPAL = (
    "array_to_string(list_transform(list_sort(list_filter(["
    + ", ".join(
        (
            _reason(0, "cs_points", "CREDIT", "cs_note"),
            _reason(1, "dti_points", "DTI", "dti_note"),
            _reason(2, "od_points", "OVERDRAFT", "od_note"),
            _reason(3, "size_points", "LOAN_SIZE", "size_note"),
        )
    )
    + "], lambda x: x IS NOT NULL)), lambda x: x.t), '|')"
)


def _factor(code: str, label: str, value: str, points: str, most: int) -> str:
    return f"'{code}:{label}:' || {value} || ':' || {points} || ':{most}:' || {_IMPACT.format(p=points)}"


_FACTORS = " || '|' || ".join(
    (
        _factor("CREDIT", "Credit score", "credit_score", "cs_points", 40),
        _factor("DTI", "Debt-to-income", "dti_ratio", "dti_points", 30),
        _factor("OVERDRAFT", "Overdraft history", "events", "od_points", 20),
        _factor("LOAN_SIZE", "Loan amount", "CAST(amount AS DOUBLE)", "size_points", 10),
    )
)

# ---- quality ----


def _rule_row(i: int, rule) -> str:
    where = rule.where or "TRUE"
    if rule.kind == "unique":
        evaluated, passed = "count(*)", f"count(*) FILTER (WHERE copies_of_{rule.column} = 1)"
    else:
        evaluated = f"count(*) FILTER (WHERE {where})"
        passed = f"count(*) FILTER (WHERE ({where}) AND coalesce({rule.condition()}, FALSE))"
    return f"""
      SELECT 'silver-txn-quality' AS scan, {_int(str(i), 'rule')}, '{rule.dimension}' AS dimension,
             '{rule.column}' AS "column", '{rule.severity}' AS severity, {_int(evaluated, 'evaluated')},
             {_int(passed, 'passed_count')}, '{_q(rule.failing_query("silver.transaction"))}' AS failing_rows_query,
             {evaluated} = {passed} AS passed
      FROM v_silver_all"""


def _integrity(child: str, key: str, parent: str, parent_key: str, name: str) -> str:
    return f"""
      SELECT '{name}' AS scan, 'INTEGRITY' AS dimension, '{key}' AS "column", 'blocking' AS severity,
             {_int("count(*)", "evaluated")},
             {_int(f"count(*) FILTER (WHERE {key} IN (SELECT {parent_key} FROM {parent}))", "passed_count")},
             count(*) = count(*) FILTER (WHERE {key} IN (SELECT {parent_key} FROM {parent})) AS passed
      FROM {child}"""


def _failed_marks() -> str:
    marks = []
    for rule in [r for r in SILVER_RULES if r.kind != "unique"] + [r for r in SILVER_RULES if r.kind == "unique"]:
        if rule.kind == "unique":
            failed = f"copies_of_{rule.column} > 1"
        else:
            failed = f"({rule.where or 'TRUE'}) AND NOT coalesce({rule.condition()}, FALSE)"
        marks.append(f"CASE WHEN {failed} THEN '{rule.column}:{rule.kind}' END")
    return f"list_filter([{', '.join(marks)}], lambda x: x IS NOT NULL)"


def _profile(column: str) -> str:
    return f"""
      SELECT '{column}' AS "column", {_int("count(*)", "rows")}, {_int(f"count(*) - count({column})", "nulls")},
             {_int(f"count(DISTINCT {column})", "distinct_values")},
             min(CAST({column} AS VARCHAR)) AS min_value, max(CAST({column} AS VARCHAR)) AS max_value,
             round((count(*) - count({column}))::DOUBLE / count(*), 6) AS null_ratio,
             round(count(DISTINCT {column})::DOUBLE / count(*), 6) AS distinct_ratio,
             (SELECT string_agg(v || '=' || n, '; ' ORDER BY n DESC, v) FROM (
                SELECT CAST({column} AS VARCHAR) AS v, count(*) AS n FROM t_transaction
                WHERE {column} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 5)) AS top_values
      FROM t_transaction"""


def _contract(contract: str, source: str, rows: list[tuple]) -> str:
    """rows: (column, type, present, typed, required)."""
    out = []
    for column, family, present, typed, required in rows:
        nulls = f"count(*) - count({column})" if present else "count(*)"
        conforms = "FALSE" if not (present and typed) else (f"({nulls}) = 0" if required else "TRUE")
        out.append(
            f"""SELECT '{contract}' AS contract, '{column}' AS "column", '{family}' AS declared_type,
                {str(present).upper()} AS present, {str(typed).upper()} AS type_matches,
                {_int(nulls, "nulls")}, {conforms} AS conforms FROM {source}"""
        )
    return " UNION ALL ".join(out)


def _contracts() -> str:
    from ledgerlake.schemas import CONTRACT_COLUMNS

    sources = {
        "deposit-transactions": "t_transaction",
        "customer-master": "t_bank_customer",
        "overdraft-history": "v_overdraft_history",
        "loan-master": "v_loan_status",
        "bank-knowledge-base": "(SELECT r.*, e.embedding FROM t_kb_raw r LEFT JOIN t_kb_vector e ON r.doc_id = e.doc_id)",
    }
    return " UNION ALL ".join(
        _contract(name, sources[name], [(c, f, True, True, req) for c, f, req in columns])
        for name, columns in CONTRACT_COLUMNS.items()
    )


def _contract_quality() -> str:
    """Every rule stated here once more, as (contract, rule, dimension, column, severity, rows, sound)."""
    known = "{c} IN ('APPROVE', 'DECLINE', 'REVIEW')"
    rows = [
        ("deposit-transactions", 0, "VALIDITY", "amount", "warn", "TRUE", "amount IS NOT NULL"),
        ("deposit-transactions", 1, "VALIDITY", "txn_type", "warn", "TRUE", "txn_type IN ('DEPOSIT', 'FEE', 'TRANSFER', 'WITHDRAWAL')"),
        ("deposit-transactions", 2, "UNIQUENESS", "idempotency_key", "warn", "TRUE", None),
        ("deposit-transactions", 3, "UNIQUENESS", "transaction_id", "blocking", "TRUE", None),
        ("deposit-transactions", 4, "COMPLETENESS", "amount", "warn", "status = 'POSTED'", "amount IS NOT NULL"),
        ("customer-master", 0, "UNIQUENESS", "customer_id", "warn", "TRUE", None),
        ("customer-master", 1, "VALIDITY", "customer_natural_key", "warn", "TRUE", "customer_natural_key IS NOT NULL"),
        ("customer-master", 2, "COMPLETENESS", "segment", "warn", "TRUE", "segment IS NOT NULL"),
        ("loan-master", 0, "UNIQUENESS", "loan_id", "warn", "TRUE", None),
        ("loan-master", 1, "VALIDITY", "risk_score", "warn", "risk_score IS NOT NULL", "risk_score BETWEEN 0 AND 1000"),
        ("loan-master", 2, "VALIDITY", "recommendation", "warn", "recommendation IS NOT NULL", known.format(c="recommendation")),
        ("loan-master", 3, "VALIDITY", "final_decision", "warn", "final_decision IS NOT NULL", known.format(c="final_decision")),
        ("overdraft-history", 0, "UNIQUENESS", "account_id", "warn", "TRUE", None),
        ("overdraft-history", 1, "VALIDITY", "overdraft_events", "warn", "TRUE", "overdraft_events IS NOT NULL"),
        ("bank-knowledge-base", 0, "UNIQUENESS", "doc_id", "warn", "TRUE", None),
        ("bank-knowledge-base", 1, "VALIDITY", "content", "warn", "TRUE", "content IS NOT NULL"),
    ]
    tables = {
        "deposit-transactions": "t_transaction", "customer-master": "t_bank_customer", "loan-master": "v_loan_status",
        "overdraft-history": "v_overdraft_history", "bank-knowledge-base": "t_kb_raw",
    }
    out = []
    for contract, number, dimension, column, severity, where, sound in rows:
        table = tables[contract]
        if sound is None:
            table = f"(SELECT *, count(*) OVER (PARTITION BY {column}) AS copies FROM {table})"
            sound = "copies = 1"
        evaluated, passed = f"count(*) FILTER (WHERE {where})", f"count(*) FILTER (WHERE ({where}) AND coalesce({sound}, FALSE))"
        out.append(f"""
          SELECT '{contract}' AS scan, {_int(str(number), 'rule')}, '{dimension}' AS dimension, '{column}' AS "column",
                 '{severity}' AS severity, {_int(evaluated, 'evaluated')}, {_int(passed, 'passed_count')}, {evaluated} = {passed} AS passed
          FROM {table}""")
    return " UNION ALL ".join(out)


# ---- retrieval ----

_TOKENS = f"list_filter(regexp_extract_all(lower({{text}}), '{_q(TOKEN_PATTERN)}'), lambda t: length(t) > 1)"

_BM25 = """
  SELECT query_id, doc_id,
         CAST(sum(CAST(round(ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE)
             / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) * 1e9::DOUBLE) AS BIGINT)) AS DOUBLE) / 1e9::DOUBLE AS score
  FROM v_query_token q
  JOIN (SELECT doc_id, tok, dl, count(*) AS tf FROM (
          SELECT doc_id, len(toks) AS dl, unnest(toks) AS tok FROM v_doc_tokens)
        WHERE tok IN (SELECT tok FROM v_query_token) GROUP BY ALL) t USING (tok)
  JOIN (SELECT tok, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(toks) AS tok FROM v_doc_tokens)
        GROUP BY tok) f USING (tok),
  (SELECT count(*) AS n_docs, avg(len(toks)) AS avgdl FROM v_doc_tokens) s
  GROUP BY query_id, doc_id
"""
_KNN = """
  SELECT q.query_id, c.doc_id,
         round(1.0::DOUBLE - list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 10) AS distance
  FROM t_kb_query_vector q, t_kb_vector c
"""


def _fused(dense: str, sparse: str) -> str:
    return f"""
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, doc_id) AS rnk FROM (
        SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + rnk)) AS rrf,
               bool_or(src = 'dense') AS in_dense, bool_or(src = 'sparse') AS in_sparse
        FROM (SELECT query_id, doc_id, rnk, 'dense' AS src FROM {dense}
              UNION ALL SELECT query_id, doc_id, rnk, 'sparse' FROM {sparse}) GROUP BY query_id, doc_id)
      QUALIFY rnk <= 8"""


def _retriever() -> str:
    return "CASE WHEN in_dense AND in_sparse THEN 'hybrid' WHEN in_dense THEN 'dense' ELSE 'sparse' END AS retriever"


# ---- chunking ----

_WS = r"(?s)^[\t\n\x0B\f\r ]+|[\t\n\x0B\f\r ]+$"


def _strip(text: str) -> str:
    return f"regexp_replace({text}, '{_WS}', '', 'g')"


_HEADING = r"(?m)^#{2,3}\s+.+$"
_BODY = f"""
  SELECT path, {_strip(
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(markdown,"
    r" '\r\n?', chr(10), 'g'),"
    r" '(?s)\A---\n.*?\n---\n', ''),"
    r" '(?s)```.*?```', '', 'g'),"
    r" '(?m)^[ \t\f]*\|[^\n]*(?:\n|\z)', '', 'g'),"
    r" '(?s)<!--.*?-->', '', 'g'),"
    r" '\n{3,}', chr(10) || chr(10), 'g')")} AS body
  FROM t_page_markdown
"""
_SECTIONS = f"""
  SELECT path, title, i,
         CASE WHEN i > 1 THEN {_strip(r"regexp_replace(hits[i - 1], '^#{2,3}\s+', '')")} END AS heading,
         {_strip("parts[i]")} AS text
  FROM (
    SELECT path, title, parts, hits, unnest(range(1, len(parts) + 1)) AS i FROM (
      SELECT path, string_split_regex(body, '{_HEADING}') AS parts, regexp_extract_all(body, '{_HEADING}') AS hits,
             CASE WHEN h1 <> '' THEN h1
                  ELSE upper(left(stem, 1)) || substr(stem, 2) END AS title
      FROM (SELECT *, {_strip(r"regexp_extract(body, '(?m)^#\s+(.+)$', 1)")} AS h1,
                   replace(regexp_extract(path, '([^/]*)\\.md$', 1), '-', ' ') AS stem FROM v_body)))
"""
_PIECES = f"""
  SELECT path, title, i, heading, unnest(list_transform(
           CASE WHEN heading IS NULL OR length(text) <= 4000 THEN [text]
             ELSE list_filter(string_split(list_reduce(string_split(text, chr(10) || chr(10)),
               lambda acc, p: CASE
                 WHEN split_part(acc, chr(30), -1) = '' THEN acc || p
                 WHEN length(split_part(acc, chr(30), -1)) + length(p) + 2 > 4000 THEN acc || chr(30) || p
                 ELSE acc || chr(10) || chr(10) || p END, ''), chr(30)), lambda x: TRUE) END,
           lambda x: {_strip('x')})) AS piece,
         generate_subscripts(CASE WHEN heading IS NULL OR length(text) <= 4000 THEN [text]
             ELSE string_split(list_reduce(string_split(text, chr(10) || chr(10)),
               lambda acc, p: CASE
                 WHEN split_part(acc, chr(30), -1) = '' THEN acc || p
                 WHEN length(split_part(acc, chr(30), -1)) + length(p) + 2 > 4000 THEN acc || chr(30) || p
                 ELSE acc || chr(10) || chr(10) || p END, ''), chr(30)) END, 1) AS j
  FROM v_sections WHERE length(text) >= 120
"""

# ---- intents ----


def _hits(text: str, words) -> str:
    patterns = ["(^|[^a-z0-9_])" + re.escape(w.format(platform="ledgerlake")).replace("\\ ", " ") for w in words]
    return " + ".join(f"CAST(regexp_matches(lower({text}), '{_q(p)}') AS BIGINT)" for p in patterns)


def _intent_sql(key: str, source: str, text: str) -> str:
    columns = ", ".join(f"({_hits(text, words)}) * {w} AS {name}_score" for name, words, w in intent.INTENTS)
    best = "greatest(" + ", ".join(f"{n}_score" for n, _, _ in intent.INTENTS) + ")"
    chosen = " ".join(f"WHEN {n}_score = {best} THEN '{n}'" for n, _, _ in intent.INTENTS)
    return f"""SELECT *, CASE WHEN {best} = 0 THEN 'analytics' {chosen} END AS intent
               FROM (SELECT {key}, {columns} FROM (SELECT {key}, coalesce({text}, '') AS {text} FROM {source}))"""


# ---- evaluation ----

_EVENT_DAY = "TIMESTAMP '2024-01-31 00:00:00'"
_LOG_DAY = "TIMESTAMP '2024-01-09 00:00:00'"
_TURNS = """
  SELECT conversation_id, persona, channel,
    CASE WHEN tool IS NULL THEN refused
         WHEN wanted AND NOT on_topic THEN FALSE ELSE NOT regexp_matches(a, 'can''t|cannot|unable') END AS tool_ok,
    CASE WHEN tool IS NULL THEN refused ELSE on_topic END AS grounded,
    CASE WHEN tool IS NULL THEN NOT refused ELSE wanted AND NOT on_topic END AS hallucinated
  FROM (SELECT *, trim(a) <> '' AND contains(a, acct) AS on_topic,
               regexp_matches(a, 'can''t|cannot|unable|not able|don''t have') AS refused FROM (
    SELECT conversation_id, persona, channel, lower(coalesce(answer, '')) AS a,
           CASE WHEN channel <> 'kb' THEN channel END AS tool, persona = 'customer' AS wanted,
           lower(coalesce(account_id, '')) AS acct
    FROM t_conversation_log))
"""
_METRICS = """count(*) AS n, round(avg(grounded::INT), 3) AS grounding_accuracy,
              round(avg(tool_ok::INT), 3) AS tool_utilization, round(avg(hallucinated::INT), 3) AS hallucination_rate"""
_ECONOMICS = """
  SELECT workload_class, model, CASE WHEN on_behalf_of IS NULL THEN 'autonomous' ELSE 'user-initiated' END AS initiated_by,
         c.session_id, input_tokens, output_tokens, overall
  FROM (SELECT session_id, agent_id, workload_class, on_behalf_of, tier, model,
               sum(coalesce(input_tokens, 0)) AS input_tokens, sum(coalesce(output_tokens, 0)) AS output_tokens
        FROM t_gateway_request
        WHERE outcome = 'ok' AND surface = 'complete' AND session_id IS NOT NULL
          AND ts >= TIMESTAMP '2024-01-02 00:00:00' GROUP BY ALL) c
  LEFT JOIN (SELECT conversation_id, overall FROM v_scores WHERE scored_at >= TIMESTAMP '2024-01-02 00:00:00') q
    ON q.conversation_id = c.session_id
"""
_ECONOMICS_COLUMNS = f"""
  {_int("count(*)", "tasks")}, {_int("count(*) FILTER (WHERE overall IS NULL)", "unjudged")},
  {_int("count(*) FILTER (WHERE overall >= 0.7::DOUBLE)", "successful")},
  {_int("sum(input_tokens)", "input_tokens")}, {_int("sum(output_tokens)", "output_tokens")},
  round(avg(overall), 3) AS avg_quality
"""


def _regression(metric: str, tolerance: str, worse: str) -> str:
    return f"""
      SELECT channel, '{metric}' AS metric, b.{metric} AS baseline, a.{metric} AS "current",
             round(a.{metric} - b.{metric}, 6) AS delta,
             printf('{metric}: %.3f -> %.3f (%+.3f, tolerance {tolerance})', b.{metric}, a.{metric}, a.{metric} - b.{metric}) AS message
      FROM (SELECT * FROM v_channel_metrics WHERE persona = 'analyst') a
      JOIN (SELECT * FROM v_channel_metrics WHERE persona = 'customer') b USING (channel)
      WHERE {worse.format(d=f"(a.{metric} - b.{metric})")}"""


VIEWS: dict[str, str] = {
    # Signs of the two money rules; a type without a row counts as nothing.
    "balance_sign": "SELECT * FROM (VALUES ('DEPOSIT', 1), ('WITHDRAWAL', -1), ('FEE', -1), ('TRANSFER', -1)) AS s(txn_type, sign)",
    "net_sign": "SELECT * FROM (VALUES ('DEPOSIT', 1), ('WITHDRAWAL', -1), ('FEE', -1)) AS s(txn_type, sign)",
    "posted_delta": """
        SELECT account_id, event_time, coalesce(sign, 0) * amount AS delta
        FROM t_transaction LEFT JOIN v_balance_sign USING (txn_type) WHERE status = 'POSTED'""",
    "net_delta": """
        SELECT transaction_id, account_id, txn_type, status, event_time, amount, coalesce(sign, 0) * amount AS delta
        FROM t_transaction LEFT JOIN v_net_sign USING (txn_type)""",
    "account_balance": """
        SELECT account_id, customer_id, currency,
               coalesce((SELECT sum(delta) FROM v_posted_delta d WHERE d.account_id = acc.account_id), 0) AS balance,
               (SELECT max(event_time) FROM v_posted_delta d WHERE d.account_id = acc.account_id) AS last_activity_at
        FROM t_account acc""",
    "account_summary": """
        SELECT account_id, customer_id, account_type, currency, status,
               coalesce(by_type['DEPOSIT'], 0) AS deposit_count, coalesce(by_type['WITHDRAWAL'], 0) AS withdrawal_count,
               coalesce(by_type['FEE'], 0) AS fee_count, coalesce(net, 0) AS net_balance, last_activity_at
        FROM t_account LEFT JOIN (
          SELECT account_id, histogram(txn_type) AS by_type, sum(delta) AS net, max(event_time) AS last_activity_at
          FROM v_net_delta GROUP BY account_id) USING (account_id)""",
    "running": """
        SELECT account_id, event_time, sum(delta) OVER (PARTITION BY account_id ORDER BY event_time) AS running
        FROM v_posted_delta""",
    "overdraft_history": """
        SELECT account_id, sum((running < 0)::INT)::BIGINT AS overdraft_events, min(running) AS lowest_balance,
               avg((running < 0)::INT) AS overdraft_ratio
        FROM v_running GROUP BY account_id""",
    "customer_360": """
        SELECT customer_id, segment, created_at AS customer_since,
               (SELECT count(*) FROM t_account a WHERE a.customer_id = cu.customer_id) AS account_count,
               (SELECT count(*) FROM v_owned_delta d WHERE d.customer_id = cu.customer_id) AS transaction_count,
               coalesce((SELECT sum(delta) FROM v_owned_delta d WHERE d.customer_id = cu.customer_id), 0) AS net_transaction_amount,
               coalesce((SELECT sum(overdraft_events) FROM v_owned_overdraft o WHERE o.customer_id = cu.customer_id), 0) AS overdraft_events,
               (SELECT min(lowest_balance) FROM v_owned_overdraft o WHERE o.customer_id = cu.customer_id) AS lowest_balance,
               (SELECT count(*) FROM v_owned_loan l WHERE l.customer_id = cu.customer_id) AS loan_count,
               coalesce((SELECT sum(amount) FROM v_owned_loan l WHERE l.customer_id = cu.customer_id), 0) AS total_loan_amount
        FROM t_bank_customer cu""",
    "owned_delta": "SELECT customer_id, delta FROM v_net_delta JOIN t_account USING (account_id)",
    "owned_overdraft": "SELECT customer_id, overdraft_events, lowest_balance FROM v_overdraft_history JOIN t_account USING (account_id)",
    "owned_loan": "SELECT customer_id, l.amount FROM t_loan_request l JOIN t_account USING (account_id)",
    "bridge": """
        SELECT n.*, customer_id, segment FROM v_net_delta n
        JOIN (SELECT account_id, customer_id FROM t_account) USING (account_id)
        JOIN (SELECT customer_id, segment FROM t_bank_customer) USING (customer_id)""",
    "checked": _CHECKED,
    "silver": f"""
        SELECT {_SILVER_COLUMNS} FROM v_checked WHERE error IS NULL
        QUALIFY row_number() OVER (PARTITION BY idempotency_key ORDER BY publish_time, message_id) = 1""",
    "checked_silver": "SELECT message_id, publish_time, idempotency_key FROM v_checked WHERE error IS NULL",
    "silver_all": f"""
        SELECT *, count(*) OVER (PARTITION BY idempotency_key) AS copies_of_idempotency_key
        FROM (SELECT {_SILVER_COLUMNS} FROM v_checked WHERE error IS NULL)""",
    "deidentified": _DEIDENTIFIED,
    "last_risk": """
        SELECT loan_id, unnest(arg_max(struct_pack(risk_score, recommendation, reasons, factors), version))
        FROM t_risk_assessment GROUP BY loan_id""",
    "last_decision": """
        SELECT loan_id, unnest(arg_max(struct_pack(final_decision := decision, counteroffer_amount, approver, decided_at), version))
        FROM t_approval_decision GROUP BY loan_id""",
    "loan_status": """
        SELECT * EXCLUDE (account_id) FROM t_loan_request
        LEFT JOIN v_last_risk USING (loan_id) LEFT JOIN v_last_decision USING (loan_id)""",
    "scored": _SCORED.format(events="o.overdraft_events", source="v_overdraft_history"),
    "scored_proxy": _SCORED.format(
        events="CASE WHEN o.net_balance < 0 THEN o.withdrawal_count ELSE 0 END", source="v_account_summary"
    ),
    "scan": " UNION ALL ".join(_rule_row(i, r) for i, r in enumerate(SILVER_RULES)),
    "integrity": " UNION ALL ".join(
        (
            _integrity("t_transaction", "account_id", "t_account", "account_id", "txn-account"),
            _integrity("t_account", "customer_id", "t_bank_customer", "customer_id", "account-customer"),
            _integrity("t_risk_assessment", "loan_id", "t_loan_request", "loan_id", "risk-loan"),
            _integrity("t_kb_raw", "doc_id", "t_kb_vector", "doc_id", "chunk-vector"),
        )
    ),
    "query_token": f"SELECT DISTINCT query_id, tok FROM (SELECT query_id, unnest({_TOKENS.format(text='query')}) AS tok FROM t_kb_query)",
    "doc_tokens": f"SELECT doc_id, {_TOKENS.format(text="concat_ws(' ', coalesce(title, ''), content)")} AS toks FROM t_kb_raw",
    "sparse": f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rnk
                  FROM ({_BM25}) QUALIFY rnk <= 8""",
    "dense": f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS rnk
                 FROM ({_KNN}) QUALIFY rnk <= 8""",
    "no_sparse": "SELECT query_id, doc_id, rnk FROM v_dense WHERE FALSE",
    "dense_chunk": f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS rnk
                       FROM ({_KNN}) WHERE doc_id IN (SELECT doc_id FROM t_kb_raw) QUALIFY rnk <= 8""",
    "fused": _fused("v_dense_chunk", "v_sparse"),
    "fused_dense": _fused("v_dense", "v_no_sparse"),
    "body": _BODY,
    "sections": _SECTIONS,
    "pieces": _PIECES,
    "transfers": """
        SELECT account_id AS src, counterparty_account AS dst, count(*) AS transfers, sum(amount) AS amount
        FROM t_transaction
        WHERE txn_type = 'TRANSFER' AND status = 'POSTED' AND coalesce(counterparty_account, '') <> '' GROUP BY 1, 2""",
    "hop1": "SELECT src, count(*) AS n FROM v_transfers GROUP BY 1",
    "hop2": "SELECT e.src, sum(h.n) AS n FROM v_transfers e JOIN v_hop1 h ON e.dst = h.src GROUP BY 1",
    "hop3": "SELECT e.src, sum(h.n) AS n FROM v_transfers e JOIN v_hop2 h ON e.dst = h.src GROUP BY 1",
    "reach0": "SELECT DISTINCT account_id AS node, 0 AS hops FROM t_account WHERE account_type = 'SAVINGS'",
    "reach1": "SELECT node, hops FROM v_reach0 UNION SELECT e.dst, 1 FROM v_transfers e JOIN v_reach0 r ON e.src = r.node",
    "reach2": "SELECT node, hops FROM v_reach1 UNION SELECT e.dst, r.hops + 1 FROM v_transfers e JOIN v_reach1 r ON e.src = r.node",
    "reach3": "SELECT node, hops FROM v_reach2 UNION SELECT e.dst, r.hops + 1 FROM v_transfers e JOIN v_reach2 r ON e.src = r.node",
    "scores": """
        SELECT * REPLACE (coalesce(safety, 1.0) AS safety),
               round(list_sum(present) / len(present), 3) AS overall
        FROM (SELECT *, list_filter([round((groundedness - 1) / 4, 3), round((instruction_following - 1) / 4, 3),
                                     round((coherence - 1) / 4, 3), coalesce(safety, 1.0)], lambda x: x IS NOT NULL) AS present
              FROM t_judge_verdict)""",
    "turns": _TURNS,
    "channel_metrics": f"SELECT channel, persona, {_METRICS} FROM v_turns GROUP BY channel, persona",
    "economics": _ECONOMICS,
    "priced": f"""
        SELECT workload_class, model, initiated_by, {_ECONOMICS_COLUMNS},
               sum(input_tokens) / 1000000.0::DOUBLE * CASE model WHEN 'small-model' THEN {PRICES['small-model'][0]} ELSE {PRICES['_default'][0]} END
               + sum(output_tokens) / 1000000.0::DOUBLE * CASE model WHEN 'small-model' THEN {PRICES['small-model'][1]} ELSE {PRICES['_default'][1]} END AS cost
        FROM v_economics GROUP BY 1, 2, 3""",
    "priced_rows": """
        SELECT workload_class, model, initiated_by, tasks, unjudged, successful, input_tokens + output_tokens AS tokens, cost FROM v_priced
        UNION ALL
        SELECT 'TOTAL', NULL, NULL, sum(tasks), sum(unjudged), sum(successful), sum(input_tokens + output_tokens), sum(cost) FROM v_priced""",
}

_SCAN_COLUMNS = 'scan, "column", dimension, severity, passed'
_READ = f"transaction_id, txn_type, {_dbl('amount', 'amount')}, currency, status, {_txt('event_time')}"
_RATIO = """((evaluated - passed_count)::DOUBLE / evaluated)"""
_SHARE = f"printf('%.1f%%', {_RATIO} * 100)"

STATEMENTS: dict[str, str] = {
    "account_balance": f"SELECT account_id, customer_id, currency, {_dbl('balance', 'balance')}, {_txt('last_activity_at')} FROM v_account_balance",
    "account_summary": f"SELECT * REPLACE ({_dbl('net_balance', 'net_balance')}, {_txt('last_activity_at')}) FROM v_account_summary",
    "running_balance": f"""SELECT account_id, {_txt('event_time')}, {_int('count(*)', 'n')}, {_dbl('max(running)', 'running')}
                           FROM v_running GROUP BY account_id, v_running.event_time""",
    "overdraft_history": f"""SELECT account_id, overdraft_events, {_dbl('lowest_balance', 'lowest_balance')},
                             round(overdraft_ratio, 6) AS overdraft_ratio FROM v_overdraft_history""",
    "newest_per_account": f"""
        SELECT account_id, {_READ}, rn FROM (
          SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY event_time DESC, transaction_id) AS rn
          FROM t_transaction) WHERE rn <= 5""",
    "recent_activity": f"SELECT account_id, {_READ} FROM t_transaction WHERE t_transaction.event_time >= {_EVENT_DAY} - INTERVAL 7 DAY",
    "newest_of_account": f"""SELECT {_READ} FROM t_transaction WHERE account_id = (SELECT min(account_id) FROM t_transaction)
        ORDER BY t_transaction.event_time DESC, transaction_id LIMIT 50""",
    "most_recently_active": f"""SELECT account_id, {_txt('last_activity_at')} FROM (SELECT * FROM v_account_balance
        ORDER BY last_activity_at DESC NULLS LAST, account_id LIMIT 5)""",
    "balance_lookup": f"""SELECT account_id, currency, {_dbl('balance', 'balance')}, {_txt('last_activity_at')}
        FROM v_account_balance WHERE account_id IN (SELECT account_id FROM t_loan_request)""",
    "summary_lookup": f"""SELECT * REPLACE ({_dbl('net_balance', 'net_balance')}, {_txt('last_activity_at')})
        FROM v_account_summary WHERE account_id IN (SELECT account_id FROM t_loan_request)""",
    "txn_by_account": f"""
        SELECT account_id || '#' || lpad(CAST(9999999999 - CAST(floor(epoch(t.event_time)) AS BIGINT) AS VARCHAR), 10, '0')
               || '#' || transaction_id AS row_key, account_id, {_READ} FROM t_transaction t
        QUALIFY row_number() OVER (PARTITION BY row_key ORDER BY t.event_time DESC, transaction_id) = 1""",
    "balance_projection": f"""
        SELECT account_id AS row_key, {_dbl('balance', 'balance')}, currency,
               CAST(coalesce(last_activity_at, {_EVENT_DAY}) AS VARCHAR) AS as_of FROM v_account_balance""",
    "serving_retention": """
        SELECT transaction_id, account_id, CAST(CAST(event_time AS DATE) AS VARCHAR) AS event_date FROM t_transaction
        WHERE CAST(event_time AS DATE) >= DATE '2024-01-16'""",
    "bronze_retention": """
        SELECT message_id, CAST(CAST(publish_time AS DATE) AS VARCHAR) AS publish_date FROM t_transaction_event
        WHERE CAST(publish_time AS DATE) >= DATE '2024-01-17'""",
    "dead_letter_retention": """
        SELECT data AS payload, CAST(CAST(publish_time AS DATE) AS VARCHAR) AS failed_date FROM v_checked
        WHERE error IS NOT NULL AND CAST(publish_time AS DATE) >= DATE '2024-01-20'""",
    "customer_360": f"""
        SELECT customer_id, segment, {_txt('customer_since')}, {_int('account_count', 'account_count')},
               {_int('transaction_count', 'transaction_count')}, {_dbl('net_transaction_amount', 'net_transaction_amount')},
               {_int('overdraft_events', 'overdraft_events')}, {_dbl('lowest_balance', 'lowest_balance')},
               {_int('loan_count', 'loan_count')}, {_dbl('total_loan_amount', 'total_loan_amount')} FROM v_customer_360""",
    "net_amount_by_segment": f"""SELECT segment, {_dbl("sum(delta)", 'net_transaction_amount')}
        FROM v_bridge WHERE status = 'POSTED' GROUP BY segment""",
    "deposits_by_segment": f"""
        SELECT segment, {_dbl("coalesce(sum(amount) FILTER (WHERE txn_type = 'DEPOSIT'), 0)", 'total_deposits')},
               {_int('count(transaction_id)', 'txns')} FROM v_bridge GROUP BY segment""",
    "daily_volume": f"""SELECT CAST(CAST(event_time AS DATE) AS VARCHAR) AS day, txn_type, {_int('count(*)', 'txns')},
        {_dbl('sum(amount)', 'total')} FROM t_transaction GROUP BY 1, 2""",
    "monthly_fee_revenue": f"""SELECT CAST(CAST(date_trunc('month', event_time) AS DATE) AS VARCHAR) AS month,
        {_dbl('sum(amount)', 'fee_revenue')} FROM t_transaction WHERE txn_type = 'FEE' GROUP BY 1""",
    "new_customers_per_month": f"""SELECT CAST(CAST(date_trunc('month', created_at) AS DATE) AS VARCHAR) AS month,
        {_int('count(*)', 'new_customers')} FROM t_bank_customer GROUP BY 1""",
    "customers_by_segment": f"SELECT segment, {_int('count(*)', 'customers')} FROM t_bank_customer GROUP BY 1",
    "chunks_by_category": f"SELECT category, {_int('count(*)', 'chunks')} FROM t_kb_raw GROUP BY 1",
    "document_catalogue": f"SELECT doc_id, title, category, {_int('length(content)', 'chars')} FROM t_kb_raw",
    "overdraft_portfolio": f"""SELECT {_int('count(*)', 'accounts')}, {_int('sum(overdraft_events)', 'total_events')},
        round(avg(overdraft_ratio), 3) AS avg_ratio, {_dbl('min(lowest_balance)', 'worst_balance')} FROM v_overdraft_history""",
    "active_customers": f"""SELECT {_int('count(DISTINCT customer_id)', 'active_customers')} FROM v_bridge
        WHERE status = 'POSTED' AND event_time >= {_EVENT_DAY} - INTERVAL 90 DAY""",
    "most_active_accounts": f"""SELECT account_id, {_int('count(*)', 'txns')}, {_dbl('sum(amount)', 'total_amount')}
        FROM t_transaction GROUP BY 1 ORDER BY txns DESC, account_id LIMIT 20""",
    "highest_risk_accounts": f"""SELECT account_id, overdraft_events, {_dbl('lowest_balance', 'lowest_balance')},
        round(overdraft_ratio, 6) AS overdraft_ratio FROM (SELECT * FROM v_overdraft_history
          ORDER BY overdraft_events DESC, lowest_balance, account_id LIMIT 20)""",
    "most_overdrafts": f"""SELECT customer_id, segment, {_int('overdraft_events', 'overdraft_events')} FROM v_customer_360
        ORDER BY overdraft_events DESC, customer_id LIMIT 20""",
    "row_counts": """SELECT 'transaction' AS table_name, count(*) AS n FROM t_transaction
        UNION ALL SELECT 'account', count(*) FROM t_account UNION ALL SELECT 'bank_customer', count(*) FROM t_bank_customer""",
    "ledger_accounts": "SELECT account_id, min(currency) AS currency FROM t_transaction GROUP BY 1",
    "seeded_customers": f"""
        SELECT 'cust-' || account_id AS customer_id, sha256(account_id) AS customer_natural_key,
               'Customer ' || upper(account_id) AS full_name,
               'user_' || account_id || '@example.com' AS email,
               ['RETAIL', 'PREMIER', 'STUDENT', 'BUSINESS'][1 + ('0x' || left(sha256(account_id), 15))::BIGINT % 4] AS segment,
               CAST({_EVENT_DAY} - INTERVAL 400 DAY AS VARCHAR) AS created_at, CAST({_EVENT_DAY} AS VARCHAR) AS ingest_time,
               'seed-1.0.0' AS pipeline_version
        FROM (SELECT DISTINCT account_id FROM t_transaction)
        WHERE 'cust-' || account_id NOT IN (SELECT customer_id FROM t_bank_customer)""",
    "seeded_accounts": f"""
        SELECT account_id, CAST(('0x' || left(sha256(account_id), 15))::BIGINT + 1000000000000000000 AS VARCHAR) AS account_number,
               'cust-' || account_id AS customer_id,
               ['CHECKING', 'SAVINGS'][1 + ('0x' || left(sha256(account_id), 15))::BIGINT % 2] AS account_type,
               currency, 'ACTIVE' AS status, CAST({_EVENT_DAY} - INTERVAL 365 DAY AS VARCHAR) AS opened_at,
               CAST({_EVENT_DAY} AS VARCHAR) AS ingest_time, 'seed-1.0.0' AS pipeline_version
        FROM (SELECT account_id, min(currency) AS currency FROM t_transaction GROUP BY 1)
        WHERE account_id NOT IN (SELECT account_id FROM t_account WHERE account_type = 'SAVINGS')""",
    "merged_silver": f"""
        SELECT transaction_id, idempotency_key, account_id, txn_type, {_dbl('amount', 'amount')}, currency, counterparty_account, status,
               {_txt('event_time')} FROM t_transaction WHERE event_time < TIMESTAMP '2024-01-16 00:00:00'
        UNION ALL SELECT transaction_id, idempotency_key, account_id, txn_type, amount, currency, counterparty_account, status, event_time
        FROM v_silver WHERE idempotency_key NOT IN (SELECT idempotency_key FROM t_transaction
                                                    WHERE event_time < TIMESTAMP '2024-01-16 00:00:00')""",
    "masked_transactions": f"""SELECT * REPLACE (CAST(NULL AS DOUBLE) AS amount, CAST(NULL AS VARCHAR) AS counterparty_account,
        {_txt('event_time')}, {_txt('ingest_time')}) FROM t_transaction""",
    "masked_customers": f"""SELECT * REPLACE (CAST(NULL AS VARCHAR) AS full_name, CAST(NULL AS VARCHAR) AS email,
        {_txt('created_at')}, {_txt('ingest_time')}) FROM t_bank_customer""",
    "masked_accounts": f"""SELECT * REPLACE (CAST(NULL AS VARCHAR) AS account_number, {_txt('opened_at')}, {_txt('ingest_time')})
        FROM t_account""",
    "masked_credit_profiles": f"""SELECT * REPLACE (CAST(NULL AS BIGINT) AS credit_score, CAST(NULL AS DOUBLE) AS annual_income,
        {_txt('generated_at')}) FROM t_credit_profile""",
    "masked_loan_requests": f"""SELECT * REPLACE (CAST(NULL AS VARCHAR) AS customer_name, {_dbl('amount', 'amount')},
        {_txt('submitted_at')}, {_txt('updated_at')}) FROM t_loan_request""",
    "posted_rows": f"""SELECT * REPLACE ({_dbl('amount', 'amount')}, {_txt('event_time')}, {_txt('ingest_time')})
        FROM t_transaction WHERE status = 'POSTED'""",
    "dim_customer": f"SELECT customer_id, segment, {_txt('created_at')} FROM t_bank_customer",
    "dim_account": f"SELECT account_id, customer_id, account_type, currency, status, {_txt('opened_at')} FROM t_account",
    "fact_transaction": f"SELECT account_id, {_READ} FROM t_transaction",
    "message_checks": "SELECT message_id, error FROM v_checked",
    "silver_batch": "SELECT * FROM v_silver",
    "silver_with_redeliveries": "SELECT message_id, transaction_id, idempotency_key FROM v_silver_all",
    "silver_within_ttl": """
        SELECT * FROM (WITH RECURSIVE d AS (SELECT CAST(ttl AS INT) AS ttl_seconds, idempotency_key, publish_time, min(message_id) AS message_id
                   FROM v_checked_silver, (VALUES (60), (3600)) AS t(ttl) GROUP BY ALL),
        kept AS (
          SELECT ttl_seconds, idempotency_key, min(publish_time) AS kept_at FROM d GROUP BY ALL
          UNION ALL
          SELECT k.ttl_seconds, k.idempotency_key, min(d.publish_time) FROM kept k JOIN d USING (ttl_seconds, idempotency_key)
          WHERE d.publish_time >= k.kept_at + to_seconds(k.ttl_seconds) GROUP BY ALL)
        SELECT ttl_seconds, message_id, idempotency_key FROM d JOIN kept USING (ttl_seconds, idempotency_key) WHERE publish_time = kept_at)""",
    "account_quiet_hours": f"""
        SELECT * FROM (WITH RECURSIVE d AS MATERIALIZED (SELECT account_id, event_time, min(transaction_id) AS transaction_id FROM t_transaction GROUP BY ALL),
        kept AS (
          SELECT account_id, min(event_time) AS kept_at FROM d GROUP BY ALL
          UNION ALL
          SELECT k.account_id, min(d.event_time) FROM kept k JOIN d USING (account_id)
          WHERE d.event_time >= k.kept_at + INTERVAL 1 HOUR GROUP BY ALL)
        SELECT account_id, transaction_id, {_txt('event_time')} FROM d JOIN kept USING (account_id) WHERE event_time = kept_at)""",
    "delivery_attempts": """
        SELECT message_id, CASE WHEN bad THEN 5 ELSE 1 END AS attempts, CASE WHEN bad THEN 'set aside' ELSE 'delivered' END AS outcome,
               CASE WHEN bad THEN 'JSONDecodeError' END AS reason
        FROM (SELECT message_id, NOT json_valid(data) AS bad FROM t_transaction_event)""",
    "dead_letters": f"""SELECT error, data AS payload, {_txt('publish_time', 'failed_at')}, '1.0.0' AS pipeline_version,
        error AS envelope_error FROM v_checked WHERE error IS NOT NULL""",
    "reconciled": """SELECT * EXCLUDE (ingest_time, source_system, pipeline_version), ingest_time AS publish_time FROM v_silver
        WHERE idempotency_key NOT IN (SELECT idempotency_key FROM t_transaction
                                      WHERE event_time < TIMESTAMP '2024-01-16 00:00:00')""",
    "streamed_silver": "SELECT * EXCLUDE (ingest_time, message_id) FROM v_silver",
    "streamed_dead_letters": "SELECT error, data AS payload, '1.0.0' AS pipeline_version FROM v_checked WHERE error IS NOT NULL",
    "streamed_bronze": f"""SELECT message_id, {_txt('publish_time')}, data,
        CAST(CAST(t_transaction_event.publish_time AS DATE) AS VARCHAR) AS publish_date FROM t_transaction_event""",
    "message_lines": "SELECT data, error FROM v_checked",
    "streamed_lines": "SELECT data, error FROM v_checked",
    "clustered_days": f"""SELECT transaction_id, account_id, {_txt('event_time')}, CAST(CAST(t.event_time AS DATE) AS VARCHAR) AS event_date
        FROM t_transaction t WHERE t.event_time >= TIMESTAMP '2024-01-08' AND t.event_time < TIMESTAMP '2024-01-15'""",
    "serving_table": """
        SELECT account_id || '#' || lpad(CAST(9999999999 - CAST(floor(epoch(event_time)) AS BIGINT) AS VARCHAR), 10, '0')
               || '#' || transaction_id AS row_key, transaction_id FROM t_transaction
        QUALIFY row_number() OVER (PARTITION BY row_key ORDER BY event_time DESC, transaction_id) = 1""",
    "corpus_load": "SELECT doc_id, title, category, sha256(content) AS hash FROM t_kb_raw",
    "appended_audit": f"""SELECT 'aud-' || decision_id AS audit_id, loan_id, approver AS actor, 'DECISION_' || decision AS action,
        rationale AS detail, {_txt('decided_at', 'event_time')} FROM t_approval_decision""",
    "freshness": """
        SELECT CAST(epoch(date_trunc('second', max(ingest_time))) - epoch(date_trunc('second', max(event_time))) AS BIGINT) AS newest_lag_seconds,
               CAST(max(lag) AS BIGINT) AS worst_lag_seconds, round(avg(lag), 3) AS avg_lag_seconds,
               count(*) FILTER (WHERE lag > 300) AS over_stream_target, count(*) FILTER (WHERE lag > 900) AS over_silver_target
        FROM (SELECT *, CAST(epoch(date_trunc('second', ingest_time)) - epoch(date_trunc('second', event_time)) AS BIGINT) AS lag
              FROM t_transaction)""",
    "dead_letter_backlog": """SELECT CAST(time_bucket(INTERVAL 5 MINUTE, publish_time) AS VARCHAR) AS window_start,
        count(*) AS letters, count(*) > 0 AS alert FROM v_checked WHERE error IS NOT NULL GROUP BY 1""",
    "personal_data_scan": f"""
        SELECT doc_id, info_type, count(*) AS findings, count(DISTINCT value) AS distinct_values FROM (
          {_found("EMAIL_ADDRESS", pii.EMAIL)} UNION ALL {_found("PHONE_NUMBER", pii.PHONE)}
          UNION ALL {_found("US_SOCIAL_SECURITY_NUMBER", pii.SSN)} UNION ALL {_found("IBAN_CODE", pii.IBAN)}
          UNION ALL SELECT * FROM ({_found("CREDIT_CARD_NUMBER", pii.CARD)}) WHERE {_LUHN.format(m="value")}
        ) GROUP BY 1, 2""",
    "deidentified_documents": "SELECT doc_id, content FROM v_deidentified",
    "deidentified_sample": """
        SELECT doc_id, sha256(CASE WHEN ('0x' || left(sha256(doc_id), 15))::BIGINT % 1000000 < 500000
                                   THEN content ELSE original END) AS content_hash FROM v_deidentified""",
    "deidentified_counterparties": """
        SELECT transaction_id, idempotency_key,
               CASE WHEN ('0x' || left(sha256(idempotency_key), 15))::BIGINT % 1000000 < 500000
                    THEN 'LEDGER_TOKEN(' || sha256('report-key' || iban) || ')' ELSE iban END AS counterparty_account
        FROM (SELECT *, 'GB29NWBK' || lpad(regexp_extract(counterparty_account, '[0-9]+'), 14, '0') AS iban
              FROM v_silver WHERE starts_with(counterparty_account, 'acct-'))""",
    "loan_status": f"""SELECT * REPLACE ({_dbl('amount', 'amount')}, {_txt('submitted_at')}, {_txt('updated_at')},
        {_dbl('counteroffer_amount', 'counteroffer_amount')}, {_txt('decided_at')}) FROM v_loan_status""",
    "loan_scores": f"""
        SELECT loan_id, dti_ratio, events AS overdraft_events, {_int('risk_score', 'risk_score')}, {_RECOMMEND} AS recommendation,
               cs_note || '|' || dti_note || '|' || od_note || '|' || size_note AS reasons,
               {_PRINCIPAL} AS principal_reasons, {_FACTORS} AS factors, 'risk-1.0.0' AS model_version FROM v_scored""",
    "loan_scores_by_proxy": f"""SELECT loan_id, events AS overdraft_events, {_int('risk_score', 'risk_score')},
        {_RECOMMEND} AS recommendation FROM v_scored_proxy""",
    "automatic_decisions": """
        SELECT loan_id, CASE WHEN risk_score <= 20 THEN 'APPROVE' WHEN risk_score >= 65 THEN 'REJECT' END AS decision,
               CASE WHEN risk_score <= 20 OR risk_score >= 65 THEN 'auto-policy' END AS approver,
               CASE WHEN risk_score <= 20 THEN 'auto-approved low risk ' || risk_score
                    WHEN risk_score >= 65 THEN 'auto-declined by policy' END AS rationale FROM v_scored""",
    "submission_checks": f"""
        SELECT loan_id, customer_name, {_dbl('amount', 'amount')}, term_months, array_to_string(list_filter([
          CASE WHEN coalesce(customer_name, '') = '' THEN 'customer_name must not be empty' END,
          CASE WHEN NOT coalesce(t.amount > 0, FALSE) THEN 'amount must be greater than 0' END,
          CASE WHEN term_months NOT BETWEEN 6 AND 360 THEN 'term_months must be 6 to 360' END],
          lambda x: x IS NOT NULL), '|') AS errors FROM t_loan_request t""",
    "decision_checks": """
        SELECT decision_id, CASE decision WHEN 'REQUEST_MODIFICATION' THEN 'COUNTEROFFER' ELSE decision END AS decision,
               CASE decision WHEN 'REQUEST_MODIFICATION' THEN 'counteroffer_amount required for COUNTEROFFER' ELSE '' END AS errors
        FROM t_approval_decision""",
    "versioned_decisions": f"""
        SELECT decision_id, n.loan_id, {_int("coalesce(h.used, 0) + row_number() OVER (PARTITION BY n.loan_id ORDER BY decided_at, decision_id)", "version")},
               decision, CASE decision WHEN 'APPROVE' THEN 'APPROVED' WHEN 'REJECT' THEN 'REJECTED'
                         WHEN 'REQUEST_MODIFICATION' THEN 'MODIFIED' WHEN 'COUNTEROFFER' THEN 'MODIFIED'
                         ELSE 'PENDING_APPROVAL' END AS status_after
        FROM (SELECT * FROM t_approval_decision WHERE decided_at >= TIMESTAMP '1998-01-01') n
        LEFT JOIN (SELECT loan_id, count(*) AS used FROM t_approval_decision
                   WHERE decided_at < TIMESTAMP '1998-01-01' GROUP BY 1) h ON n.loan_id = h.loan_id""",
    "audit_trail": f"""SELECT * REPLACE ({_txt('event_time')}),
        row_number() OVER (PARTITION BY loan_id ORDER BY t.event_time, audit_id) AS step FROM t_loan_audit_log t""",
    "newest_loans": f"""SELECT loan_id, status, {_txt('submitted_at')}, risk_score FROM (SELECT * FROM v_loan_status
        WHERE status = 'PENDING_APPROVAL')""",
    "outcome_breakdown": f"""SELECT coalesce(final_decision, status) AS outcome, {_int('count(*)', 'loans')},
        {_dbl('sum(amount)', 'amount')} FROM v_loan_status GROUP BY 1""",
    "average_risk": f"""SELECT status, {_int('count(*)', 'loans')}, round(avg(risk_score), 1) AS avg_risk FROM v_loan_status GROUP BY 1""",
    "approved_exposure": f"""SELECT {_dbl('sum(amount)', 'approved_exposure')}, {_int('count(*)', 'approved_loans')}
        FROM v_loan_status WHERE final_decision = 'APPROVE'""",
    "pending_by_segment": f"""SELECT c.segment, {_int('count(*)', 'pending_loans')} FROM t_loan_request l
        JOIN t_account a ON l.account_id = a.account_id JOIN t_bank_customer c ON a.customer_id = c.customer_id
        WHERE l.status = 'PENDING_APPROVAL' GROUP BY 1""",
    "steward_status": f"""
        SELECT run_id, goal, status, {_txt('started_at')}, {_txt('updated_at')}, last_step, last_task, last_score,
               last_resolution, last_approver
        FROM t_steward_run LEFT JOIN (
          SELECT run_id, unnest(arg_max(struct_pack(last_step := step_index, last_task := task, last_score := eval_score,
                                                    last_resolution := resolution, last_approver := approver), step_index))
          FROM t_steward_decision GROUP BY run_id) USING (run_id)""",
    "steward_summary": """
        SELECT *, rules - applied AS deferred,
               printf('%d failing rule(s); %d remediation order(s) approved, %d deferred/rejected.', rules, applied, rules - applied) AS summary
        FROM (SELECT run_id, count(*) AS rules, count(*) FILTER (WHERE resolution = 'applied') AS applied
              FROM t_steward_decision GROUP BY 1)""",
    "findings_history": f"""
        SELECT f.label, f.p_brand, s.resolution, s.approver, {_txt('s.decided_at')}
        FROM (SELECT 'Remediate part ' || p_partkey AS label, p_brand FROM part) f
        LEFT JOIN (SELECT * FROM t_steward_decision
                   QUALIFY row_number() OVER (PARTITION BY task ORDER BY decided_at DESC, decision_id DESC) = 1) s
          ON f.label = s.task""",
    "quality_scan": "SELECT * FROM v_scan",
    "quality_score": f"""
        SELECT scan, round(avg(passed::INT) * 100, 6) AS score, CASE WHEN bool_and(passed) THEN 'PASS' ELSE 'FAIL' END AS outcome,
               printf('%.1f%% (%s)', avg(passed::INT) * 100, CASE WHEN bool_and(passed) THEN 'PASS' ELSE 'FAIL' END) AS published,
               CAST({_EVENT_DAY} AS VARCHAR) AS last_run FROM v_scan GROUP BY scan""",
    "remediation": f"""
        SELECT scan || '#' || rule AS finding_id, 'Remediate ' || scan || ': ' || dimension || ' on ' || "column" || ' failed' AS label,
               round({_RATIO}, 6) AS fail_ratio, round(greatest(0.0::DOUBLE, 1 - {_RATIO} * 2), 2) AS confidence,
               CASE WHEN {_RATIO} = 0 THEN 'rule failed but no rows quantified — review the scan'
                    WHEN {_RATIO} < 0.05::DOUBLE THEN 'small blast radius (' || {_SHARE} || ' rows) — low-risk remediation'
                    ELSE 'large blast radius (' || {_SHARE} || ' rows) — review carefully before approving' END AS reason,
               'Quarantine the ' || (evaluated - passed_count) || ' failing row(s) on ' || "column" ||
               ', request an upstream backfill from the owning team, then re-run ' || scan || ' to verify. (dimension: ' || dimension || ')' AS proposal
        FROM v_scan WHERE NOT passed""",
    "referential_integrity": "SELECT * FROM v_integrity",
    "orphaned_chunks": "SELECT doc_id, title FROM t_kb_raw WHERE doc_id NOT IN (SELECT doc_id FROM t_kb_vector)",
    "column_profile": " UNION ALL ".join(
        _profile(c) for c in ("txn_type", "status", "account_id", "counterparty_account", "amount", "transaction_id")
    ),
    "quick_column_profile": " UNION ALL ".join(
        f'SELECT "column", rows, nulls, min_value, max_value FROM ({_profile(c)})'
        for c in ("txn_type", "status", "account_id", "counterparty_account")
    ),
    "contract_conformance": _contracts(),
    "contract_quality": _contract_quality(),
    "answerable_assets": f"""
        SELECT asset, NOT coalesce(bool_or(NOT coalesce(passed, TRUE) AND severity = 'blocking'), FALSE) AS answerable,
               coalesce(string_agg(DISTINCT CASE WHEN NOT passed AND severity <> 'blocking' THEN dimension || ' on ' || "column" END,
                 '|' ORDER BY CASE WHEN NOT passed AND severity <> 'blocking' THEN dimension || ' on ' || "column" END), '') AS caveats
        FROM (VALUES ('transaction', 'silver-txn-quality'), ('transaction', 'txn-account'), ('account', 'account-customer'),
                     ('transaction', 'deposit-transactions'), ('customer', 'customer-master'), ('loan', 'loan-master'),
                     ('overdraft', 'overdraft-history'), ('knowledge', 'bank-knowledge-base'),
                     ('knowledge', 'chunk-vector'), ('loan', 'risk-loan'), ('unscanned', 'no-such-scan')) AS a(asset, scan)
        LEFT JOIN (SELECT {_SCAN_COLUMNS} FROM v_integrity UNION ALL SELECT {_SCAN_COLUMNS} FROM v_scan
                   UNION ALL SELECT {_SCAN_COLUMNS} FROM ({_contract_quality()})) r ON a.scan = r.scan
        GROUP BY asset""",
    "recertification": """
        SELECT agent_id, owner, risk_tier, CAST(last_recertified AS VARCHAR) AS last_recertified, CAST(due AS VARCHAR) AS recert_due,
               due - DATE '2024-01-31' AS days_left,
               CASE WHEN due < DATE '2024-01-31' THEN 'fail' WHEN due - DATE '2024-01-31' <= 14 THEN 'warn' ELSE 'ok' END AS finding
        FROM (SELECT *, last_recertified + CASE risk_tier WHEN 'HIGH' THEN 90 WHEN 'MEDIUM' THEN 180 ELSE 365 END AS due
              FROM t_agent_registry)""",
    "quarantined": f"""SELECT message_id, transaction_id, idempotency_key, amount, array_to_string({_failed_marks()}, '|') AS failed_rules
        FROM v_silver_all WHERE len({_failed_marks()}) > 0""",
    "quarantine_passed": f"SELECT message_id, transaction_id, amount FROM v_silver_all WHERE len({_failed_marks()}) = 0",
    "quarantine_table": """
        SELECT message_id, transaction_id, amount, array_to_string(marks, '|') AS failed_rules FROM (
          SELECT *, list_filter([
            CASE WHEN amount IS NULL THEN 'amount:non_null' END,
            CASE WHEN NOT coalesce(txn_type IN ('DEPOSIT', 'WITHDRAWAL', 'TRANSFER', 'FEE'), FALSE) THEN 'txn_type:set' END,
            CASE WHEN status = 'POSTED' AND amount IS NULL THEN 'amount:non_null' END,
            CASE WHEN NOT coalesce(amount BETWEEN 0 AND 20, FALSE) THEN 'amount:range' END,
            CASE WHEN txn_type = 'TRANSFER' AND counterparty_account IS NULL THEN 'counterparty_account:non_null' END
          ], lambda x: x IS NOT NULL) AS marks FROM v_silver) WHERE len(marks) > 0""",
    "sparse_search": "SELECT query_id, doc_id, round(score, 6) AS score, rnk FROM v_sparse",
    "dense_search": "SELECT query_id, doc_id, round(distance, 6) AS distance, rnk FROM v_dense",
    "hybrid_search": f"""
        SELECT f.query_id, f.doc_id, d.title, d.category, round(f.rrf, 9) AS rrf, f.in_dense, f.in_sparse, {_retriever()}, f.rnk
        FROM v_fused f JOIN t_kb_raw d ON f.doc_id = d.doc_id""",
    "dense_only_search": f"SELECT query_id, doc_id, {_retriever()}, rnk FROM v_fused_dense",
    "reranked_search": """
        SELECT query_id, doc_id, rnk, row_number() OVER (PARTITION BY query_id
                 ORDER BY coalesce(list_position(named, rnk), 1000000 + rnk)) AS final_rank
        FROM v_dense JOIN (
          SELECT query_id, list_distinct_in_order AS named FROM (
            SELECT d.query_id, coalesce((SELECT list(x ORDER BY place) FROM (
                SELECT x, min(i) AS place FROM (
                  SELECT unnest(hits) AS h, unnest(range(1, len(hits) + 1)) AS i, TRY_CAST(h AS BIGINT) AS x) u
                WHERE x BETWEEN 1 AND d.n GROUP BY x)), []) AS list_distinct_in_order
            FROM (SELECT query_id, count(*) AS n FROM v_dense GROUP BY 1) d
            LEFT JOIN (SELECT 'q-' || query_id AS query_id, regexp_extract_all(reply, '[0-9]+') AS hits FROM t_rerank_reply) r
              ON d.query_id = r.query_id)) USING (query_id)""",
    "document_chunks": """
        SELECT path || '#' || (row_number() OVER (PARTITION BY path ORDER BY i, j) - 1) AS doc_id,
               CASE WHEN heading IS NULL THEN title ELSE title || ' — ' || heading END AS title,
               'page' AS category, path AS source_path,
               '[' || path || '] ' || CASE WHEN heading IS NULL THEN title ELSE title || ' — ' || heading END
                 || chr(10) || chr(10) || piece AS content
        FROM v_pieces""",
    "classified_sources": """
        SELECT page_id, path, CASE WHEN regexp_full_match(path, 'en/([^/]+/)*[^/]*') THEN 'english'
                                   WHEN regexp_full_match(path, 'fr/[^/]*') THEN 'french'
                                   WHEN regexp_full_match(path, 'de/[^/]*') THEN 'german'
                                   WHEN regexp_full_match(path, '[^/]*/[^/]*') THEN 'other' END AS category
        FROM (SELECT page_id, regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) AS path FROM pages)
        WHERE category IS NOT NULL AND path NOT IN ('en/1', 'fr/1')""",
    "embedded_chunks": f"""SELECT r.doc_id, r.title, r.category, {_int('len(e.embedding)', 'dimensions')},
        {_int('length(r.content)', 'chars')} FROM t_kb_raw r LEFT JOIN t_kb_vector e ON r.doc_id = e.doc_id""",
    "chunks_to_embed": """
        SELECT doc_id, sha256(content) AS content_hash FROM t_kb_raw
        WHERE doc_id NOT IN (SELECT doc_id FROM t_kb_vector)
           OR doc_id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1)""",
    "question_intents": _intent_sql("conversation_id", "t_conversation_log", "question"),
    "catalog_search": """
        SELECT entry_name, display_name, resource, entry_type, governed,
               CAST(CASE WHEN governed THEN 0 WHEN entry_type IN ('glossary-term', 'glossary-category') THEN 1 ELSE 2 END AS BIGINT) AS display_group
        FROM (SELECT * FROM (
                SELECT *, row_number() OVER (PARTITION BY display_name, entry_type ORDER BY relevance, entry_name) AS rn
                FROM t_catalog_entry WHERE contains(lower(display_name), 'red')
                  AND (entry_type IN ('glossary-term', 'glossary-category') OR contains(resource, 'prod') OR contains(entry_name, 'prod')))
              WHERE rn = 1)""",
    "edge_counts": f"""
        SELECT label, {_int('count(*)', 'edges')}, {_int('count(DISTINCT dst)', 'targets')} FROM (
          SELECT 'OWNS' AS label, account_id AS dst FROM t_account
          UNION ALL SELECT 'ON_ACCOUNT', account_id FROM t_transaction
          UNION ALL SELECT 'REQUESTED', loan_id FROM t_loan_request) GROUP BY 1""",
    "deposits_by_owner_segment": f"""SELECT segment, {_int('count(*)', 'txns')}, {_dbl('sum(amount)', 'total')}
        FROM v_bridge WHERE txn_type = 'DEPOSIT' GROUP BY 1""",
    "join_cardinality": "",
    "transfer_edges": f"SELECT src, dst, transfers, {_dbl('amount', 'amount')} FROM v_transfers",
    "transfer_walks": f"""SELECT a.src AS node, a.n AS walks_1, {_int('coalesce(b.n, 0)', 'walks_2')}, {_int('coalesce(c.n, 0)', 'walks_3')}
        FROM v_hop1 a LEFT JOIN v_hop2 b USING (src) LEFT JOIN v_hop3 c USING (src)""",
    "hops_from_savings": f"SELECT node, {_int('min(hops)', 'hops')} FROM v_reach3 GROUP BY node",
    "logged_turns": """SELECT conversation_id, question, coalesce(answer, '') AS answer, latency_ms
        FROM t_conversation_log WHERE trim(coalesce(question, '')) <> ''""",
    "appended_turns": f"""SELECT conversation_id, {_txt('ts')}, persona, channel, left(question, 4000) AS question,
               left(coalesce(answer, ''), 8000) AS answer, context, latency_ms, model_requested, model_served
        FROM t_conversation_log t WHERE trim(coalesce(t.question, '')) <> ''""",
    "log_page": f"""
        SELECT conversation_id, {_txt('ts')}, persona,
               question, answer, overall, groundedness, safety
        FROM (SELECT l.*, s.overall, s.groundedness, s.safety FROM t_conversation_log l LEFT JOIN v_scores s USING (conversation_id)
              WHERE l.ts >= {_LOG_DAY} - INTERVAL 168 HOUR ORDER BY l.ts DESC, conversation_id LIMIT 20 OFFSET 10)""",
    "log_total": f"SELECT {_int('count(*)', 'total')} FROM t_conversation_log WHERE ts >= {_LOG_DAY} - INTERVAL 168 HOUR",
    "unscored_turns": f"""SELECT conversation_id, {_txt('l.ts')}, l.channel FROM t_conversation_log l LEFT JOIN v_scores s USING (conversation_id)
        WHERE s.conversation_id IS NULL AND l.ts >= {_LOG_DAY} - INTERVAL 168 HOUR AND l.question IS NOT NULL
          AND l.answer IS NOT NULL AND l.answer <> '' AND NOT starts_with(l.answer, '[error]')""",
    "composite_scores": f"SELECT * EXCLUDE (present) REPLACE ({_txt('scored_at')}) FROM v_scores",
    "eval_summary": f"""
        SELECT {_int('count(*)', 'n')}, {_txt('max(scored_at)', 'last_scored_at')},
               round(avg((groundedness - 1) / 4), 3) AS grounding_accuracy, round(1 - avg((groundedness - 1) / 4), 3) AS hallucination_rate,
               round(avg((instruction_following - 1) / 4), 3) AS instruction_following, round(avg((coherence - 1) / 4), 3) AS coherence,
               round(avg(safety), 3) AS safety, round(avg(overall), 3) AS overall,
               (SELECT quantile_disc(latency_ms, 0.5) FROM t_conversation_log WHERE ts >= {_LOG_DAY} - INTERVAL 7 DAY) AS latency_p50_ms,
               (SELECT quantile_disc(latency_ms, 0.95) FROM t_conversation_log WHERE ts >= {_LOG_DAY} - INTERVAL 7 DAY) AS latency_p95_ms
        FROM v_scores WHERE scored_at >= {_LOG_DAY} - INTERVAL 7 DAY""",
    "grounding": f"""
        SELECT conversation_id, array_to_string(bad, '|') AS unsupported, len(bad) = 0 AS grounded FROM (
          SELECT conversation_id, coalesce((SELECT list(n ORDER BY place) FROM (
              SELECT n, min(i) AS place FROM (SELECT unnest(nums) AS n, unnest(range(1, len(nums) + 1)) AS i) u
              WHERE NOT list_contains(facts, n) AND NOT contains(conversation_id, n) GROUP BY n)), []) AS bad
          FROM (SELECT conversation_id, regexp_extract_all(answer, '{NUMBER_PATTERN}') AS nums,
                       regexp_extract_all(question, '{NUMBER_PATTERN}') AS facts
                FROM t_conversation_log WHERE answer IS NOT NULL))""",
    "turn_scores": "SELECT conversation_id, tool_ok, grounded, hallucinated FROM v_turns",
    "canary_metrics": f"SELECT channel, {_METRICS} FROM v_turns GROUP BY channel",
    "evaluation_gate": " UNION ALL ".join(
        f"""SELECT channel, '{metric}' AS metric, {metric} AS value, {limit}::DOUBLE AS bound, {metric} {sign} {limit}::DOUBLE AS passed
            FROM (SELECT channel, {_METRICS} FROM v_turns GROUP BY channel)"""
        for metric, sign, limit in (
            ("grounding_accuracy", ">=", "0.9"), ("tool_utilization", ">=", "0.9"), ("hallucination_rate", "<=", "0.05"),
        )
    ),
    "canary_regressions": " UNION ALL ".join(
        (
            _regression("grounding_accuracy", "0.1", "{d} < -0.10::DOUBLE"),
            _regression("tool_utilization", "0.1", "{d} < -0.10::DOUBLE"),
            _regression("hallucination_rate", "0.05", "{d} > 0.05::DOUBLE"),
        )
    ),
    "version_changes": """SELECT conversation_id, CASE WHEN model_served IS NOT NULL
        THEN 'assistant-' || persona || ' -> ' || model_served END AS change FROM t_conversation_log""",
    "unit_economics": f"SELECT workload_class, model, initiated_by, {_ECONOMICS_COLUMNS} FROM v_economics GROUP BY 1, 2, 3",
    "unit_economics_by_workload": f"SELECT workload_class, initiated_by, {_ECONOMICS_COLUMNS} FROM v_economics GROUP BY 1, 2",
    "priced_economics": f"""
        SELECT workload_class, model, initiated_by, {_int('tasks', 'tasks')}, {_int('unjudged', 'unjudged')},
               {_int('successful', 'successful')}, {_int('tokens', 'tokens')}, round(cost, 6) AS cost,
               round(cost / nullif(successful, 0), 6) AS cost_per_success, round(unjudged * 100.0::DOUBLE / tasks) AS unjudged_pct
        FROM v_priced_rows""",
    "recommendation_accuracy": f"""
        SELECT 'approval_recommendation_accuracy' AS metric, {_int('count(*)', 'n')},
               round(avg((got = expected)::INT), 3) AS accuracy, round(avg((got = expected)::INT), 3) >= 0.8::DOUBLE AS passed
        FROM (SELECT loan_id, {_RECOMMEND} AS got FROM v_scored)
        JOIN (SELECT loan_id, recommendation AS expected FROM v_last_risk) USING (loan_id)""",
    "consequential_actions": f"""SELECT {_txt('t.ts')}, agent_id, owner, tool, authorized, hitl_approver, model_version
        FROM t_agent_action_log t WHERE consequential AND t.ts >= {_EVENT_DAY} - INTERVAL 7 DAY""",
    "unauthorized_calls": f"SELECT agent_id, tool, {_int('count(*)', 'calls')} FROM t_agent_action_log WHERE NOT authorized GROUP BY 1, 2",
}

STATEMENTS["merged_customers"] = f"""
    SELECT * REPLACE ({_txt('created_at')}, {_txt('ingest_time')}) FROM t_bank_customer
    UNION ALL BY NAME ({STATEMENTS['seeded_customers']})"""
STATEMENTS["streamed_backlog"] = STATEMENTS["dead_letter_backlog"]
STATEMENTS["streamed_progress"] = f"""
    -- The feed's statement reads the events three times.
    SELECT CAST(0 AS BIGINT) AS batch_id, 3 * (SELECT count(*) FROM events) AS input_rows, FALSE AS over_stream_target,
           (SELECT count(*) FROM v_checked WHERE error IS NOT NULL) AS letters"""
STATEMENTS["upserted_balances"] = STATEMENTS["balance_projection"]
STATEMENTS["expired_dead_letters"] = STATEMENTS["dead_letter_retention"]


def _cardinality() -> str:
    tables = {
        "dim_account": "t_account",
        "dim_customer": "t_bank_customer",
        "fact_transaction": "t_transaction",
        "overdraft_history": "v_overdraft_history",
        "customer_360": "v_customer_360",
    }
    out = []
    for src, src_col, dst, dst_col, relationship, cardinality in RELATIONSHIPS:
        repeated_to = f"(SELECT count(*) FROM (SELECT {dst_col} FROM {tables[dst]} GROUP BY 1 HAVING count(*) > 1))"
        repeated_from = f"(SELECT count(*) FROM (SELECT {src_col} FROM {tables[src]} GROUP BY 1 HAVING count(*) > 1))"
        repeated_from = repeated_from if cardinality == "one-to-one" else "0"
        orphans = f"(SELECT count(*) FROM {tables[src]} WHERE {src_col} NOT IN (SELECT {dst_col} FROM {tables[dst]}))"
        out.append(
            f"SELECT '{relationship}' AS relationship, CAST({repeated_to} AS BIGINT) AS repeated_targets, "
            f"CAST({repeated_from} AS BIGINT) AS repeated_sources, CAST({orphans} AS BIGINT) AS orphans"
        )
    union = " UNION ALL ".join(out)
    return f"SELECT *, repeated_targets = 0 AND repeated_sources = 0 AND orphans = 0 AS holds FROM ({union})"


STATEMENTS["join_cardinality"] = _cardinality()

_NAMED = re.compile(r"\b([tv])_([a-z0-9_]+)\b")


def _ctes(text: str, done: dict[str, str]) -> None:
    for kind, name in _NAMED.findall(text):
        full = f"{kind}_{name}"
        if full in done or (kind == "t" and name not in banking_sql.TABLES) or (kind == "v" and name not in VIEWS):
            continue
        if kind == "t":
            refs = {r: f"t_{r}" if r in banking_sql.TABLES else r for r in banking_sql.references(name)}
            body = banking_sql.for_duckdb(name).format(**refs)
        else:
            body = VIEWS[name]
        _ctes(body, done)
        done[full] = body


def statement(name: str) -> str:
    """One statement with the CTEs it needs."""
    done: dict[str, str] = {}
    _ctes(STATEMENTS[name], done)
    prelude = ",\n".join(f"{full} AS ({body})" for full, body in done.items())
    return f"WITH {prelude}\n{STATEMENTS[name]}" if prelude else STATEMENTS[name]


def all_statements() -> dict[str, str]:
    return {name: statement(name) for name in STATEMENTS}
