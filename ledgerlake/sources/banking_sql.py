"""Banking tables expressed over the supplied star-schema tables.

Each entry is one SELECT in the subset of SQL that Spark and DuckDB share. ``{name}``
stands for another table of this module or for a supplied parquet table.
"""

from __future__ import annotations

BASE_TABLES = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
)

_K = "CAST(regexp_extract(props, '[0-9]+', 0) AS INT)"

_EVENT_COLUMNS = f"""
    event_id,
    ts,
    {_K} AS k,
    concat('txn-', CAST(event_id AS STRING)) AS transaction_id,
    concat('acct-', CAST(user_id AS STRING), ':', CAST(event_id AS STRING)) AS idempotency_key,
    concat('acct-', CAST(user_id AS STRING)) AS account_id,
    CASE event_type WHEN 'purchase' THEN 'WITHDRAWAL' WHEN 'click' THEN 'TRANSFER'
                    WHEN 'error' THEN 'FEE' ELSE 'DEPOSIT' END AS txn_type,
    CAST(value AS DECIMAL(18,2)) AS amount,
    'USD' AS currency,
    CASE WHEN event_type = 'click'
         THEN concat('acct-', CAST((user_id * 7 + 1) % 150 AS STRING)) END AS counterparty_account,
    CASE WHEN event_id % 33 = 0 THEN 'REJECTED'
         WHEN event_id % 50 = 1 THEN 'PENDING' ELSE 'POSTED' END AS status
"""

# A message whose fault is chosen by the event's own property k, or a sound one.
_FAULTY_PAYLOAD = """
    CASE k
      WHEN 96 THEN concat('not json: ', transaction_id)
      WHEN 97 THEN concat('["', transaction_id, '"]')
      ELSE concat(
        '{{"transaction_id":"', transaction_id, suffix,
        '","idempotency_key":"', suffix_key, idempotency_key,
        '","account_id":"', CASE WHEN k = 98 THEN '' ELSE account_id END,
        '","txn_type":"', CASE WHEN k IN (91, 99) THEN 'BRIBE' ELSE txn_type END, '"',
        CASE WHEN k = 90 THEN ''
             WHEN k = 93 THEN concat(',"amount":"', CAST(amount AS STRING), '5"')
             ELSE concat(',"amount":"', CAST(amount AS STRING), '"') END,
        ',"currency":"', CASE WHEN k = 94 THEN 'usd' ELSE currency END,
        '","counterparty_account":"', coalesce(counterparty_account, ''),
        '","status":"', CASE WHEN k IN (92, 99) THEN 'HACKED' ELSE status END,
        '","event_time":"', CASE WHEN k = 95 THEN 'not-a-date'
                                 ELSE concat(replace(CAST(ts AS STRING), ' ', 'T'), 'Z') END,
        '"}}')
    END
"""

TABLES: dict[str, str] = {
    "event_rows": f"SELECT {_EVENT_COLUMNS} FROM {{events}}",
    "transaction": """
        SELECT transaction_id, idempotency_key, account_id, txn_type, amount, currency,
               counterparty_account, status, CAST(ts AS TIMESTAMP) AS event_time,
               CAST(ts AS TIMESTAMP) + k * INTERVAL '1' SECOND AS ingest_time,
               'event-feed' AS source_system, '1.0.0' AS pipeline_version
        FROM {event_rows}
    """,
    # Every message once, one in ten again under a new transaction id, one in ten broken.
    "transaction_event": f"""
        SELECT 'transactions' AS subscription_name, message_id,
               CAST(publish_time AS TIMESTAMP) AS publish_time,
               {_FAULTY_PAYLOAD} AS data, CAST(NULL AS STRING) AS attributes
        FROM (
          SELECT concat('m-', CAST(event_id AS STRING)) AS message_id,
                 ts AS publish_time, '' AS suffix, '' AS suffix_key,
                 0 AS k, ts, transaction_id, idempotency_key, account_id, txn_type, amount,
                 currency, counterparty_account, status
          FROM {{event_rows}}
          UNION ALL
          SELECT concat('r-', CAST(event_id AS STRING)), ts + INTERVAL '60' SECOND, '-r', '',
                 0, ts, transaction_id, idempotency_key, account_id, txn_type, amount,
                 currency, counterparty_account, status
          FROM {{event_rows}} WHERE k < 10
          UNION ALL
          SELECT concat('b-', CAST(event_id AS STRING)), ts, '', 'bad-',
                 k, ts, transaction_id, idempotency_key, account_id, txn_type, amount,
                 currency, counterparty_account, status
          FROM {{event_rows}} WHERE k >= 90
        ) AS feed
    """,
    "account": """
        SELECT concat('acct-', CAST(c_custkey AS STRING)) AS account_id,
               CAST(1000000000 + c_custkey * 7919 AS STRING) AS account_number,
               concat('cust-', CAST(c_custkey - c_custkey % 2 AS STRING)) AS customer_id,
               CASE WHEN c_custkey % 3 = 0 THEN 'SAVINGS' ELSE 'CHECKING' END AS account_type,
               'USD' AS currency, 'ACTIVE' AS status,
               TIMESTAMP '2023-01-01 00:00:00' AS opened_at,
               TIMESTAMP '2023-01-01 00:00:00' AS ingest_time, 'seed-1.0.0' AS pipeline_version
        FROM {customer}
    """,
    "bank_customer": """
        SELECT concat('cust-', CAST(c.c_custkey AS STRING)) AS customer_id,
               {sha256}(concat('cust-', CAST(c.c_custkey AS STRING)){sha256_bits}) AS customer_natural_key,
               c.c_name AS full_name,
               concat('user_', CAST(c.c_custkey AS STRING), '@example.com') AS email,
               c.c_mktsegment AS segment,
               coalesce(CAST(o.first_order AS TIMESTAMP), TIMESTAMP '1995-01-01 00:00:00') AS created_at,
               TIMESTAMP '2023-01-01 00:00:00' AS ingest_time, 'seed-1.0.0' AS pipeline_version
        FROM {customer} c
        LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first_order FROM {orders} GROUP BY o_custkey) o
          ON c.c_custkey = o.o_custkey
    """,
    "loan_request": """
        SELECT concat('loan-', CAST(o.o_orderkey AS STRING)) AS loan_id,
               c.c_name AS customer_name,
               concat('acct-', CAST(o.o_custkey AS STRING)) AS account_id,
               CAST(CAST(o.o_totalprice AS DECIMAL(18,2)) % 80000 AS DECIMAL(18,2)) AS amount,
               6 + o.o_orderkey % 355 AS term_months,
               CASE o.o_orderstatus WHEN 'P' THEN 'PENDING_APPROVAL' WHEN 'O' THEN 'CREATED'
                                    ELSE 'APPROVED' END AS status,
               CAST(o.o_orderdate AS TIMESTAMP) AS submitted_at,
               CAST(o.o_orderdate AS TIMESTAMP) AS updated_at
        FROM {orders} o LEFT JOIN {customer} c ON o.o_custkey = c.c_custkey
    """,
    "credit_profile": """
        SELECT concat('prof-', CAST(o_orderkey AS STRING)) AS profile_id,
               concat('loan-', CAST(o_orderkey AS STRING)) AS loan_id,
               540 + (o_orderkey * 7919) % 281 AS credit_score,
               CAST(35000 + (o_orderkey * 104729) % 145001 AS DOUBLE) AS annual_income,
               CAST((o_orderkey * 1299709) % 60001 AS DOUBLE) AS existing_debt,
               CAST(o_orderdate AS TIMESTAMP) AS generated_at
        FROM {orders}
    """,
    "risk_assessment": """
        SELECT concat('risk-', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS assessment_id,
               concat('loan-', CAST(l_orderkey AS STRING)) AS loan_id,
               CAST(l_linenumber AS BIGINT) AS version,
               score AS risk_score,
               CASE WHEN score <= 35 THEN 'APPROVE' WHEN score >= 65 THEN 'DECLINE' ELSE 'REVIEW' END AS recommendation,
               CAST(NULL AS BIGINT) AS overdraft_events,
               CAST(NULL AS STRING) AS reasons, CAST(NULL AS STRING) AS factors,
               'risk-1.0.0' AS model_version, created_at
        FROM (
          SELECT l_orderkey, l_linenumber, CAST(sum(l_quantity) AS BIGINT) % 101 AS score,
                 CAST(min(l_shipdate) AS TIMESTAMP) AS created_at
          FROM {lineitem} GROUP BY l_orderkey, l_linenumber
        ) AS scored
    """,
    "approval_decision": """
        SELECT concat('dec-', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS decision_id,
               concat('loan-', CAST(l_orderkey AS STRING)) AS loan_id,
               CAST(l_linenumber AS BIGINT) AS version,
               CASE flag WHEN 'A' THEN 'APPROVE' WHEN 'R' THEN 'REJECT' ELSE 'REQUEST_MODIFICATION' END AS decision,
               CAST(NULL AS DECIMAL(18,2)) AS counteroffer_amount,
               concat('approver-', CAST(supp % 5 AS STRING)) AS approver,
               CAST(NULL AS STRING) AS rationale, decided_at
        FROM (
          SELECT l_orderkey, l_linenumber, chr(min(ascii(l_returnflag))) AS flag, min(l_suppkey) AS supp,
                 CAST(min(l_shipdate) AS TIMESTAMP) AS decided_at
          FROM {lineitem} GROUP BY l_orderkey, l_linenumber
        ) AS decided
    """,
    "loan_audit_log": """
        SELECT concat('aud-', decision_id) AS audit_id, loan_id, approver AS actor,
               concat('DECISION_', decision) AS action, rationale AS detail, decided_at AS event_time
        FROM {approval_decision}
        UNION ALL
        SELECT concat('aud-', assessment_id), loan_id, 'approval-agent', 'RISK_ASSESSMENT',
               concat('score=', CAST(risk_score AS STRING), ', rec=', recommendation), created_at
        FROM {risk_assessment}
    """,
    "steward_run": """
        SELECT concat('run-', CAST(o_orderkey AS STRING)) AS run_id,
               concat('reconcile ', o_orderpriority) AS goal,
               CASE o_orderstatus WHEN 'P' THEN 'AWAITING_HUMAN' WHEN 'O' THEN 'WORKING' ELSE 'DONE' END AS status,
               CAST(o_orderdate AS TIMESTAMP) AS started_at, CAST(o_orderdate AS TIMESTAMP) AS updated_at
        FROM {orders}
    """,
    "steward_decision": """
        SELECT concat('step-', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS decision_id,
               concat('run-', CAST(l_orderkey AS STRING)) AS run_id,
               CAST(l_linenumber AS BIGINT) AS step_index,
               concat('Remediate part ', CAST(part AS STRING)) AS task,
               discount AS eval_score,
               CASE flag WHEN 'A' THEN 'applied' WHEN 'R' THEN 'human_rejected' ELSE 'timeout_auto_defer' END AS resolution,
               CASE WHEN flag <> 'N' THEN concat('approver-', CAST(supp % 5 AS STRING)) END AS approver,
               decided_at
        FROM (
          SELECT l_orderkey, l_linenumber, chr(min(ascii(l_returnflag))) AS flag, min(l_suppkey) AS supp,
                 min(l_partkey) AS part, min(l_discount) AS discount,
                 CAST(min(l_shipdate) AS TIMESTAMP) AS decided_at
          FROM {lineitem} GROUP BY l_orderkey, l_linenumber
        ) AS steps
    """,
    "kb_raw": """
        SELECT CAST(doc_id AS STRING) AS doc_id, source AS title, lang AS category, text AS content
        FROM {documents}
    """,
    "kb_vector": "SELECT CAST(vec_id AS STRING) AS doc_id, embedding FROM {embeddings}",
    "kb_query": "SELECT concat('q-', CAST(item_id AS STRING)) AS query_id, text AS query FROM {benchmark}",
    "kb_query_vector": """
        SELECT concat('q-', CAST(b.item_id AS STRING)) AS query_id, e.embedding AS embedding
        FROM {benchmark} b JOIN {embeddings} e ON b.item_id = e.vec_id
    """,
    "conversation_log": """
        SELECT concat(CAST(q.conv_id AS STRING), '-', CAST(q.turn AS STRING)) AS conversation_id,
               TIMESTAMP '2024-01-01 00:00:00' + q.conv_id * INTERVAL '1' HOUR
                 + q.turn * INTERVAL '1' MINUTE AS ts,
               CASE WHEN q.conv_id % 2 = 0 THEN 'customer' ELSE 'analyst' END AS persona,
               CASE q.conv_id % 3 WHEN 0 THEN 'agent' WHEN 1 THEN 'analytics' ELSE 'kb' END AS channel,
               q.text AS question, a.text AS answer, CAST(NULL AS STRING) AS context,
               (q.conv_id * 7919 + q.turn * 104729) % 5000 AS latency_ms,
               'assistant-v1' AS model_requested,
               CASE WHEN q.turn = 0 THEN 'assistant-v1' END AS model_served,
               CASE WHEN q.conv_id % 2 = 1 THEN concat('acct-', CAST(q.conv_id AS STRING))
                    ELSE lower(regexp_extract(a.text, '[A-Za-z]+', 0)) END AS account_id,
               q.conv_id AS conv_id, q.turn AS turn
        FROM {conversations} q
        LEFT JOIN {conversations} a
          ON q.conv_id = a.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant'
        WHERE q.role = 'user'
    """,
    "judge_verdict": """
        SELECT conversation_id, ts AS scored_at, channel,
               CASE WHEN conv_id % 5 = 0 THEN NULL ELSE CAST(1 + conv_id % 5 AS DOUBLE) END AS groundedness,
               CAST(1 + (conv_id * 3) % 5 AS DOUBLE) AS instruction_following,
               CAST(1 + (conv_id * 7) % 5 AS DOUBLE) AS coherence,
               CASE WHEN conv_id % 11 = 0 THEN 0.0E0 ELSE 1.0E0 END AS safety
        FROM {conversation_log}
        WHERE conv_id % 4 <> 0 AND answer IS NOT NULL
    """,
    "gateway_request": """
        SELECT conversation_id AS session_id,
               concat('agent-', CAST(conv_id % 8 AS STRING)) AS agent_id,
               CASE conv_id % 3 WHEN 0 THEN 'agent' WHEN 1 THEN 'analytics' ELSE 'kb' END AS workload_class,
               CASE WHEN conv_id % 2 = 1 THEN concat('user-', CAST(conv_id AS STRING)) END AS on_behalf_of,
               'standard' AS tier,
               CASE WHEN conv_id % 2 = 0 THEN 'small-model' ELSE 'large-model' END AS model,
               CAST(length(question) AS BIGINT) AS input_tokens,
               CAST(length(answer) AS BIGINT) AS output_tokens,
               CASE WHEN conv_id % 13 = 0 THEN 'error' ELSE 'ok' END AS outcome,
               'complete' AS surface, ts
        FROM {conversation_log}
    """,
    "agent_action_log": """
        SELECT CAST(ts AS TIMESTAMP) AS ts,
               concat('agent-', CAST(user_id % 8 AS STRING)) AS agent_id,
               concat('owner-', CAST(user_id % 3 AS STRING)) AS owner,
               event_type AS tool,
               event_type <> 'error' AS authorized,
               event_type = 'purchase' AS consequential,
               CASE WHEN event_type = 'purchase' THEN concat('approver-', CAST(user_id % 5 AS STRING)) END AS hitl_approver,
               'assistant-v1' AS model_version,
               event_id
        FROM {events}
    """,
    "agent_registry": """
        SELECT concat('agent-', CAST(s_suppkey AS STRING)) AS agent_id,
               concat('owner-', CAST(s_nationkey AS STRING)) AS owner,
               CASE s_nationkey % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS risk_tier,
               DATE '2023-06-01' + CAST(s_suppkey % 365 AS INT) AS last_recertified
        FROM {supplier}
    """,
    "catalog_entry": """
        SELECT concat('p', CAST(p_partkey AS STRING)) AS entry_name,
               p_name AS display_name,
               concat('ledger_', CASE WHEN p_size % 2 = 0 THEN 'prod' ELSE 'dev' END, '.', p_type) AS resource,
               CASE p_type WHEN 'STANDARD' THEN 'glossary-term' WHEN 'SMALL' THEN 'data-product'
                           ELSE 'table' END AS entry_type,
               p_brand = 'Brand#1' OR p_brand = 'Brand#2' AS governed,
               p_partkey AS relevance
        FROM {part}
    """,
    "rerank_reply": "SELECT CAST(page_id AS STRING) AS query_id, html AS reply FROM {pages}",
    "page_markdown": """
        SELECT concat('pages/', CAST(page_id AS STRING), '.md') AS path,
               regexp_replace(
               regexp_replace(
               regexp_replace(
               regexp_replace(
               regexp_replace(
               regexp_replace(
               regexp_replace(html, '(?s)<(style|script|title|nav)>.*?</(style|script|title|nav)>', '', 'g'),
                 '<p><b>', chr(10) || chr(10) || '## ', 'g'),
                 '<h1>', chr(10) || '# ', 'g'),
                 '</h1>', chr(10) || chr(10), 'g'),
                 '<br>', chr(10) || chr(10), 'g'),
                 '</?p>', chr(10) || chr(10), 'g'),
                 '<[a-zA-Z/][^>]*>', '', 'g') AS markdown
        FROM {pages}
    """,
}


def for_spark(name: str) -> str:
    """The SELECT of ``name`` in Spark's dialect."""
    text = TABLES[name].replace("{sha256}", "sha2").replace("{sha256_bits}", ", 256")
    return text.replace(", 'g')", ")")


def for_duckdb(name: str) -> str:
    """The SELECT of ``name`` in DuckDB's dialect."""
    return TABLES[name].replace("{sha256}", "sha256").replace("{sha256_bits}", "")


def references(name: str) -> list[str]:
    """Names standing in braces in the SELECT of ``name``, in order of first use."""
    import string

    text = for_spark(name)
    found = [field for _, field, _, _ in string.Formatter().parse(text) if field]
    return list(dict.fromkeys(found))
