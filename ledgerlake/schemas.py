"""Declared table schemas, column tags, code sets and data contracts."""

from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values: code sets, formats and versions of the data model ----
TXN_TYPES = ("DEPOSIT", "WITHDRAWAL", "TRANSFER", "FEE")
TXN_STATUSES = ("POSTED", "PENDING", "REJECTED")
REQUIRED_MESSAGE_FIELDS = (
    "transaction_id",
    "idempotency_key",
    "account_id",
    "txn_type",
    "amount",
    "currency",
    "status",
    "event_time",
)
AMOUNT_FORMAT = r"^[0-9]+(\.[0-9]{1,2})?$"
CURRENCY_FORMAT = r"^[A-Z]{3}$"
PIPELINE_VERSION = "1.0.0"
RISK_MODEL_VERSION = "risk-1.0.0"
LOAN_DECISIONS = ("APPROVE", "REJECT", "REQUEST_MODIFICATION", "COUNTEROFFER")

MONEY = T.DecimalType(38, 9)


def _struct(*cols: tuple) -> T.StructType:
    """Fields from (name, type) pairs, or (name, type, True) where null is allowed."""
    return T.StructType([T.StructField(c[0], c[1], len(c) > 2 and c[2]) for c in cols])


_S, _L, _D, _TS, _B = T.StringType(), T.LongType(), T.DoubleType(), T.TimestampType(), T.BooleanType()

# ---- fixed values: columns and types of the tables ----
MESSAGE = T.StructType(
    [T.StructField(f, _S) for f in (*REQUIRED_MESSAGE_FIELDS, "counterparty_account")]
)

TRANSACTION_EVENT = _struct(
    ("subscription_name", _S, True),
    ("message_id", _S, True),
    ("publish_time", _TS, True),
    ("data", _S, True),
    ("attributes", _S, True),
)
TRANSACTION = _struct(
    ("transaction_id", _S),
    ("idempotency_key", _S),
    ("account_id", _S),
    ("txn_type", _S),
    ("amount", MONEY),
    ("currency", _S),
    ("counterparty_account", _S, True),
    ("status", _S),
    ("event_time", _TS),
    ("ingest_time", _TS),
    ("source_system", _S, True),
    ("pipeline_version", _S, True),
)
CUSTOMER = _struct(
    ("customer_id", _S),
    ("customer_natural_key", _S),
    ("full_name", _S, True),
    ("email", _S, True),
    ("segment", _S, True),
    ("created_at", _TS),
    ("ingest_time", _TS),
    ("pipeline_version", _S, True),
)
ACCOUNT = _struct(
    ("account_id", _S),
    ("account_number", _S),
    ("customer_id", _S),
    ("account_type", _S),
    ("currency", _S),
    ("status", _S),
    ("opened_at", _TS),
    ("ingest_time", _TS),
    ("pipeline_version", _S, True),
)
KB_RAW = _struct(("doc_id", _S), ("title", _S), ("category", _S, True), ("content", _S))
PLATFORM_RAW = _struct(
    ("doc_id", _S), ("title", _S), ("category", _S, True), ("source_path", _S), ("content", _S)
)
LOAN_REQUEST = _struct(
    ("loan_id", _S),
    ("customer_name", _S),
    ("account_id", _S, True),
    ("amount", MONEY),
    ("term_months", _L),
    ("status", _S),
    ("submitted_at", _TS),
    ("updated_at", _TS),
)
CREDIT_PROFILE = _struct(
    ("profile_id", _S),
    ("loan_id", _S),
    ("credit_score", _L),
    ("annual_income", MONEY, True),
    ("existing_debt", MONEY, True),
    ("dti_ratio", _D, True),
    ("generated_at", _TS),
)
RISK_ASSESSMENT = _struct(
    ("assessment_id", _S),
    ("loan_id", _S),
    ("version", _L),
    ("risk_score", _L),
    ("recommendation", _S),
    ("overdraft_events", _L, True),
    ("reasons", _S, True),
    ("factors", _S, True),
    ("model_version", _S, True),
    ("created_at", _TS),
)
APPROVAL_DECISION = _struct(
    ("decision_id", _S),
    ("loan_id", _S),
    ("version", _L),
    ("decision", _S),
    ("counteroffer_amount", MONEY, True),
    ("approver", _S),
    ("rationale", _S, True),
    ("decided_at", _TS),
)
LOAN_AUDIT_LOG = _struct(
    ("audit_id", _S),
    ("loan_id", _S, True),
    ("actor", _S),
    ("action", _S),
    ("detail", _S, True),
    ("event_time", _TS),
)
STEWARD_RUN = _struct(("run_id", _S), ("goal", _S), ("status", _S), ("started_at", _TS), ("updated_at", _TS))
STEWARD_DECISION = _struct(
    ("decision_id", _S),
    ("run_id", _S),
    ("step_index", _L),
    ("task", _S),
    ("result", _S, True),
    ("eval_score", _D),
    ("eval_reason", _S, True),
    ("resolution", _S, True),
    ("approver", _S, True),
    ("note", _S, True),
    ("decided_at", _TS),
)
CONVERSATION_LOG = _struct(
    ("conversation_id", _S),
    ("ts", _TS),
    ("persona", _S, True),
    ("channel", _S, True),
    ("question", _S, True),
    ("answer", _S, True),
    ("context", _S, True),
    ("latency_ms", _L, True),
    ("model_requested", _S, True),
    ("model_served", _S, True),
)
CONVERSATION_SCORES = _struct(
    ("conversation_id", _S),
    ("scored_at", _TS),
    ("channel", _S, True),
    ("groundedness", _D, True),
    ("instruction_following", _D, True),
    ("coherence", _D, True),
    ("safety", _D, True),
    ("overall", _D, True),
    ("rationale", _S, True),
    ("model_version", _S, True),
)
AGENT_ACTION_LOG = _struct(
    ("ts", _TS),
    ("agent_id", _S),
    ("service_account", _S),
    ("owner", _S),
    ("tool", _S, True),
    ("authorized", _B),
    ("consequential", _B, True),
    ("hitl_approver", _S, True),
    ("session_id", _S, True),
    ("model_version", _S, True),
    ("outcome", _S, True),
)

# ---- fixed values: classification, perimeter, join model and contracts ----
#: Classification of protected columns: (table, column) -> tag.
COLUMN_TAGS = {
    ("customer", "full_name"): "PII_DIRECT",
    ("customer", "email"): "PII_DIRECT",
    ("account", "account_number"): "PII_FINANCIAL",
    ("transaction", "amount"): "PII_FINANCIAL",
    ("transaction", "counterparty_account"): "PII_FINANCIAL",
    ("credit_profile", "credit_score"): "CONFIDENTIAL",
    ("credit_profile", "annual_income"): "CONFIDENTIAL",
    ("loan_request", "customer_name"): "PII_DIRECT",
    ("loan_request", "amount"): "PII_FINANCIAL",
}

#: Columns an analyst may see, per view of the semantic perimeter.
PERIMETER = {
    "dim_customer": ("customer_id", "segment", "created_at"),
    "dim_account": ("account_id", "customer_id", "account_type", "currency", "status", "opened_at"),
    "fact_transaction": (
        "transaction_id",
        "account_id",
        "txn_type",
        "amount",
        "currency",
        "status",
        "event_time",
    ),
}

#: The join model as data: from_table, from_column, to_table, to_column, relationship, cardinality.
RELATIONSHIPS = (
    ("dim_account", "customer_id", "dim_customer", "customer_id", "Account BELONGS_TO Customer", "many-to-one"),
    ("fact_transaction", "account_id", "dim_account", "account_id", "Transaction OCCURS_ON Account", "many-to-one"),
    (
        "overdraft_history",
        "account_id",
        "dim_account",
        "account_id",
        "OverdraftProfile SUMMARIZES Account",
        "one-to-one",
    ),
    ("customer_360", "customer_id", "dim_customer", "customer_id", "Customer360 ROLLS_UP Customer", "one-to-one"),
)

#: Declared columns per contract: (name, type family, required).
CONTRACT_COLUMNS = {
    "deposit-transactions": (
        ("idempotency_key", "STRING", True),
        ("account_id", "STRING", True),
        ("txn_type", "STRING", True),
        ("amount", "NUMERIC", True),
        ("currency", "STRING", True),
        ("counterparty_account", "STRING", False),
        ("status", "STRING", True),
        ("event_time", "TIMESTAMP", True),
        ("ingest_time", "TIMESTAMP", True),
    ),
    "customer-master": (
        ("customer_id", "STRING", True),
        ("customer_natural_key", "STRING", True),
        ("full_name", "STRING", False),
        ("email", "STRING", False),
        ("segment", "STRING", False),
        ("created_at", "TIMESTAMP", True),
        ("ingest_time", "TIMESTAMP", True),
    ),
    "overdraft-history": (
        ("account_id", "STRING", True),
        ("overdraft_events", "INT64", True),
        ("lowest_balance", "NUMERIC", True),
        ("overdraft_ratio", "FLOAT64", True),
    ),
    "loan-master": (
        ("loan_id", "STRING", True),
        ("customer_name", "STRING", True),
        ("amount", "NUMERIC", True),
        ("term_months", "INT64", True),
        ("status", "STRING", True),
        ("submitted_at", "TIMESTAMP", True),
        ("updated_at", "TIMESTAMP", True),
        ("risk_score", "INT64", False),
        ("recommendation", "STRING", False),
        ("final_decision", "STRING", False),
        ("counteroffer_amount", "NUMERIC", False),
        ("approver", "STRING", False),
        ("decided_at", "TIMESTAMP", False),
    ),
    "bank-knowledge-base": (
        ("doc_id", "STRING", True),
        ("title", "STRING", True),
        ("category", "STRING", False),
        ("content", "STRING", True),
        ("embedding", "ARRAY", True),
    ),
}
