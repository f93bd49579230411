"""Every report and operator of the platform, run over the tables of one folder.

Each entry takes (spark, folder) and returns a DataFrame in plain column types: money as
double, times and dates as text, lists joined with ``|``.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake import schemas
from ledgerlake.operators import (
    chunking,
    dedup,
    deident,
    graph,
    intent,
    retrieval,
    rules,
    security,
    validate,
)
from ledgerlake.operators.running import row_numbers
from ledgerlake.plans import evals, gold, loans, semantic, steward
from ledgerlake.session import names_in, scratch_dir
from ledgerlake.sources import files, merge
from ledgerlake.sources.bank import Bank
from ledgerlake.streaming import attempts, ingest

#: Moments the reports are taken at: the end of the event feed and of a week of conversations.
EVENTS_AS_OF = datetime(2024, 1, 31)
LOG_AS_OF = datetime(2024, 1, 9)
REGISTRY_AS_OF = date(2024, 1, 31)
#: Key of the de-identification tokens in these reports; a deployment supplies its own.
REPORT_SECRET = "report-key"

SILVER_RULES = (
    rules.Rule("amount", "VALIDITY", "non_null"),
    rules.Rule("txn_type", "VALIDITY", "set", values=schemas.TXN_TYPES),
    rules.Rule("idempotency_key", "UNIQUENESS", "unique", severity="blocking"),
    rules.Rule("amount", "COMPLETENESS", "non_null", where="status = 'POSTED'"),
    rules.Rule("amount", "VALIDITY", "range", low=0, high=20),
    rules.Rule("counterparty_account", "COMPLETENESS", "non_null", where="txn_type = 'TRANSFER'"),
)
#: What a message tells of a transaction.
_MESSAGE_FIELDS = schemas.TRANSACTION.names[:9]
PRICES = {"small-model": (0.30, 2.50), "_default": (1.25, 10.0)}
SOURCE_PATTERNS = (("en/**/*", "english"), ("fr/*", "french"), ("de/*", "german"), ("*/*", "other"))

Report = Callable[[Bank], DataFrame]
REPORTS: dict[str, Report] = {}


def report(function: Report) -> Report:
    REPORTS[function.__name__] = function
    return function


def plain(df: DataFrame) -> DataFrame:
    """Columns in types every engine prints alike."""
    shown = []
    for field in df.schema.fields:
        c, t = F.col(f"`{field.name}`"), field.dataType
        if isinstance(t, T.DecimalType):
            c = c.cast("double")
        elif isinstance(t, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("long")
        elif isinstance(t, T.FloatType):
            c = c.cast("double")
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            c = c.cast("string")
        elif isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StringType):
            c = F.array_join(c, "|")
        shown.append(c.alias(field.name))
    return df.select(*shown)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(function: Report) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: plain(function(Bank(spark, folder)))

    return {name: bound(function) for name, function in REPORTS.items()}


# ---- gold ----


@report
def account_balance(b: Bank) -> DataFrame:
    return gold.account_balance(b.account, b.transaction)


@report
def account_summary(b: Bank) -> DataFrame:
    return gold.account_summary(b.account, b.transaction)


@report
def running_balance(b: Bank) -> DataFrame:
    return gold.running_balance(b.transaction)


@report
def overdraft_history(b: Bank) -> DataFrame:
    return gold.overdraft_history(b.transaction).withColumn("overdraft_ratio", F.round("overdraft_ratio", 6))


@report
def newest_per_account(b: Bank) -> DataFrame:
    return gold.newest_per_account(b.transaction, 5)


@report
def recent_activity(b: Bank) -> DataFrame:
    return gold.activity_since(b.transaction, EVENTS_AS_OF, 7)


@report
def newest_of_account(b: Bank) -> DataFrame:
    """The newest 50 transactions of the account with the least name."""
    least = b.transaction.agg(F.min("account_id")).first()[0]
    return gold.newest_transactions(b.transaction, least, 50)


@report
def most_recently_active(b: Bank) -> DataFrame:
    return gold.most_recently_active(gold.account_balance(b.account, b.transaction), 5)


@report
def balance_lookup(b: Bank) -> DataFrame:
    return gold.balances_of(gold.account_balance(b.account, b.transaction), b.loan_request)


@report
def summary_lookup(b: Bank) -> DataFrame:
    return gold.summaries_of(gold.account_summary(b.account, b.transaction), b.loan_request)


@report
def txn_by_account(b: Bank) -> DataFrame:
    return gold.txn_by_account(b.transaction)


@report
def balance_projection(b: Bank) -> DataFrame:
    return gold.balance_projection(gold.account_balance(b.account, b.transaction), EVENTS_AS_OF)


@report
def serving_retention(b: Bank) -> DataFrame:
    dated = b.transaction.withColumn("event_date", F.to_date("event_time"))
    return files.retained(dated, "event_date", date(2024, 2, 15), "serving").select(
        "transaction_id", "account_id", "event_date"
    )


@report
def bronze_retention(b: Bank) -> DataFrame:
    """Raw messages within 400 days of publishing."""
    dated = _messages(b).withColumn("publish_date", F.to_date("publish_time"))
    return files.retained(dated, "publish_date", date(2025, 2, 20), "bronze").select("message_id", "publish_date")


@report
def dead_letter_retention(b: Bank) -> DataFrame:
    """Rejected messages within 7 days of their failure."""
    letters = validate.dead_letters(validate.check_messages(_messages(b)), failed_at=F.col("publish_time"))
    dated = letters.withColumn("failed_date", F.to_date("failed_at"))
    return files.retained(dated, "failed_date", date(2024, 1, 27), "dead_letter").select("payload", "failed_date")


# ---- semantic layer ----


def _overdrafts(b: Bank) -> DataFrame:
    return gold.overdraft_history(b.transaction)


def _customer_360(b: Bank) -> DataFrame:
    return semantic.customer_360(b.bank_customer, b.account, b.transaction, _overdrafts(b), b.loan_request)


@report
def customer_360(b: Bank) -> DataFrame:
    return _customer_360(b)


@report
def net_amount_by_segment(b: Bank) -> DataFrame:
    return semantic.net_amount_by_segment(b.transaction, b.account, b.bank_customer)


@report
def deposits_by_segment(b: Bank) -> DataFrame:
    return semantic.deposits_by_segment(b.transaction, b.account, b.bank_customer)


@report
def daily_volume(b: Bank) -> DataFrame:
    return semantic.daily_volume(b.transaction)


@report
def monthly_fee_revenue(b: Bank) -> DataFrame:
    return semantic.monthly_fee_revenue(b.transaction)


@report
def new_customers_per_month(b: Bank) -> DataFrame:
    return semantic.new_customers_per_month(b.bank_customer)


@report
def customers_by_segment(b: Bank) -> DataFrame:
    return semantic.customers_by_segment(b.bank_customer)


@report
def chunks_by_category(b: Bank) -> DataFrame:
    return (
        b.kb_raw.groupBy("category")
        .agg(F.count(F.lit(1)).alias("chunks"))
        .orderBy(F.desc("chunks"), "category")
    )


@report
def document_catalogue(b: Bank) -> DataFrame:
    return b.kb_raw.select("doc_id", "title", "category", F.length("content").alias("chars")).orderBy("title", "doc_id")


@report
def overdraft_portfolio(b: Bank) -> DataFrame:
    return semantic.overdraft_portfolio(_overdrafts(b))


@report
def active_customers(b: Bank) -> DataFrame:
    return semantic.active_customers(b.transaction, b.account, b.bank_customer, EVENTS_AS_OF, 90)


@report
def rolling_active_customers(b: Bank) -> DataFrame:
    """Customers active in the 7 days to each day of the feed, within the error of the sketches."""
    return semantic.rolling_active_customers(b.transaction, b.account, b.bank_customer, 7, EVENTS_AS_OF.date())


@report
def most_active_accounts(b: Bank) -> DataFrame:
    return semantic.most_active_accounts(b.transaction)


@report
def highest_risk_accounts(b: Bank) -> DataFrame:
    return semantic.highest_risk_accounts(_overdrafts(b)).withColumn(
        "overdraft_ratio", F.round("overdraft_ratio", 6)
    )


@report
def most_overdrafts(b: Bank) -> DataFrame:
    return semantic.most_overdrafts(_customer_360(b))


@report
def row_counts(b: Bank) -> DataFrame:
    return semantic.row_counts({n: b.table(n) for n in ("transaction", "account", "bank_customer")})


@report
def ledger_accounts(b: Bank) -> DataFrame:
    return semantic.ledger_accounts(b.transaction)


@report
def seeded_customers(b: Bank) -> DataFrame:
    source = semantic.seeded_customers(semantic.ledger_accounts(b.transaction), EVENTS_AS_OF)
    return dedup.missing_rows(source, b.bank_customer, "customer_id")


@report
def seeded_accounts(b: Bank) -> DataFrame:
    # Counterparties count as seen in the ledger; only some have an account of their own there.
    savings = b.account.where(F.col("account_type") == "SAVINGS")
    source = semantic.seeded_accounts(semantic.ledger_accounts(b.transaction), EVENTS_AS_OF)
    return dedup.missing_rows(source, savings, "account_id")


def _merged(b: Bank, target: DataFrame, source: DataFrame, key: str, update: bool) -> DataFrame:
    """``target`` written as a table that takes upserts, ``source`` merged into it, and the table read back."""
    path = scratch_dir(b.spark, "merged")
    merge.create_table(target, path, [key])
    merge.merge(source, path, update)
    return merge.read_merged(b.spark, path)


@report
def merged_customers(b: Bank) -> DataFrame:
    """The customer table after the insert-only merge of the seeded customers."""
    source = semantic.seeded_customers(semantic.ledger_accounts(b.transaction), EVENTS_AS_OF)
    return _merged(b, b.bank_customer, source, "customer_id", update=False)


@report
def merged_silver(b: Bank) -> DataFrame:
    """Silver with its later half lost, after the backstop merged what bronze holds besides."""
    arrived = b.transaction.where(F.col("event_time") < F.lit(datetime(2024, 1, 16))).select(*_MESSAGE_FIELDS)
    return _merged(b, arrived, dedup.reconcile(b.transaction_event, arrived), "idempotency_key", update=False)


@report
def upserted_balances(b: Bank) -> DataFrame:
    """The balance projection of mid-January, brought up to date by an upsert."""
    early = b.transaction.where(F.col("event_time") < F.lit(datetime(2024, 1, 16)))
    half, whole = (gold.balance_projection(gold.account_balance(b.account, t), EVENTS_AS_OF) for t in (early, b.transaction))
    return _merged(b, half, whole, "row_key", update=True)


@report
def expired_dead_letters(b: Bank) -> DataFrame:
    """Rejected messages written by day, after the days past their keeping were deleted from disk."""
    letters = validate.dead_letters(validate.check_messages(_messages(b)), failed_at=F.col("publish_time"))
    path = scratch_dir(b.spark, "letters")
    letters.withColumn("failed_date", F.to_date("failed_at")).write.partitionBy("failed_date").parquet(path)
    merge.expire_partitions(b.spark, path, "failed_date", date(2024, 1, 27), files.RETENTION_DAYS["dead_letter"])
    return b.spark.read.parquet(path).select("payload", "failed_date")


@report
def masked_transactions(b: Bank) -> DataFrame:
    return security.masked_view(b.transaction, "transaction", {"PII_FINANCIAL": security.MASKED})


@report
def masked_customers(b: Bank) -> DataFrame:
    return security.masked_view(b.bank_customer, "customer", {"PII_DIRECT": security.MASKED})


@report
def masked_accounts(b: Bank) -> DataFrame:
    return security.masked_view(b.account, "account", {"PII_FINANCIAL": security.MASKED})


@report
def masked_credit_profiles(b: Bank) -> DataFrame:
    return security.masked_view(b.credit_profile, "credit_profile", {"CONFIDENTIAL": security.MASKED})


@report
def masked_loan_requests(b: Bank) -> DataFrame:
    """A reader cleared for amounts, but not for names."""
    grants = {"PII_FINANCIAL": security.CLEAR, "PII_DIRECT": security.MASKED}
    return security.masked_view(b.loan_request, "loan_request", grants)


@report
def posted_rows(b: Bank) -> DataFrame:
    return security.posted_rows_only(b.transaction, granted=True)


@report
def dim_customer(b: Bank) -> DataFrame:
    return security.perimeter_view(b.bank_customer, "dim_customer")


@report
def dim_account(b: Bank) -> DataFrame:
    return security.perimeter_view(b.account, "dim_account")


@report
def fact_transaction(b: Bank) -> DataFrame:
    return security.perimeter_view(b.transaction, "fact_transaction")


# ---- ingest ----


def _messages(b: Bank) -> DataFrame:
    return b.transaction_event


def _silver(b: Bank, once: bool = True) -> DataFrame:
    """Batch silver rows of the message feed."""
    sound = validate.conform(validate.check_messages(_messages(b)), "message_id", "publish_time")
    if once:
        sound = dedup.first_arrivals(sound, "idempotency_key", [F.asc("publish_time"), F.asc("message_id")])
    return validate.stamp_lineage(sound, "event-feed", F.col("publish_time")).drop("publish_time")


@report
def message_checks(b: Bank) -> DataFrame:
    return validate.check_messages(_messages(b)).select("message_id", "error")


@report
def silver_batch(b: Bank) -> DataFrame:
    return _silver(b)


@report
def silver_with_redeliveries(b: Bank) -> DataFrame:
    """With de-duplication off every sound delivery passes."""
    return _silver(b, once=False).select("message_id", "transaction_id", "idempotency_key")


@report
def silver_within_ttl(b: Bank) -> DataFrame:
    """De-duplication that forgets keys: redeliveries a minute later are dropped by the ingest's TTL, not by one of a minute."""
    sound = validate.conform(validate.check_messages(_messages(b)), "message_id", "publish_time")
    kept = [
        dedup.first_within_ttl(sound, "idempotency_key", "publish_time", "message_id", ttl).select(
            F.lit(ttl).alias("ttl_seconds"), "message_id", "idempotency_key"
        )
        for ttl in (60, ingest.DEDUP_TTL_SECONDS)
    ]
    return kept[0].unionByName(kept[1])


@report
def account_quiet_hours(b: Bank) -> DataFrame:
    """Events of an account that come at least an hour after the last one told of: one notice an hour, at most."""
    told = dedup.first_within_ttl(b.transaction, "account_id", "event_time", "transaction_id", 3600)
    return told.select("account_id", "transaction_id", "event_time")


@report
def dead_letters(b: Bank) -> DataFrame:
    checked = validate.check_messages(_messages(b))
    letters = validate.dead_letters(checked, failed_at=F.col("publish_time"))
    return letters.withColumn("envelope_error", F.get_json_object("envelope", "$.error")).drop("envelope")


@report
def reconciled(b: Bank) -> DataFrame:
    arrived = b.transaction.where(F.col("event_time") < F.lit(datetime(2024, 1, 16)))
    return dedup.reconcile(b.transaction_event, arrived)


def _event_stream(b: Bank) -> DataFrame:
    """The message feed as a stream over the folder's event file."""
    from ledgerlake.sources import banking_sql

    events = (
        b.spark.readStream.schema(b.base("events").schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(b.folder)
    )
    rows = b.spark.sql(banking_sql.for_spark("event_rows"), events=events)
    return b.spark.sql(banking_sql.for_spark("transaction_event"), event_rows=rows)


def _drained(b: Bank) -> str:
    """Folder of the tables the streaming ingest wrote from the whole feed."""
    root = scratch_dir(b.spark, "ingest")
    ingest.run_ingest(
        _event_stream(b),
        f"{root}/silver",
        f"{root}/dlq",
        f"{root}/keys",
        f"{root}/state",
        source_system="event-feed",
    ).awaitTermination()
    return root


@report
def streamed_silver(b: Bank) -> DataFrame:
    """Silver as the streaming ingest writes it, all columns but the time of the run."""
    silver = b.spark.read.parquet(f"{_drained(b)}/silver")
    return silver.drop("batch", "event_date", "ingest_time")


@report
def streamed_dead_letters(b: Bank) -> DataFrame:
    return b.spark.read.parquet(f"{_drained(b)}/dlq").select("error", "payload", "pipeline_version")


@report
def streamed_backlog(b: Bank) -> DataFrame:
    """Dead letters per window, counted by a stream over the letters as they were written, batch by batch."""
    root = scratch_dir(b.spark, "backlog")
    letters = validate.dead_letters(validate.check_messages(_messages(b)), failed_at=F.col("publish_time"))
    # In order of time, as letters come in: a file holds later ones than the file before it.
    letters.select("payload", "failed_at").repartitionByRange(4, "failed_at").write.parquet(f"{root}/letters")
    stream = b.spark.readStream.schema("payload string, failed_at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{root}/letters")
    ingest.stream_backlog(stream, f"{root}/table", f"{root}/state", late="400 days").awaitTermination()
    return merge.read_merged(b.spark, f"{root}/table")


@report
def delivery_attempts(b: Bank) -> DataFrame:
    """Attempts and outcome of every message of the feed, in eight batches, to a receiver that takes JSON only."""
    root = scratch_dir(b.spark, "attempts")
    feed = _messages(b).select("message_id", "publish_time", "data")
    # As many files as the feed fills, so that a batch's files are read by as many tasks.
    feed.repartitionByRange("publish_time").write.parquet(f"{root}/in")
    files_in = sum(n.endswith(".parquet") for n in names_in(b.spark, f"{root}/in"))
    stream = b.spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", max(1, -(-files_in // 8))).parquet(f"{root}/in")
    attempts.deliver_stream(stream, attempts.require_json, f"{root}/out", f"{root}/state").awaitTermination()
    while attempts.redeliver(b.spark, feed.schema, attempts.require_json, f"{root}/out"):
        pass
    told = attempts.outcomes(b.spark, feed.schema, f"{root}/out")
    reason = F.split_part("error", F.lit(":"), F.lit(1))
    return told.select("message_id", "attempts", "outcome", reason.alias("reason"))


@report
def streamed_progress(b: Bank) -> DataFrame:
    """Input rows of every batch of the streaming ingest, as its listener logged them, against what the batches wrote."""
    root = scratch_dir(b.spark, "progress")
    log = ingest.ProgressLog(b.spark, f"{root}/log")
    b.spark.streams.addListener(log)
    try:
        written_to = _drained(b)
        b.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        b.spark.streams.removeListener(log)
    rows = ingest.batch_lag(ingest.read_progress(b.spark, f"{root}/log")).where("input_rows > 0")
    letters = b.spark.read.parquet(f"{written_to}/dlq").groupBy("batch").agg(F.count(F.lit(1)).alias("letters"))
    return rows.join(letters, F.col("batch") == F.col("batch_id"), "left").select("batch_id", "input_rows", "over_stream_target", "letters")


@report
def streamed_bronze(b: Bank) -> DataFrame:
    root = scratch_dir(b.spark, "bronze")
    ingest.land_bronze(_event_stream(b), f"{root}/bronze", f"{root}/state").awaitTermination()
    landed = b.spark.read.parquet(f"{root}/bronze")
    return landed.select("message_id", "publish_time", "data", F.col("publish_date"))


@report
def message_lines(b: Bank) -> DataFrame:
    """The feed written as JSON lines and read back untouched, then checked."""
    path = scratch_dir(b.spark, "lines")
    b.transaction_event.select("data").write.text(path)
    return validate.check_messages(files.read_messages(b.spark, path)).select("data", "error")


@report
def streamed_lines(b: Bank) -> DataFrame:
    """The same lines through the stream reader."""
    root = scratch_dir(b.spark, "lines")
    b.transaction_event.select("data").write.text(f"{root}/in")
    checked = validate.check_messages(files.stream_messages(b.spark, f"{root}/in")).select("data", "error")
    (
        checked.writeStream.option("checkpointLocation", f"{root}/state")
        .trigger(availableNow=True)
        .start(f"{root}/out", format="parquet")
        .awaitTermination()
    )
    return b.spark.read.parquet(f"{root}/out")


@report
def clustered_days(b: Bank) -> DataFrame:
    """Transactions written in clustered day partitions; one week read back by pruning."""
    path = scratch_dir(b.spark, "clustered")
    files.write_clustered(b.transaction, path, "event_time", ["account_id", "txn_type"])
    week = files.between_days(b.spark.read.parquet(path), "event_time", datetime(2024, 1, 8), datetime(2024, 1, 15))
    return week.select("transaction_id", "account_id", "event_time", "event_date")


@report
def serving_table(b: Bank) -> DataFrame:
    """The newest-first projection written in key order and read back."""
    path = scratch_dir(b.spark, "serving")
    files.write_key_sorted(gold.txn_by_account(b.transaction), path)
    return b.spark.read.parquet(path).select("row_key", "transaction_id")


@report
def corpus_load(b: Bank) -> DataFrame:
    """The corpus written as NDJSON, loaded with its declared schema, replacing a table."""
    root = scratch_dir(b.spark, "corpus")
    b.kb_raw.write.json(f"{root}/raw")
    files.replace_table(files.load_corpus(b.spark, f"{root}/raw", schemas.KB_RAW), f"{root}/table")
    return b.spark.read.parquet(f"{root}/table").select("doc_id", "title", "category", F.sha2("content", 256).alias("hash"))


@report
def appended_audit(b: Bank) -> DataFrame:
    """Audit rows of decisions appended in two loads and read with the declared schema."""
    path = scratch_dir(b.spark, "audit")
    cut = F.lit(datetime(1998, 1, 1))
    for load in (F.col("decided_at") < cut, F.col("decided_at") >= cut):
        files.append_rows(loans.decision_audit(b.approval_decision.where(load)), path, schemas.LOAN_AUDIT_LOG)
    return files.read_table(b.spark, path, schemas.LOAN_AUDIT_LOG)


@report
def freshness(b: Bank) -> DataFrame:
    return ingest.freshness(b.transaction)


@report
def dead_letter_backlog(b: Bank) -> DataFrame:
    checked = validate.check_messages(_messages(b))
    return ingest.dead_letter_backlog(validate.dead_letters(checked, failed_at=F.col("publish_time")))


@report
def personal_data_scan(b: Bank) -> DataFrame:
    return deident.scan(b.kb_raw, "doc_id", "content")


@report
def deidentified_documents(b: Bank) -> DataFrame:
    return deident.deidentify_column(b.kb_raw, "content", "doc_id", REPORT_SECRET).select("doc_id", "content")


@report
def deidentified_sample(b: Bank) -> DataFrame:
    return deident.deidentify_column(b.kb_raw, "content", "doc_id", REPORT_SECRET, rate=0.5).select(
        "doc_id", F.sha2("content", 256).alias("content_hash")
    )


@report
def deidentified_counterparties(b: Bank) -> DataFrame:
    """Counterparties as bank account numbers, hidden in the half of the silver rows that their key picks."""
    number = F.lpad(F.regexp_extract("counterparty_account", "[0-9]+", 0), 14, "0")
    silver = _silver(b).where(F.col("counterparty_account").startswith("acct-"))
    named = silver.withColumn("counterparty_account", F.concat(F.lit("GB29NWBK"), number))
    hidden = deident.deidentify_column(named, "counterparty_account", "idempotency_key", REPORT_SECRET, rate=0.5)
    return hidden.select("transaction_id", "idempotency_key", "counterparty_account")


# ---- loans ----


def _loan_status(b: Bank) -> DataFrame:
    return loans.loan_status(b.loan_request, b.risk_assessment, b.approval_decision)


def _scored_loans(b: Bank) -> DataFrame:
    return loans.assess(loans.overdraft_input(b.loan_request, _overdrafts(b)), b.credit_profile)


@report
def loan_status(b: Bank) -> DataFrame:
    return _loan_status(b)


@report
def loan_scores(b: Bank) -> DataFrame:
    scored = _scored_loans(b)
    return scored.select(
        "loan_id",
        "dti_ratio",
        "overdraft_events",
        "risk_score",
        "recommendation",
        "reasons",
        "principal_reasons",
        F.transform(
            F.col("factors"),
            lambda f: F.concat_ws(
                ":", f["code"], f["label"], f["value"], f["points"].cast("string"), f["max_points"].cast("string"), f["impact"]
            ),
        ).alias("factors"),
        "model_version",
    )


@report
def loan_scores_by_proxy(b: Bank) -> DataFrame:
    summary = gold.account_summary(b.account, b.transaction)
    scored = loans.assess(loans.overdraft_proxy(b.loan_request, summary), b.credit_profile)
    return scored.select("loan_id", "overdraft_events", "risk_score", "recommendation")


@report
def automatic_decisions(b: Bank) -> DataFrame:
    return loans.route(_scored_loans(b)).select("loan_id", "decision", "approver", "rationale")


@report
def submission_checks(b: Bank) -> DataFrame:
    return loans.check_submissions(b.loan_request.select("loan_id", "customer_name", "amount", "term_months"))


@report
def decision_checks(b: Bank) -> DataFrame:
    offers = b.approval_decision.withColumn(
        "decision",
        F.when(F.col("decision") == "REQUEST_MODIFICATION", "COUNTEROFFER").otherwise(F.col("decision")),
    )
    return loans.check_decisions(offers).select("decision_id", "decision", "errors")


@report
def versioned_decisions(b: Bank) -> DataFrame:
    """Decisions of 1998 on, numbered after the ones already in the history."""
    cut = F.lit(datetime(1998, 1, 1))
    new = b.approval_decision.where(F.col("decided_at") >= cut).drop("version")
    history = b.approval_decision.where(F.col("decided_at") < cut)
    return loans.version_decisions(new, history).select(
        "decision_id", "loan_id", "version", "decision", "status_after"
    )


@report
def audit_trail(b: Bank) -> DataFrame:
    """Every loan's audit rows with their place in its trail."""
    return row_numbers(b.loan_audit_log, "loan_id", "event_time", "audit_id", out="step")


@report
def newest_loans(b: Bank) -> DataFrame:
    return loans.list_loans(_loan_status(b), "PENDING_APPROVAL").select("loan_id", "status", "submitted_at", "risk_score")


@report
def outcome_breakdown(b: Bank) -> DataFrame:
    return loans.outcome_breakdown(_loan_status(b))


@report
def average_risk(b: Bank) -> DataFrame:
    return loans.average_risk(_loan_status(b))


@report
def approved_exposure(b: Bank) -> DataFrame:
    return loans.approved_exposure(_loan_status(b))


@report
def pending_by_segment(b: Bank) -> DataFrame:
    return loans.pending_by_segment(b.loan_request, b.account, b.bank_customer)


@report
def steward_status(b: Bank) -> DataFrame:
    return steward.steward_status(b.steward_run, b.steward_decision)


@report
def steward_summary(b: Bank) -> DataFrame:
    return steward.run_summary(b.steward_decision)


@report
def findings_history(b: Bank) -> DataFrame:
    """Parts with low retail price as findings, with the latest step taken on them."""
    found = b.base("part").select(
        F.concat(F.lit("Remediate part "), F.col("p_partkey").cast("string")).alias("label"), "p_brand"
    )
    return steward.findings_with_history(found, b.steward_decision)


# ---- quality ----


def _scan(b: Bank) -> DataFrame:
    return rules.scan(_silver(b, once=False), "silver-txn-quality", "silver.transaction", SILVER_RULES)


@report
def quality_scan(b: Bank) -> DataFrame:
    return _scan(b)


@report
def quality_score(b: Bank) -> DataFrame:
    return rules.score(_scan(b), F.lit(EVENTS_AS_OF)).withColumn("score", F.round("score", 6))


@report
def remediation(b: Bank) -> DataFrame:
    proposed = rules.propose(rules.assess(rules.findings(_scan(b))))
    return proposed.select(
        "finding_id", "label", F.round("fail_ratio", 6).alias("fail_ratio"), "confidence", "reason", "proposal"
    )


@report
def referential_integrity(b: Bank) -> DataFrame:
    checks = (
        rules.referential_result(b.transaction, "account_id", b.account, "account_id", "txn-account"),
        rules.referential_result(b.account, "customer_id", b.bank_customer, "customer_id", "account-customer"),
        rules.referential_result(b.risk_assessment, "loan_id", b.loan_request, "loan_id", "risk-loan"),
        rules.referential_result(b.kb_raw, "doc_id", b.kb_vector, "doc_id", "chunk-vector"),
    )
    out = checks[0]
    for more in checks[1:]:
        out = out.unionByName(more)
    return out


@report
def orphaned_chunks(b: Bank) -> DataFrame:
    return rules.orphans(b.kb_raw.select("doc_id", "title"), "doc_id", b.kb_vector, "doc_id")


@report
def column_profile(b: Bank) -> DataFrame:
    profiled = rules.profile(
        b.transaction, ["txn_type", "status", "account_id", "counterparty_account", "amount", "transaction_id"]
    )
    return profiled.withColumn("null_ratio", F.round("null_ratio", 6)).withColumn(
        "distinct_ratio", F.round("distinct_ratio", 6)
    )


@report
def quick_column_profile(b: Bank) -> DataFrame:
    """The exact part of the one-pass profile; its approximate counts are held to a bound in the tests."""
    quick = rules.quick_profile(b.transaction, ["txn_type", "status", "account_id", "counterparty_account"])
    return quick.select("column", "rows", "nulls", "min_value", "max_value")


@report
def contract_conformance(b: Bank) -> DataFrame:
    tables = {
        "deposit-transactions": b.transaction,
        "customer-master": b.bank_customer,
        "overdraft-history": _overdrafts(b),
        "loan-master": _loan_status(b),
        "bank-knowledge-base": retrieval.attach_vectors(b.kb_raw, b.kb_vector),
    }
    checks = [
        rules.contract_conformance(df, name, schemas.CONTRACT_COLUMNS[name]) for name, df in tables.items()
    ]
    out = checks[0]
    for more in checks[1:]:
        out = out.unionByName(more)
    return out


def _contract_scans(b: Bank) -> DataFrame:
    tables = {
        "deposit-transactions": b.transaction,
        "customer-master": b.bank_customer,
        "loan-master": _loan_status(b),
        "overdraft-history": _overdrafts(b),
        "bank-knowledge-base": b.kb_raw,
    }
    scans = [rules.scan(df, name, name, rules.CONTRACT_RULES[name]) for name, df in tables.items()]
    out = scans[0]
    for more in scans[1:]:
        out = out.unionByName(more)
    return out.drop("failing_rows_query")


@report
def contract_quality(b: Bank) -> DataFrame:
    """Quality rules, allowed values and platform rules of every contract's table."""
    return _contract_scans(b)


@report
def answerable_assets(b: Bank) -> DataFrame:
    integrity = referential_integrity(b)
    results = integrity.unionByName(_scan(b).select(*integrity.columns)).unionByName(
        _contract_scans(b).select(*integrity.columns)
    )
    assets = b.spark.createDataFrame(
        [
            ("transaction", "silver-txn-quality"),
            ("transaction", "txn-account"),
            ("transaction", "deposit-transactions"),
            ("customer", "customer-master"),
            ("loan", "loan-master"),
            ("overdraft", "overdraft-history"),
            ("knowledge", "bank-knowledge-base"),
            ("account", "account-customer"),
            ("knowledge", "chunk-vector"),
            ("loan", "risk-loan"),
            ("unscanned", "no-such-scan"),
        ],
        "asset string, scan string",
    )
    return rules.gate(assets, results)


@report
def recertification(b: Bank) -> DataFrame:
    return evals.registry_by_due_date(rules.recertification(b.agent_registry, REGISTRY_AS_OF))


@report
def quarantined(b: Bank) -> DataFrame:
    _, failing = rules.quarantine(_silver(b, once=False), SILVER_RULES)
    return failing.select("message_id", "transaction_id", "idempotency_key", "amount", "failed_rules")


@report
def quarantine_passed(b: Bank) -> DataFrame:
    sound, _ = rules.quarantine(_silver(b, once=False), SILVER_RULES)
    return sound.select("message_id", "transaction_id", "amount")


@report
def quarantine_table(b: Bank) -> DataFrame:
    """The side table of failing rows as it was written, a load of TRANSFERs and a load of all others."""
    path = scratch_dir(b.spark, "quarantine")
    silver = _silver(b)
    for load in (F.col("txn_type") == "TRANSFER", F.col("txn_type") != "TRANSFER"):
        rules.quarantine_to(silver.where(load), SILVER_RULES, path)
    return b.spark.read.parquet(path).select("message_id", "transaction_id", "amount", "failed_rules")


# ---- retrieval ----


def _chunks(b: Bank) -> DataFrame:
    return retrieval.attach_vectors(b.kb_raw, b.kb_vector)


@report
def sparse_search(b: Bank) -> DataFrame:
    return retrieval.bm25(b.kb_query, b.kb_raw, 8).withColumn("score", F.round("score", 6))


@report
def dense_search(b: Bank) -> DataFrame:
    return retrieval.nearest(b.kb_query_vector, b.kb_vector, 8).withColumn("distance", F.round("distance", 6))


@report
def hybrid_search(b: Bank) -> DataFrame:
    found = retrieval.hybrid_search(b.kb_query, b.kb_query_vector, b.kb_raw, b.kb_vector)
    return found.select(
        "query_id", "doc_id", "title", "category", F.round("rrf", 9).alias("rrf"), "in_dense", "in_sparse", "retriever", "rnk"
    )


@report
def dense_only_search(b: Bank) -> DataFrame:
    """Fusion with no sparse results still answers every query."""
    dense = retrieval.nearest(b.kb_query_vector, b.kb_vector, 8)
    nothing = dense.where(F.lit(False))
    return retrieval.fuse(dense, nothing, 8).select("query_id", "doc_id", "retriever", "rnk")


@report
def reranked_search(b: Bank) -> DataFrame:
    dense = retrieval.nearest(b.kb_query_vector, b.kb_vector, 8).select("query_id", "doc_id", "rnk")
    replies = b.rerank_reply.select(F.concat(F.lit("q-"), "query_id").alias("query_id"), "reply")
    return retrieval.rerank(dense, replies)


@report
def document_chunks(b: Bank) -> DataFrame:
    pages = b.page_markdown.withColumn("category", F.lit("page"))
    return chunking.chunk_markdown(pages)


@report
def classified_sources(b: Bank) -> DataFrame:
    """Pages by the path of their address; the first matching pattern names the category."""
    paths = b.base("pages").select(
        "page_id", F.regexp_extract("url", "^https?://[^/]+/([^?#]*)", 1).alias("path")
    )
    return chunking.classify_sources(paths, SOURCE_PATTERNS, skip=("en/1", "fr/1"))


@report
def embedded_chunks(b: Bank) -> DataFrame:
    return _chunks(b).select(
        "doc_id", "title", "category", F.size("embedding").alias("dimensions"), F.length("content").alias("chars")
    )


@report
def chunks_to_embed(b: Bank) -> DataFrame:
    """Documents without a vector, and toxic ones whose text has changed since they were embedded."""
    toxic = b.base("labels").select(F.col("doc_id").cast("string").alias("doc_id"), "toxic")
    embedded = (
        b.kb_raw.join(b.kb_vector.select("doc_id"), "doc_id")
        .join(toxic, "doc_id", "left")
        .select(
            "doc_id",
            F.sha2(F.when(F.col("toxic") == 1, F.concat("content", F.lit(" "))).otherwise(F.col("content")), 256).alias(
                "content_hash"
            ),
        )
    )
    return retrieval.needs_embedding(b.kb_raw, embedded).select("doc_id", "content_hash")


@report
def question_intents(b: Bank) -> DataFrame:
    questions = b.conversation_log.select("conversation_id", "question")
    return intent.score_intents(questions).drop("question")


@report
def catalog_search(b: Bank) -> DataFrame:
    found = intent.catalog_search(b.catalog_entry, "red", "prod")
    return found.select("entry_name", "display_name", "resource", "entry_type", "governed", "display_group")


# ---- graph ----


@report
def edge_counts(b: Bank) -> DataFrame:
    return graph.edge_counts(b.account, b.transaction, b.loan_request)


@report
def deposits_by_owner_segment(b: Bank) -> DataFrame:
    return graph.deposits_by_owner_segment(b.bank_customer, b.account, b.transaction)


@report
def join_cardinality(b: Bank) -> DataFrame:
    return graph.cardinality_check(
        {
            "dim_account": security.perimeter_view(b.account, "dim_account"),
            "dim_customer": security.perimeter_view(b.bank_customer, "dim_customer"),
            "fact_transaction": security.perimeter_view(b.transaction, "fact_transaction"),
            "overdraft_history": _overdrafts(b),
            "customer_360": _customer_360(b),
        }
    )


@report
def transfer_edges(b: Bank) -> DataFrame:
    return graph.transfers(b.transaction)


@report
def transfer_walks(b: Bank) -> DataFrame:
    return graph.walk_counts(graph.transfers(b.transaction), 3)


@report
def hops_from_savings(b: Bank) -> DataFrame:
    """Accounts money from savings accounts reaches in up to three transfers."""
    seeds = b.account.where(F.col("account_type") == "SAVINGS").select(F.col("account_id").alias("node"))
    return graph.hops_from(seeds, graph.transfers(b.transaction), 3)


# ---- evaluation ----


def _scores(b: Bank) -> DataFrame:
    return evals.composite_scores(b.judge_verdict)


@report
def logged_turns(b: Bank) -> DataFrame:
    return evals.log_rows(b.conversation_log).select("conversation_id", "question", "answer", "latency_ms")


@report
def appended_turns(b: Bank) -> DataFrame:
    """Turns appended to the log by channel, cut to its column widths, and read with the declared schema."""
    path = scratch_dir(b.spark, "turns")
    widths = {"question": evals.QUESTION_WIDTH, "answer": evals.ANSWER_WIDTH}
    logged = evals.log_rows(b.conversation_log, widths)
    for load in (F.col("channel") == "kb", ~F.col("channel").eqNullSafe("kb")):
        files.append_rows(logged.where(load), path, schemas.CONVERSATION_LOG)
    return files.read_table(b.spark, path, schemas.CONVERSATION_LOG)


@report
def rolling_latency(b: Bank) -> DataFrame:
    """Latencies of the 7 days to each day of the log, within the error of the sketches."""
    return evals.rolling_latency(b.conversation_log, LOG_AS_OF.date())


@report
def log_page(b: Bank) -> DataFrame:
    page = evals.log_page(b.conversation_log, _scores(b), LOG_AS_OF, 168, limit=20, offset=10)
    return page.select("conversation_id", "ts", "persona", "question", "answer", "overall", "groundedness", "safety")


@report
def log_total(b: Bank) -> DataFrame:
    return evals.log_total(b.conversation_log, LOG_AS_OF, 168)


@report
def unscored_turns(b: Bank) -> DataFrame:
    found = evals.unscored_turns(b.conversation_log, _scores(b), LOG_AS_OF, limit=None)
    return found.select("conversation_id", "ts", "channel")


@report
def composite_scores(b: Bank) -> DataFrame:
    return _scores(b)


@report
def eval_summary(b: Bank) -> DataFrame:
    return evals.eval_summary(_scores(b), b.conversation_log, LOG_AS_OF)


def _grounding_turns(b: Bank) -> DataFrame:
    from ledgerlake.functions.text import numbers

    return b.conversation_log.where(F.col("answer").isNotNull()).select(
        "conversation_id", "answer", numbers(F.col("question")).alias("facts"), F.col("conversation_id").alias("account_id")
    )


@report
def grounding(b: Bank) -> DataFrame:
    return evals.grounding(_grounding_turns(b)).select("conversation_id", "unsupported", "grounded")


def _canary_turns(b: Bank) -> DataFrame:
    return evals.score_turns(
        b.conversation_log.select(
            "conversation_id",
            "persona",
            "channel",
            "answer",
            F.when(F.col("channel") != "kb", F.col("channel")).alias("expected_tool"),
            (F.col("persona") == "customer").alias("expected_grounded"),
            "account_id",
        )
    )


@report
def turn_scores(b: Bank) -> DataFrame:
    return _canary_turns(b).select("conversation_id", "tool_ok", "grounded", "hallucinated")


@report
def canary_metrics(b: Bank) -> DataFrame:
    return evals.run_metrics(_canary_turns(b), "channel")


@report
def evaluation_gate(b: Bank) -> DataFrame:
    """Every metric of every channel against its floor or ceiling."""
    return evals.evaluation_gate(evals.run_metrics(_canary_turns(b), "channel"), "channel")


@report
def canary_regressions(b: Bank) -> DataFrame:
    """Analyst turns of each channel against its customer turns."""
    metrics = evals.run_metrics(_canary_turns(b), "channel", "persona")
    return evals.regressions(
        metrics.where(F.col("persona") == "analyst"), metrics.where(F.col("persona") == "customer"), "channel"
    ).select("channel", "metric", "baseline", "current", F.round("delta", 6).alias("delta"), "message")


@report
def version_changes(b: Bank) -> DataFrame:
    return b.conversation_log.select(
        "conversation_id",
        evals.version_change(F.col("model_served"), F.concat(F.lit("assistant-"), "persona")).alias("change"),
    )


@report
def unit_economics(b: Bank) -> DataFrame:
    return evals.unit_economics(b.gateway_request, _scores(b), LOG_AS_OF)


@report
def unit_economics_by_workload(b: Bank) -> DataFrame:
    return evals.unit_economics(b.gateway_request, _scores(b), LOG_AS_OF, by_model=False)


@report
def priced_economics(b: Bank) -> DataFrame:
    economics = evals.unit_economics(b.gateway_request, _scores(b), LOG_AS_OF)
    priced = evals.priced(economics, PRICES)
    return priced.withColumn("cost", F.round("cost", 6)).withColumn(
        "cost_per_success", F.round("cost_per_success", 6)
    )


@report
def recommendation_accuracy(b: Bank) -> DataFrame:
    labels = loans.latest_version(b.risk_assessment, F.col("recommendation").alias("expected"))
    results = _scored_loans(b).select("loan_id", "recommendation").join(labels, "loan_id")
    return evals.label_accuracy(results, "recommendation", "expected", "approval_recommendation_accuracy")


@report
def consequential_actions(b: Bank) -> DataFrame:
    return evals.consequential_actions(b.agent_action_log, EVENTS_AS_OF)


@report
def unauthorized_calls(b: Bank) -> DataFrame:
    return evals.unauthorized_calls(b.agent_action_log)
