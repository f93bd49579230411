import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from ledgerlake import schemas
from ledgerlake.operators import dedup, deident
from ledgerlake.operators.validate import check_messages, conform, dead_letters, event_timestamp, stamp_lineage
from ledgerlake.session import names_in, scratch_dir
from ledgerlake.sources import files, merge
from ledgerlake.streaming import ingest

SOUND = {
    "transaction_id": "t-1",
    "idempotency_key": "key-0001",
    "account_id": "acct-001",
    "txn_type": "DEPOSIT",
    "amount": "125.50",
    "currency": "USD",
    "counterparty_account": "",
    "status": "POSTED",
    "event_time": "2024-03-01T12:00:00Z",
}


def message(**changes):
    fields = {**SOUND, **changes}
    return json.dumps({k: v for k, v in fields.items() if v is not Ellipsis})


def errors(spark, payloads):
    df = spark.createDataFrame(list(enumerate(payloads)), "i int, data string")
    return [r.error for r in check_messages(df).orderBy("i").collect()]


def test_sound_message_conforms(spark):
    df = spark.createDataFrame([(message(),)], "data string")
    row = stamp_lineage(conform(check_messages(df))).first()
    assert float(row.amount) == 125.5
    assert row.counterparty_account == ""
    assert row.event_time == datetime(2024, 3, 1, 12)
    assert (row.source_system, row.pipeline_version) == ("synthetic-generator", "1.0.0")
    assert row.ingest_time is not None


@pytest.mark.parametrize(
    "payload, reason",
    [
        (message(amount=...), "missing required fields: ['amount']"),
        (message(amount=None), "missing required fields: ['amount']"),
        (message(account_id="", status=...), "missing required fields: ['account_id', 'status']"),
        (message(txn_type="BRIBE"), "invalid txn_type: BRIBE"),
        (message(status="HACKED"), "invalid status: HACKED"),
        (message(amount="12.345"), "invalid amount format: 12.345"),
        (message(amount="-5"), "invalid amount format: -5"),
        (message(currency="usd"), "invalid currency: usd"),
        (message(event_time="not-a-date"), "invalid event_time: not-a-date"),
        (message(event_time="12:30"), "invalid event_time: 12:30"),
        (message(event_time="2024"), "invalid event_time: 2024"),
        (message(event_time="2024-13-01"), "invalid event_time: 2024-13-01"),
        (message(txn_type="BRIBE", status="HACKED"), "invalid txn_type: BRIBE"),
        ("garbage", "unparseable payload"),
        ("", "unparseable payload"),
        ('{"a": 1', "unparseable payload"),
        (message() + " tail", "unparseable payload"),
        (message() + message(), "unparseable payload"),
        (message() + "," + message(), "unparseable payload"),
        ("[1]", "payload is not a JSON object"),
        ("[" + message() + "]", "payload is not a JSON object"),
        ("3", "payload is not a JSON object"),
        ('"text"', "payload is not a JSON object"),
        ("null", "payload is not a JSON object"),
        ("{}", "missing required fields: ['transaction_id', 'idempotency_key', 'account_id', 'txn_type', "
               "'amount', 'currency', 'status', 'event_time']"),
        (message(amount=12.5), None),
        (message(amount="7\n"), None),
        (message(event_time="2024-03-01"), None),
        (message(event_time="20240301T120000"), None),
        (message(event_time="2024-03-01 12:00:00.123456+02:00"), None),
        ("  " + message() + " \n", None),
        (message(extra={"nested": [1]}), None),
    ],
)
def test_first_failure_names_the_reason(spark, payload, reason):
    assert errors(spark, [payload]) == [reason]


def test_event_times(spark):
    df = spark.createDataFrame(
        [("2024-03-01T12:00:00+02:00",), ("20240301",), ("20240301T235959",), ("T12",)], "t string"
    )
    out = [r[0] for r in df.select(event_timestamp(F.col("t"))).collect()]
    assert out == [datetime(2024, 3, 1, 10), datetime(2024, 3, 1), datetime(2024, 3, 1, 23, 59, 59), None]


def test_undecodable_bytes_are_a_dead_letter(spark):
    df = spark.sql("select cast(x'FF7B7D' as string) as data")
    letter = dead_letters(check_messages(df)).first()
    assert letter.error == "unparseable payload"
    assert letter.payload == "�{}"


def test_envelope_is_json(spark):
    df = spark.createDataFrame([("garbage",)], "data string")
    letter = json.loads(dead_letters(check_messages(df)).first().envelope)
    assert (letter["error"], letter["payload"], letter["pipeline_version"]) == ("unparseable payload", "garbage", "1.0.0")
    assert letter["failed_at"]


def keyed(spark, keys):
    rows = [(k, i) for i, k in enumerate(keys)]
    return spark.createDataFrame(rows, "idempotency_key string, arrival int")


def test_first_arrival_wins(spark):
    out = dedup.first_arrivals(keyed(spark, ["k1", "k1", "k1", "k2"]), "idempotency_key", [F.asc("arrival")])
    assert sorted(map(tuple, out.collect())) == [("k1", 0), ("k2", 3)]


def test_upsert_inserts_only_missing_rows(spark):
    target = spark.createDataFrame([("a", 1)], "id string, v int")
    source = spark.createDataFrame([("a", 2), ("b", 3)], "id string, v int")
    assert [tuple(r) for r in dedup.missing_rows(source, target, "id").collect()] == [("b", 3)]


def test_deidentification(spark):
    texts = [
        ("1", "mail jo.doe+x@mail.example.com now"),
        ("2", "call +1 (555) 555-0101 or 555-123-4567"),
        ("3", "ssn 123-45-6789 987-65-4321 end"),
        ("4", "card 4111 1111 1111 1111, not 4111 1111 1111 1112"),
        ("5", "iban GB29NWBK60161331926819 é"),
        ("6", "nothing here 12"),
    ]
    df = spark.createDataFrame(texts, "id string, text string")
    out = {r.id: r.text for r in deident.deidentify_column(df, "text", "id", "s").collect()}
    assert out["1"] == "mail " + "#" * 25 + " now"
    assert out["2"] == "call " + "#" * 17 + " or " + "#" * 12
    assert out["3"].count("LEDGER_TOKEN(") == 2 and out["3"].startswith("ssn ") and out["3"].endswith(" end")
    assert out["4"].count("LEDGER_TOKEN(") == 1 and out["4"].endswith("not 4111 1111 1111 1112")
    assert out["5"].startswith("iban LEDGER_TOKEN(") and out["5"].endswith(") é")
    assert out["6"] == "nothing here 12"
    found = {(r.id, r.info_type): r.findings for r in deident.scan(df, "id", "text").collect()}
    assert found == {
        ("1", "EMAIL_ADDRESS"): 1,
        ("2", "PHONE_NUMBER"): 2,
        ("3", "US_SOCIAL_SECURITY_NUMBER"): 2,
        ("4", "CREDIT_CARD_NUMBER"): 1,
        ("5", "IBAN_CODE"): 1,
    }


def test_tokens_are_joinable_and_keyed(spark):
    df = spark.createDataFrame([("1", "123-45-6789"), ("2", "123-45-6789")], "id string, text string")
    one = {r.text for r in deident.deidentify_column(df, "text", "id", "a").collect()}
    two = {r.text for r in deident.deidentify_column(df, "text", "id", "b").collect()}
    assert len(one) == 1 and one != two


def test_sampled_deidentification_keeps_every_row(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("id"), F.lit("123-45-6789").alias("text"))
    out = deident.deidentify_column(df, "text", "id", "s", rate=0.25)
    assert out.count() == 2000
    hidden = out.where(F.col("text") != "123-45-6789").count()
    assert 400 < hidden < 600
    assert deident.deidentify_column(df, "text", "id", "s", rate=0.0).where("text <> '123-45-6789'").count() == 0


def feed(spark, folder, name, rows):
    """One file of the stream's source folder."""
    df = spark.createDataFrame(
        [(f"m{i}", datetime.fromtimestamp(t, timezone.utc), d) for i, t, d in rows],
        "message_id string, publish_time timestamp, data string",
    )
    df.coalesce(1).write.mode("append").parquet(folder)


def source(spark, folder):
    schema = "message_id string, publish_time timestamp, data string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run(spark, root, **options):
    query = ingest.run_ingest(
        source(spark, f"{root}/in"), f"{root}/silver", f"{root}/dlq", f"{root}/keys", f"{root}/state", **options
    )
    query.awaitTermination()


def test_stream_dedups_across_batches_and_restarts(spark):
    root = scratch_dir(spark, "test")
    feed(spark, f"{root}/in", "a", [(1, 1000, message()), (2, 1001, message()), (3, 1002, "garbage")])
    run(spark, root)
    feed(spark, f"{root}/in", "b", [(4, 1500, message()), (5, 1501, message(idempotency_key="key-0002"))])
    run(spark, root)
    silver = spark.read.parquet(f"{root}/silver")
    assert sorted(r.idempotency_key for r in silver.collect()) == ["key-0001", "key-0002"]
    assert silver.select(*schemas.TRANSACTION.names).schema.simpleString() == schemas.TRANSACTION.simpleString()
    assert spark.read.parquet(f"{root}/dlq").count() == 1


def test_stream_dedup_of_a_hot_key(spark):
    """A third of the feed is one key, spread over several files and two runs."""
    root = scratch_dir(spark, "test")
    rows = [(i, 1000 + i, message(idempotency_key="hot-0001" if i % 3 == 0 else f"key-{i:05d}")) for i in range(300)]
    for start in range(0, 200, 40):
        feed(spark, f"{root}/in", "a", rows[start : start + 40])
    run(spark, root)
    feed(spark, f"{root}/in", "b", rows[200:])
    run(spark, root)
    keys = [r.idempotency_key for r in spark.read.parquet(f"{root}/silver").collect()]
    assert len(keys) == len(set(keys)) == 201


def test_late_messages_are_kept(spark):
    """Sound and rejected messages published hours before earlier batches reach their tables once."""
    root = scratch_dir(spark, "test")
    hour = 3600
    for name, at, key in (("a", 12 * hour, "key-000a"), ("b", 12 * hour + 60, "key-000b"), ("c", 9 * hour, "key-000c")):
        feed(spark, f"{root}/in", name, [(ord(name), at, message(idempotency_key=key)), (ord(name) + 100, at, f"bad {name}")])
    feed(spark, f"{root}/in", "d", [(9, hour, message(idempotency_key="key-000a")), (10, hour, "bad a")])
    run(spark, root)
    keys = sorted(r.idempotency_key for r in spark.read.parquet(f"{root}/silver").collect())
    assert keys == ["key-000a", "key-000b", "key-000c"]
    assert sorted(r.payload for r in spark.read.parquet(f"{root}/dlq").collect()) == ["bad a", "bad a", "bad b", "bad c"]


def test_first_of_a_batch_stays(spark):
    root = scratch_dir(spark, "test")
    rows = [(3, 1002, message(transaction_id="late")), (2, 1001, message(transaction_id="second")), (1, 1001, message(transaction_id="first"))]
    feed(spark, f"{root}/in", "a", rows)
    run(spark, root)
    assert [r.transaction_id for r in spark.read.parquet(f"{root}/silver").collect()] == ["first"]


def test_redelivery_after_the_ttl_passes(spark):
    """Arrival is the ingest's clock; the time in the messages does not matter."""
    root = scratch_dir(spark, "test")
    now = datetime(2024, 5, 1, 12, 30, tzinfo=timezone.utc)
    for i, seconds in enumerate((0, 3599, 3601, 3700)):
        feed(spark, f"{root}/in", "a", [(i, 1000, message())])
        run(spark, root, clock=lambda at=now + timedelta(seconds=seconds): at)
    assert spark.read.parquet(f"{root}/silver").count() == 2


def test_keys_of_the_ttl_alone_stay_on_disk(spark):
    """Hours of keys go once no batch can need them; redeliveries are judged as before."""
    root = scratch_dir(spark, "test")
    now = datetime(2024, 5, 1, 12, 30, tzinfo=timezone.utc)
    for hour in range(6):
        feed(spark, f"{root}/in", "a", [(hour, 1000, message(idempotency_key=f"key-{hour:04d}")), (hour + 50, 1000, message(idempotency_key="key-hot0"))])
        run(spark, root, ttl_seconds=7200, clock=lambda at=now + timedelta(hours=hour): at)
    hours = [n for n in names_in(spark, f"{root}/keys") if n != "hour=0"]
    assert len(hours) == 3  # of six
    keys = [r.idempotency_key for r in spark.read.parquet(f"{root}/silver").collect()]
    assert keys.count("key-hot0") == 3 and len(keys) == 9
    assert names_in(spark, f"{root}/none") == []


def test_backlog_counts_a_late_letter(spark):
    """A letter late but within the watermark is counted; one far behind it is not."""
    root = scratch_dir(spark, "test")
    schema = "payload string, failed_at timestamp"

    def batch(*minutes):
        rows = [(f"p{m}", datetime(2024, 1, 1, 12, tzinfo=timezone.utc) + timedelta(minutes=m)) for m in minutes]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
        letters = spark.readStream.schema(schema).parquet(f"{root}/in")
        ingest.stream_backlog(letters, f"{root}/table", f"{root}/state", late="30 minutes").awaitTermination()

    batch(0, 1, 40)
    batch(20, 41)
    batch(-600, 90)
    got = {r.window_start.hour * 60 + r.window_start.minute - 720: r.letters for r in merge.read_merged(spark, f"{root}/table").collect()}
    assert got == {0: 2, 20: 1, 40: 2, 90: 1}


def test_progress_is_logged_per_batch(spark):
    root = scratch_dir(spark, "test")
    for i in range(3):
        feed(spark, f"{root}/in", "a", [(i, 1000, message(idempotency_key=f"key-{i:04d}"))])
    log = ingest.ProgressLog(spark, f"{root}/log")
    spark.streams.addListener(log)
    run(spark, root)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    spark.streams.removeListener(log)
    rows = ingest.batch_lag(ingest.read_progress(spark, f"{root}/log")).collect()
    assert sorted((r.batch_id, r.input_rows) for r in rows if r.input_rows) == [(0, 1), (1, 1), (2, 1)]
    assert all(r.duration_ms > 0 and not r.over_stream_target for r in rows)


def test_lines_of_files_feed_the_ingest(spark):
    root = scratch_dir(spark, "test")
    spark.createDataFrame([(message(),), (message(idempotency_key="key-0002"),), ("garbage",)], "value string").write.text(f"{root}/in")
    lines = files.stream_messages(spark, f"{root}/in", maxFilesPerTrigger="1")
    ingest.run_ingest(lines, f"{root}/silver", f"{root}/dlq", f"{root}/keys", f"{root}/state").awaitTermination()
    assert spark.read.parquet(f"{root}/silver").count() == 2 and spark.read.parquet(f"{root}/dlq").count() == 1


def test_stream_dedup_off(spark):
    root = scratch_dir(spark, "test")
    feed(spark, f"{root}/in", "a", [(1, 1000, message()), (2, 1001, message())])
    run(spark, root, ttl_seconds=0)
    assert spark.read.parquet(f"{root}/silver").count() == 2


def test_stream_deidentifies_counterparties(spark):
    root = scratch_dir(spark, "test")
    feed(spark, f"{root}/in", "a", [(1, 1000, message(counterparty_account="GB29NWBK60161331926819"))])
    run(spark, root, secret="s", rate=1.0)
    assert spark.read.parquet(f"{root}/silver").first().counterparty_account.startswith("LEDGER_TOKEN(")


def test_replayed_batch_is_written_once(spark):
    """The same batch number written twice leaves one copy."""
    root = scratch_dir(spark, "test")
    feed(spark, f"{root}/in", "a", [(1, 1000, message()), (2, 1001, "garbage")])
    run(spark, root)
    query = ingest.run_ingest(
        source(spark, f"{root}/in"), f"{root}/silver", f"{root}/dlq", f"{root}/keys", f"{root}/other-state"
    )
    query.awaitTermination()
    assert spark.read.parquet(f"{root}/silver").count() == 1
    assert spark.read.parquet(f"{root}/dlq").count() == 1


def test_bronze_lands_untouched(spark):
    root = scratch_dir(spark, "test")
    feed(spark, f"{root}/in", "a", [(1, 1000, "garbage"), (2, 1001, message())])
    ingest.land_bronze(source(spark, f"{root}/in"), f"{root}/bronze", f"{root}/state").awaitTermination()
    assert {r.data for r in spark.read.parquet(f"{root}/bronze").collect()} == {"garbage", message()}


def test_dead_letter_windows(spark):
    rows = [("a", datetime(2024, 1, 1, 0, 1)), ("b", datetime(2024, 1, 1, 0, 4)), ("c", datetime(2024, 1, 1, 0, 5))]
    df = spark.createDataFrame(rows, "payload string, failed_at timestamp")
    out = sorted((r.window_start, r.letters, r.alert) for r in ingest.dead_letter_backlog(df).collect())
    assert out == [(datetime(2024, 1, 1), 2, True), (datetime(2024, 1, 1, 0, 5), 1, True)]


def test_reconcile_adds_what_silver_lacks(spark):
    bronze = spark.createDataFrame(
        [
            ("m1", datetime(2024, 1, 1), message(idempotency_key="key-0001")),
            ("m2", datetime(2024, 1, 2), message(idempotency_key="key-0002", transaction_id="first")),
            ("m3", datetime(2024, 1, 3), message(idempotency_key="key-0002", transaction_id="second")),
            ("m4", datetime(2024, 1, 3), "garbage"),
        ],
        "message_id string, publish_time timestamp, data string",
    )
    silver = spark.createDataFrame([("key-0001",)], "idempotency_key string")
    assert [r.transaction_id for r in dedup.reconcile(bronze, silver).collect()] == ["first"]
