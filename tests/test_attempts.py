import json
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import dedup
from ledgerlake.session import names_in, scratch_dir
from ledgerlake.streaming import attempts

SCHEMA = "message_id string, data string"


def feed(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def deliver(spark, root, handler=attempts.require_json, limit=attempts.MAX_ATTEMPTS):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    attempts.deliver_stream(stream, handler, f"{root}/out", f"{root}/state", limit).awaitTermination()


def told(spark, root):
    schema = spark.createDataFrame([], SCHEMA).schema
    rows = attempts.outcomes(spark, schema, f"{root}/out").collect()
    return sorted((r.message_id, r.attempts, r.outcome) for r in rows)


def test_poisoned_batch_is_retried_and_set_aside(spark):
    """The bad message waits through the batches and is set aside at the fifth; its neighbours pass at once."""
    root = scratch_dir(spark, "test")
    feed(spark, f"{root}/in", [(f"m{i:03d}", "bad" if i == 40 else "{}") for i in range(100)])
    deliver(spark, root)
    assert ("m040", 1, "waiting") in told(spark, root)
    for i in range(4):
        feed(spark, f"{root}/in", [(f"n{i}", "{}")])
        deliver(spark, root)
    got = told(spark, root)
    assert len(got) == 104
    assert [g for g in got if g[1:] != (1, "delivered")] == [("m040", 5, "set aside")]
    reason = spark.read.parquet(f"{root}/out/aside").where("error is not null").first()
    assert reason.error.startswith("JSONDecodeError") and reason.data == "bad"
    assert len(names_in(spark, f"{root}/out/waiting")) <= 2


def test_silent_feed_is_redelivered(spark):
    root = scratch_dir(spark, "test")
    feed(spark, f"{root}/in", [("a", "{}"), ("b", "bad"), ("c", None)])
    deliver(spark, root, limit=3)
    schema = spark.createDataFrame([], SCHEMA).schema
    rounds = 1
    while attempts.redeliver(spark, schema, attempts.require_json, f"{root}/out", 3):
        rounds += 1
    assert rounds == 2
    assert told(spark, root) == [("a", 1, "delivered"), ("b", 3, "set aside"), ("c", 3, "set aside")]
    feed(spark, f"{root}/in", [("d", "[]"), ("e", "bad")])
    deliver(spark, root, limit=3)
    assert told(spark, root)[3:] == [("d", 1, "delivered"), ("e", 1, "waiting")]


def test_message_that_heals_is_delivered(spark):
    root = scratch_dir(spark, "test")
    feed(spark, f"{root}/in", [("a", "x"), ("b", "{}")])
    deliver(spark, root)

    def heals(frame):
        pass

    schema = spark.createDataFrame([], SCHEMA).schema
    assert attempts.redeliver(spark, schema, heals, f"{root}/out") is False
    assert told(spark, root) == [("a", 2, "delivered"), ("b", 1, "delivered")]


def test_replayed_batch_counts_once(spark):
    """A batch that was written but not committed runs again: no attempt is counted twice."""
    root = scratch_dir(spark, "test")
    feed(spark, f"{root}/in", [("a", "x"), ("b", "{}")])
    deliver(spark, root)
    stream = spark.readStream.schema(SCHEMA).parquet(f"{root}/in")
    attempts.deliver_stream(stream, attempts.require_json, f"{root}/out", f"{root}/fresh").awaitTermination()
    assert told(spark, root) == [("a", 1, "waiting"), ("b", 1, "delivered")]


def test_unfinished_round_counts_for_nothing(spark):
    """A round that died before it wrote what waits is not read, and its rerun replaces it."""
    root = scratch_dir(spark, "test")
    feed(spark, f"{root}/in", [("a", "x")])
    deliver(spark, root)
    half = spark.createDataFrame([("z", "{}", 1)], f"{SCHEMA}, attempts int")
    half.write.parquet(f"{root}/out/delivered/round={1:012d}")
    assert told(spark, root) == [("a", 1, "waiting")]
    feed(spark, f"{root}/in", [("b", "{}")])
    deliver(spark, root)
    assert told(spark, root) == [("a", 2, "waiting"), ("b", 1, "delivered")]


def test_no_messages_and_clashing_names(spark):
    root = scratch_dir(spark, "test")
    schema = spark.createDataFrame([], SCHEMA).schema
    assert attempts.redeliver(spark, schema, attempts.require_json, root) is False
    assert attempts.outcomes(spark, schema, root).count() == 0
    with pytest.raises(ValueError, match="attempts"):
        attempts._with_attempts(spark.createDataFrame([], "attempts int, data string"))


def test_named_messages_are_not_searched_for(spark):
    """A delivery that names what it could not take is called once a chunk; one that does not is halved, to the same end."""
    import pandas as pd

    data = ["bad" if i % 3 == 0 else None if i % 50 == 1 else "{}" for i in range(300)]
    frame = pd.DataFrame({"message_id": [str(i) for i in range(300)], "data": data, "attempts": 1, "error": None})
    calls = []

    def named(part):
        calls.append(len(part))
        attempts.require_json(part)

    def unnamed(part):
        for payload in part["data"]:
            json.loads(payload)

    (got, want) = (pd.concat(attempts._tried(d)(iter([frame, frame[:0]]))) for d in (named, unnamed))
    assert calls == [300]
    assert got.to_dict("records") == want.to_dict("records")
    assert [e is None for e in got["error"]] == [x == "{}" for x in data] and set(got["attempts"]) == {2}


def test_feed_is_read_by_as_many_tasks_as_it_fills(bank, monkeypatch):
    """Batches take an eighth of the feed's files, which grow in number with it, not two files of any size."""
    from ledgerlake import catalog

    rounds = []
    whole = attempts._round

    def counted(batch, *rest):
        rounds.append(batch.rdd.getNumPartitions())
        whole(batch, *rest)

    monkeypatch.setattr(attempts, "_round", counted)
    bank.spark.conf.set("spark.sql.shuffle.partitions", "24")
    bank.spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    monkeypatch.setattr(attempts, "redeliver", lambda *rest: False)
    try:
        told = catalog.queries()["delivery_attempts"](bank.spark, bank.folder)
        assert told.count() == bank.transaction_event.count()
    finally:
        bank.spark.conf.set("spark.sql.shuffle.partitions", "4")
        bank.spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(rounds) == 8 and min(rounds) == 3


# ---- the batch twin of the TTL ----

START = datetime(2024, 3, 1, tzinfo=timezone.utc)
ROWS = "key string, at timestamp, id string"


def brute(rows, ttl):
    kept, out = {}, []
    known = sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[2]))
    for key, at, name in known:
        if key not in kept or at - kept[key] >= timedelta(seconds=ttl):
            kept[key] = at
            out.append(name)
    first = {}
    for key, at, name in rows:
        if at is None:
            first[key] = min(first.get(key, name), name)
    return sorted(out + list(first.values()))


@pytest.mark.parametrize("ttl", [1, 60, 600, 100_000])
def test_ttl_against_one_row_at_a_time(spark, ttl):
    """A third of the rows has one key; ties, null keys and null times are among them."""
    draw = random.Random(ttl)
    rows = []
    for i in range(3000):
        key = draw.choice(["hot", f"k{draw.randrange(200)}", f"k{draw.randrange(200)}"])
        at = START + timedelta(seconds=draw.randrange(7200), microseconds=draw.choice([0, 0, 1]))
        rows.append((None if i % 97 == 0 else key, None if i % 89 == 0 else at, f"id{i:05d}"))
    got = dedup.first_within_ttl(spark.createDataFrame(rows, ROWS), "key", "at", "id", ttl)
    assert sorted(r.id for r in got.collect()) == brute(rows, ttl)


def test_ttl_edges(spark):
    times = (0, 59, 60, 61, 119, 120)
    rows = [("k", START + timedelta(seconds=s), f"s{s}") for s in times]
    got = dedup.first_within_ttl(spark.createDataFrame(rows, ROWS), "key", "at", "id", 60)
    assert sorted(r.id for r in got.collect()) == ["s0", "s120", "s60"]
    df = spark.createDataFrame(rows + rows, ROWS)
    assert dedup.first_within_ttl(df, "key", "at", "id", 0).count() == 12
    assert dedup.first_within_ttl(df, "key", "at", "id", 60).count() == 3  # repeated rows pass once
    assert dedup.first_within_ttl(df.where(F.lit(False)), "key", "at", "id", 60).count() == 0


def test_json_is_required(spark):
    import pandas as pd

    attempts.require_json(pd.DataFrame({"data": [json.dumps({"a": 1}), "[]"]}))
    with pytest.raises(json.JSONDecodeError):
        attempts.require_json(pd.DataFrame({"data": ["{}", "x"]}))
