"""Upserts into bucketed tables, and expiry of day folders."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerlake.session import scratch_dir
from ledgerlake.sources import merge

SCHEMA = "id string, part int, v string, n int"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def content(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.fixture
def path(spark):
    return scratch_dir(spark, "merge-test")


def test_upsert_equals_a_merge(spark, path):
    rng = random.Random(2)
    held = {(f"k{i}", i % 3): (f"v{i}", None if i % 11 == 0 else i) for i in range(400)}
    merge.create_table(table(spark, [(*k, *v) for k, v in held.items()]), path, ["id", "part"], buckets=16)
    for update in (True, False, True):
        source = {}
        for _ in range(60):
            i = rng.randrange(600)
            source[(f"k{i}", i % 3)] = rng.choice([(f"new{i}", i), (None, None), held.get((f"k{i}", i % 3), ("x", 1))])
        done = merge.merge(table(spark, [(*k, *v) for k, v in source.items()]), path, update)
        fresh = [k for k in source if k not in held]
        changed = [k for k in source if k in held and source[k] != held[k]] if update else []
        assert (done["inserted"], done["updated"]) == (len(fresh), len(changed))
        held |= {k: source[k] for k in fresh + changed}
        assert content(merge.read_merged(spark, path)) == sorted(((*k, *v) for k, v in held.items()), key=str)


def test_only_touched_buckets_are_rewritten(spark, path):
    merge.create_table(table(spark, [(f"k{i}", 0, "v", i) for i in range(200)]), path, ["id"], buckets=16)
    before = merge.manifest(spark, path)
    done = merge.merge(table(spark, [("k3", 0, "v", 3), ("k5", 0, "other", 5)]), path)
    after = merge.manifest(spark, path)
    assert done == {"inserted": 0, "updated": 1, "rewritten": 1}
    assert sum(after["live"][b] != f for b, f in before["live"].items()) == 1 and set(after["live"]) == set(before["live"])
    assert merge.merge(table(spark, [("k5", 0, "other", 5)]), path)["rewritten"] == 0
    assert merge.manifest(spark, path) == after
    assert content(merge.read_merged(spark, path, 0)) == content(table(spark, [(f"k{i}", 0, "v", i) for i in range(200)]))


def test_a_merge_that_dies_leaves_the_old_table(spark, path, monkeypatch):
    rows = [(f"k{i}", 0, "v", i) for i in range(50)]
    merge.create_table(table(spark, rows), path, ["id"], buckets=4)

    def die(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(merge, "_commit", die)
        with pytest.raises(RuntimeError, match="lost"):
            merge.merge(table(spark, [("k1", 0, "half", 1), ("fresh", 0, "half", 1)]), path)
    assert content(merge.read_merged(spark, path)) == content(table(spark, rows))
    gone = merge.vacuum(spark, path)
    assert len(gone) == 1 and content(merge.read_merged(spark, path)) == content(table(spark, rows))
    merge.merge(table(spark, [("fresh", 0, "whole", 1)]), path)
    assert merge.read_merged(spark, path).count() == 51


def test_two_merges_at_once(spark, path):
    """The one that commits second fails and changes nothing."""
    merge.create_table(table(spark, [("a", 0, "v", 1)]), path, ["id"])
    stale = merge.manifest(spark, path)
    merge.merge(table(spark, [("b", 0, "v", 2)]), path)
    with pytest.raises(merge.MergeConflict):
        merge._commit(spark, path, stale | {"version": 1})
    with pytest.raises(merge.MergeConflict):
        merge.create_table(table(spark, []), path, ["id"])
    assert [r.id for r in merge.read_merged(spark, path).orderBy("id").collect()] == ["a", "b"]


def test_nulls_repeats_and_empty_tables(spark, path):
    merge.create_table(table(spark, []), path, ["id"])
    assert merge.read_merged(spark, path).count() == 0
    assert merge.merge(table(spark, []), path)["rewritten"] == 0
    for times in (1, 2):  # a null key matches none
        merge.merge(table(spark, [(None, 0, "n", 1), ("a", 0, "v", 1)]), path)
        assert merge.read_merged(spark, path).count() == times + 1
    with pytest.raises(ValueError, match="several source rows"):
        merge.merge(table(spark, [("a", 0, "x", 1), ("a", 0, "y", 1)]), path)
    with pytest.raises(FileNotFoundError):
        merge.read_merged(spark, path + "-none")


def test_vacuum_keeps_what_newer_versions_name(spark, path):
    merge.create_table(table(spark, [(f"k{i}", 0, "v", i) for i in range(40)]), path, ["id"], buckets=4)
    for n in range(3):
        merge.merge(table(spark, [(f"k{n}", 0, f"w{n}", n)]), path)
    want = content(merge.read_merged(spark, path))
    merge.vacuum(spark, path, keep=1)
    assert content(merge.read_merged(spark, path)) == want
    with pytest.raises(Exception):
        merge.manifest(spark, path, 0)


def test_expired_days_leave_the_disk(spark, path):
    rows = spark.range(100).selectExpr("id", "if(id % 10 = 9, null, date_add(date'2024-01-01', cast(id % 10 as int))) as day")
    rows.write.partitionBy("day").parquet(path)
    kept = {r[0]: r[1] for r in spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()}
    with pytest.raises(ValueError, match="2024-01-02"):
        merge.expire_partitions(spark, path, "day", date(2024, 1, 9), 5, pinned={"2024-01-02", "2024-01-08"})
    assert spark.read.parquet(path).count() == 100
    gone = merge.expire_partitions(spark, path, "day", date(2024, 1, 9), 5, pinned={"2024-01-08"})
    assert gone == ["2024-01-01", "2024-01-02", "2024-01-03"]
    left = spark.read.parquet(path)
    assert left.count() == 70 and left.where("day < '2024-01-04'").isEmpty() and left.where("day is null").count() == 10
    assert {r[0] for r in left.select(F.input_file_name()).distinct().collect()} <= set(kept)
    assert merge.expire_partitions(spark, path, "day", date(2024, 1, 9), 5) == []
