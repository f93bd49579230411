"""Tables that take upserts: copy-on-write over buckets, with a manifest that names the live files.

Rows lie in buckets by a hash of their key. A merge rewrites the buckets it changes into a new folder and
then writes the next manifest, one small JSON file that names every bucket's folder. Readers go by
the newest manifest, so they see a merge whole or not at all; a merge that dies before its
manifest leaves folders that nobody reads, which :func:`vacuum` removes.
"""

from __future__ import annotations

import json
import uuid
from datetime import date, timedelta

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlake.session import discard, file_system, names_in, written

BUCKETS = 64
_BUCKET = "_bucket"


class MergeConflict(RuntimeError):
    """Another merge committed first."""


def _versions(spark: SparkSession, path: str) -> list[int]:
    return [int(n.removesuffix(".json")) for n in names_in(spark, f"{path}/manifest") if n.endswith(".json") and not n.startswith(".")]


def is_table(spark: SparkSession, path: str) -> bool:
    return bool(_versions(spark, path))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """The newest manifest of a table, or one of an earlier version: version, key, schema, buckets and live folders."""
    known = _versions(spark, path)
    if not known:
        raise FileNotFoundError(f"no table at {path}")
    at = max(known) if version is None else version
    system, folder = file_system(spark, f"{path}/manifest/{at:010d}.json")
    stream = system.open(folder)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _commit(spark: SparkSession, path: str, found: dict) -> None:
    """Write a manifest under its number by one rename, which fails if the number is taken."""
    system, staged = file_system(spark, f"{path}/manifest/.{uuid.uuid4().hex}")
    out = system.create(staged)
    out.write(bytearray(json.dumps(found).encode()))
    out.close()
    _, final = file_system(spark, f"{path}/manifest/{found['version']:010d}.json")
    if system.exists(final) or not system.rename(staged, final):
        system.delete(staged, False)
        raise MergeConflict(f"version {found['version']} of {path} exists")


def _bucketed(rows: DataFrame, key: list[str], buckets: int) -> DataFrame:
    return rows.withColumn(_BUCKET, F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))


def _write(rows: DataFrame, path: str, name: str) -> list[int]:
    """Write bucketed rows to a folder of their own; the buckets that it holds."""
    target = f"{path}/data/{name}"
    rows.repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(target)
    return [int(n.split("=")[1]) for n in names_in(rows.sparkSession, target) if n.startswith(f"{_BUCKET}=")]


def _live(spark: SparkSession, path: str, found: dict, only: list[int] | None = None) -> DataFrame:
    """Rows of the live folders, all or those of some buckets."""
    schema = StructType.fromJson(json.loads(found["schema"]))
    paths = [f"{path}/data/{folder}/{_BUCKET}={b}" for b, folder in found["live"].items() if only is None or int(b) in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def create_table(rows: DataFrame, path: str, key: list[str], buckets: int = BUCKETS) -> None:
    """A new table of ``rows``, whose keys must be unique; fails if there is one at ``path``."""
    if _versions(rows.sparkSession, path):
        raise MergeConflict(f"{path} is a table already")
    name = f"0-{uuid.uuid4().hex}"
    filled = _write(_bucketed(rows, key, buckets), path, name)
    _commit(
        rows.sparkSession, path,
        {"version": 0, "key": key, "buckets": buckets, "schema": rows.schema.json(), "live": {str(b): name for b in filled}},
    )


def read_merged(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A table as of its newest manifest, or of an earlier version that is not vacuumed."""
    return _live(spark, path, manifest(spark, path, version))


def merge(source: DataFrame, path: str, update: bool = True) -> dict[str, int]:
    """Bring ``source`` into the table: new keys are inserted and, with ``update``, rows of known keys replaced.

    Keys match as MERGE matches them: a null key equals none, so its row is inserted each time. Two source rows
    of one key are an error. Rows that equal the table's change nothing. Only buckets with a
    change are read whole and rewritten; the others keep their files. Returns how many rows were
    inserted and updated and how many buckets rewritten. Raises :class:`MergeConflict` if
    another merge committed meanwhile; the table is then as that one left it.
    """
    spark = source.sparkSession
    found = manifest(spark, path)
    key, buckets = found["key"], found["buckets"]
    schema = StructType.fromJson(json.loads(found["schema"]))
    given = source.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    rows = written(_bucketed(given, key, buckets), "merge-source")
    whole = _all_set(key)
    twice = rows.where(whole).groupBy(*key).count().where("count > 1")
    if not twice.isEmpty():
        raise ValueError(f"several source rows match one key: {twice.first().asDict()}")
    asked = [r[0] for r in rows.select(_BUCKET).distinct().collect()]
    values = [c for c in schema.names if c not in key]
    there = _live(spark, path, found, asked).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)], F.struct(F.lit(1), *values).alias("_old"))
    on = F.lit(True)
    for i, c in enumerate(key):
        on = on & (F.col(c) == F.col(f"_k{i}"))
    judged = rows.join(there, on, "left").drop(*[f"_k{i}" for i in range(len(key))])
    differs = ~F.struct(F.lit(1), *values).eqNullSafe(F.col("_old"))
    wanted = F.col("_old").isNull() | differs if update else F.col("_old").isNull()
    changes = written(judged.where(wanted).withColumn("_new", F.col("_old").isNull()).drop("_old"), "merge-changes")
    counts = {r[_BUCKET]: (r["n"], r["fresh"]) for r in changes.groupBy(_BUCKET).agg(F.count(F.lit(1)).alias("n"), F.count_if("_new").alias("fresh")).collect()}
    inserted = sum(fresh for _, fresh in counts.values())
    done = {"inserted": inserted, "updated": sum(n for n, _ in counts.values()) - inserted, "rewritten": len(counts)}
    if not counts:
        return done
    kept = _bucketed(_live(spark, path, found, list(counts)), key, buckets)
    stay = kept.join(changes.where(~F.col("_new")).select(*key), key, "left_anti") if done["updated"] else kept
    version = found["version"] + 1
    name = f"{version}-{uuid.uuid4().hex}"
    filled = _write(stay.unionByName(changes.drop("_new")), path, name)
    _commit(spark, path, found | {"version": version, "live": found["live"] | {str(b): name for b in filled}})
    return done


def _all_set(key: list[str]) -> Column:
    out = F.lit(True)
    for c in key:
        out = out & F.col(c).isNotNull()
    return out


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete the folders and manifests that none of the newest ``keep`` versions names; the folders deleted.

    Not to be run while a merge into the table is under way.
    """
    versions = _versions(spark, path)
    held = versions[-keep:]
    named = {folder for v in held for folder in manifest(spark, path, v)["live"].values()}
    gone = [n for n in names_in(spark, f"{path}/data") if n not in named]
    for target in [f"{path}/manifest/{v:010d}.json" for v in versions[:-keep]] + [f"{path}/data/{n}" for n in gone]:
        discard(spark, target)
    return gone


def expire_partitions(spark: SparkSession, path: str, column: str, today: date, keep_days: int, pinned: set[str] | None = None) -> list[str]:
    """Delete the day folders of a table that are older than ``keep_days``; the days deleted.

    Planned from the folder names alone: no row is read. Raises ValueError, and deletes nothing, if a
    day to delete is among ``pinned``, the days that a running reader has listed. Folders that do not
    name a day, such as null, stay.
    """
    oldest = today - timedelta(days=keep_days)
    days = {}
    for name in names_in(spark, path):
        try:
            days[name] = date.fromisoformat(name.removeprefix(f"{column}="))
        except ValueError:
            continue
    old = sorted(n for n, day in days.items() if n.startswith(f"{column}=") and day < oldest)
    held = sorted(str(days[n]) for n in old if str(days[n]) in (pinned or set()))
    if held:
        raise ValueError(f"a reader still holds {held}")
    for name in old:
        system, folder = file_system(spark, f"{path}/{name}")
        if not system.delete(folder, True):
            raise PySparkException(f"cannot delete {path}/{name}")
    return [str(days[n]) for n in old]
