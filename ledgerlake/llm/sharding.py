"""Placing rows on shards through a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime size. The shards
take turns, each claiming its next free slot, until all slots are claimed; a row's key hashes to
a slot and the slot names the shard. The table has ``size`` rows whatever the data, so it is
broadcast and placing a row costs one hash lookup. When a shard leaves, nearly all slots of the
others keep their owner.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots of the table: a prime, about a hundred per shard at 64 shards.
TABLE_SIZE = 6553
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % i for i in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], size: int = TABLE_SIZE, weights: dict[str, int] | None = None) -> list[str]:
    """Owner of each slot.

    ``weights`` gives a shard that many claims per turn (1 if absent; 0 leaves it out). Raises
    ValueError for a size that is not prime, repeated or no shards, or more claims per turn than
    slots. The table does not depend on the order in which the shards are given.
    """
    turns = {s: (weights or {}).get(s, 1) for s in shards}
    if not _is_prime(size):
        raise ValueError("size must be prime")
    if len(turns) != len(shards) or min(turns.values(), default=0) < 0 or not 0 < sum(turns.values()) <= size:
        raise ValueError("shards must differ and claim 1 to size slots per turn")
    order = sorted(s for s in shards if turns[s])
    prefers = {}
    for shard in order:
        digest = hashlib.md5(shard.encode()).digest()
        first = int.from_bytes(digest[:8], "big") % size
        step = int.from_bytes(digest[8:], "big") % (size - 1) + 1
        prefers[shard] = iter(((first + step * np.arange(size, dtype=np.int64)) % size).tolist())
    owner: list[str | None] = [None] * size
    free = size
    while free:
        for shard in order:
            for _ in range(min(turns[shard], free)):
                slot = next(s for s in prefers[shard] if owner[s] is None)
                owner[slot] = shard
                free -= 1
    return owner


def slot_of(*keys: Column, size: int = TABLE_SIZE) -> Column:
    """Slot of a key, 0 to ``size`` - 1; parts are separated, and a null part is a key of its own."""
    text = F.concat_ws("\x1f", *[F.coalesce(k.cast("string"), F.lit("\x00")) for k in keys])
    return (F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % size).cast("int")


def place(rows: DataFrame, keys: list[str], table: list[str]) -> DataFrame:
    """``rows`` with ``slot`` and ``shard`` from their key columns; columns of those names are replaced.

    Every row is placed, repeated rows alike, rows without any key together on one shard; an
    empty table stays empty. No shuffle: the lookup table is the broadcast side.
    """
    spark: SparkSession = rows.sparkSession
    owners = spark.createDataFrame([(i, s) for i, s in enumerate(table)], "_slot int, _shard string")
    slotted = rows.select(F.struct(*rows.columns).alias("_row"), slot_of(*[F.col(k) for k in keys], size=len(table)).alias("_at"))
    joined = slotted.join(F.broadcast(owners), F.col("_at") == F.col("_slot"))
    kept = [F.col("_row").getField(c).alias(c) for c in rows.columns if c.lower() not in ("slot", "shard")]
    return joined.select(*kept, F.col("_at").alias("slot"), F.col("_shard").alias("shard"))


def write_shards(placed: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Write placed rows as one folder per shard.

    A shard's rows are dealt over as many tasks as their number asks for, so a shard of any size
    is written by several; the number of rows per shard is counted first and only that is shuffled.
    """
    counts = placed.groupBy("shard").agg(F.count(F.lit(1)).alias("_n"))
    files = counts.select(F.col("shard").alias("_of"), F.ceil(F.col("_n") / rows_per_file).cast("int").alias("_files"))
    spread = placed.join(F.broadcast(files), F.col("shard") == F.col("_of")).withColumn(
        "_deal", F.floor(F.rand(7) * F.col("_files")).cast("int")
    )
    dealt = spread.repartition("shard", "_deal").drop("_of", "_files", "_deal")
    dealt.write.mode("overwrite").partitionBy("shard").parquet(path)
