"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.session import scratch_dir

LINKS_PER_FILE = 500_000


def _kept(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written to a folder of its own in the shared one, and that folder."""
    path = scratch_dir(df.sparkSession, "links")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _discard(df: DataFrame, path: str) -> None:
    """Delete a folder that :func:`_kept` wrote."""
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the least node reachable, for every node of an edge list (a, b).

    Each round links every larger neighbour of a node to the node's least neighbour, then every
    node and its smaller neighbours to the least of them; both steps are joins with the aggregate
    ``min``, so a hub of any degree is summed before it is shuffled and no group is collected.
    Rounds grow with the logarithm of a component's length. Each is written to the shared folder.
    Loops and repeated edges are ignored; an empty list gives an empty table.
    """
    links, path = _kept(
        edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    )
    # Links never grow in number, so their files are sized once; few links need not be many files.
    files = links.count() // LINKS_PER_FILE + 1
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("m")).select(
            "node", F.least("node", "m").alias("m")
        )
        large = both.where("lo > hi").select(F.col("hi").alias("node"), F.col("lo").alias("far")).join(least, "node").select(
            F.col("far").alias("hi"), F.col("m").alias("lo")
        ).distinct()
        small = large.groupBy("hi").agg(F.min("lo").alias("m"))
        step = (
            large.join(small, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .unionByName(small.select("hi", F.col("m").alias("lo")))
            .distinct()
        )
        fresh, fresh_path = _kept(step.coalesce(files))
        # Settled once every node has a single parent and no parent has one itself.
        roles = fresh.select(F.col("hi").alias("node"), F.lit(1).alias("parents"), F.lit(0).alias("children")).unionByName(
            fresh.select(F.col("lo").alias("node"), F.lit(0).alias("parents"), F.lit(1).alias("children"))
        )
        summed = roles.groupBy("node").agg(F.sum("parents").alias("parents"), F.max("children").alias("children"))
        settled = summed.where("parents > 1 or parents = 1 and children = 1").isEmpty()
        _discard(links, path)  # the round before is not read again
        links, path = fresh, fresh_path
        if settled:
            break
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        links.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )


def merged_components(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` (node, component) after more edges (a, b), whose new nodes join it.

    Only the components that the edges touch are a graph again, so earlier rounds are not redone.
    """
    side = labels.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
    left = edges.join(side, F.col("a") == F.col("_n"), "left").select(F.coalesce("_c", "a").alias("a"), "b")
    both = left.join(side, F.col("b") == F.col("_n"), "left").select("a", F.coalesce("_c", "b").alias("b"))
    roots = connected_components(both)
    moved = labels.join(roots.select(F.col("node").alias("_n"), F.col("component").alias("_r")), F.col("component") == F.col("_n"), "left")
    fresh = roots.join(labels.select("node"), "node", "left_anti")
    return moved.select("node", F.coalesce("_r", "component").alias("component")).unionByName(fresh)
