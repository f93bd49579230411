"""Mixing sources to target weights by systematic sampling.

A source's target is its weight's share of all words, at most ``MOST_REPEATS`` times its size;
what is above goes to the others by weight. Every document of a source is expected target / size
times. Expected copies are summed up along the source, a single random offset is added, and a
document is taken once for each whole number its stretch of the sum crosses: the number of copies
is the expectation rounded down or up, and the source's total is off by less than one document.
Documents are summed in order of size, so the words taken stay near the target too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import running_index, unit_hash, word_count
from ledgerlake.session import written

#: No source, and so no document, is repeated more often.
MOST_REPEATS = 3
#: Weights given to the sources in code-point order, repeating; null comes last.
WEIGHTS = (1, 2, 3)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, weight, target) from one row per source (source, source_size).

    The share per weight at which the targets add up to all words is found by ordering sources by
    the share at which they reach their limit. Only the list of sources is sorted; its rows, one
    per source, are all that one task sees. All targets are 0 where there are no words.
    """
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    ranked = sizes.withColumn("_rank", F.row_number().over(by_name) - 1).withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    )
    limit = F.col("source_size") * most
    everything = Window.partitionBy()
    by_limit = Window.orderBy(limit / F.col("weight"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    filled = (
        ranked.withColumn("_full", F.coalesce(F.sum(limit).over(by_limit), F.lit(0)))
        .withColumn("_spent", F.coalesce(F.sum("weight").over(by_limit), F.lit(0)))
        .withColumn("_all", F.sum("source_size").over(everything))
        .withColumn("_weights", F.sum("weight").over(everything))
        # Share per weight if exactly the sources before this one were at their limit.
        .withColumn("_level", (F.col("_all") - F.col("_full")).cast("double") / (F.col("_weights") - F.col("_spent")))
        .withColumn("_fits", F.when(F.col("_level") * F.col("weight") <= limit, F.col("_level")))
    )
    level = F.max("_fits").over(everything)  # of the first that fits; levels only fall after it
    target = F.least(limit.cast("double"), level * F.col("weight"))
    return filled.select("source", "source_size", "weight", F.coalesce(target, limit.cast("double")).alias("target"))


def _bin(size: Column) -> Column:
    """Sizes in steps of an eighth of a doubling, largest first: few values however many sizes there are."""
    return F.when(size > 0, -F.floor(F.log2(size.cast("double")) * 8)).otherwise(F.lit(1)).cast("int")


def plan(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies), one row per document row.

    ``docs`` has doc_id, source and text; other columns are ignored. Null and blank texts have
    size 0, null sources form a source, null ids and repeated rows are documents like any other,
    and an empty table gives an empty plan. The offset and all ties come from hashes of the
    source and id, so reruns agree.
    """
    sized = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(sizes, weights, most).select(
        F.col("source").alias("_of"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("_rate"),
        unit_hash(F.lit(seed), F.col("source")).alias("_offset"),
    )
    placed = running_index(sized.withColumn("_bin", _bin(F.col("size"))), ["source"], ["_bin"], ["doc_id"], ["size", "doc_id"])
    rated = placed.join(goal, F.col("source").eqNullSafe(F.col("_of")))
    crossed = F.floor((F.col("_index") + 1) * F.col("_rate") + F.col("_offset")) - F.floor(
        F.col("_index") * F.col("_rate") + F.col("_offset")
    )
    return rated.select("doc_id", "source", "size", "source_size", "target", crossed.cast("int").alias("copies"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the plan takes it; columns as given."""
    # Rows alike in id, source and size are matched by their place among them.
    alike = ["doc_id", "source", "size"]
    place = F.row_number().over(Window.partitionBy(*alike).orderBy("copies"))
    copies = plan(docs, **options).withColumn("_nth", place).where("copies > 0").select(
        *[F.col(c).alias(f"_{c}") for c in alike], F.col("_nth").alias("_no"), "copies"
    )
    rows = docs.select(
        F.struct(*docs.columns).alias("_row"), "doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("_hash")
    )
    numbered = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*alike).orderBy("_hash")))
    same = F.col("_nth") == F.col("_no")
    for c in alike:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    taken = numbered.join(copies, same)
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).select("_row.*")


def report(docs: DataFrame) -> DataFrame:
    """The mix per document: doc_id, size, source_size, target and words taken."""
    return plan(docs).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies"
    )
