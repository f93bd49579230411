"""A Merkle manifest of a dataset by nested-interval labels.

Every node covers an interval of leaf ranks, ``lo`` up to but not including ``hi``: a leaf covers its
own rank, a node of level k sixteen to the k ranks from a multiple of that. Ranks come from one range
partitioning, so a source of any size is dealt over many tasks. Going up, a level is grouped into runs
of sixteen; going down, nodes are joined to the ancestor whose interval contains theirs, in buckets
of the ancestor's width, and the difference between the ancestor's interval and their own
names their siblings. A node carries the path above it, so leaves meet their whole path by
one join of runs, a sixteenth of the leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import lower_ascii
from ledgerlake.session import written

FAN = 16
#: One row in so many is tampered with in the report.
TAMPER_EVERY = 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<left:binary,right:binary>>"
#: monotonically_increasing_id holds the partition above this many bits.
_ROW_BITS = 33


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*values: Column) -> Column:
    """The leaf digest of a row's values, as 32 bytes: each is ``-`` if null, else its UTF-8 length, ``:`` and itself."""
    return F.unhex(F.sha2(F.concat(*[_field(v) for v in values]), 256))


def _text(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def _joined(nodes: Column) -> Column:
    """The digests of an array of nodes, one after the other."""
    return F.aggregate(nodes, F.expr("X''"), lambda held, n: F.concat(held, n["digest"]))


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (tree, ...) with their interval ``lo``, ``hi`` in the tree's order and ``total``, the tree's leaves.

    Rows are dealt by range of (tree, order), and each range starts where the one before it in the tree
    ended; rows equal in both are told apart by their place, so no key is too large for a task.
    """
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange("tree", *order, "_tie")
    placed = dealt.sortWithinPartitions("tree", *order, "_tie").drop("_tie").withColumn("_id", F.monotonically_increasing_id())
    kept = written(placed, "ranked")
    part = F.shiftright("_id", _ROW_BITS)
    pieces = kept.groupBy("tree", part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    whole = Window.partitionBy("tree")
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select(
        F.col("tree").alias("_tree"), F.col("_part").alias("_in"),
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("total"),
    )
    joined = kept.join(starts, F.col("tree").eqNullSafe(F.col("_tree")) & (part == F.col("_in")))
    return joined.withColumn("lo", F.col("_id") + F.col("_shift")).withColumn("hi", F.col("lo") + 1).drop("_id", "_tree", "_in", "_shift")


def _is_top() -> Column:
    return (F.col("lo") == 0) & (F.col("hi") == F.col("total"))


def levels(leaves: DataFrame) -> list[DataFrame]:
    """The levels above ranked leaves, lowest first: (tree, lo, hi, total, digest, children).

    ``children`` lists a run's nodes in order, with all columns of ``leaves`` on the lowest level. A
    tree ends at the level where one node covers all its leaves; one leaf alone has no level.
    """
    out: list[DataFrame] = []
    largest = leaves.agg(F.max("total")).first()[0] or 0
    below, width = leaves, 1
    while width < largest:
        held = [c for c in below.columns if c not in ("tree", "lo", "hi", "total", "digest", "children")]
        child = F.struct("lo", "hi", "digest", *held)
        runs = below.where(F.col("total") > width).groupBy("tree", F.floor(F.col("lo") / (width * FAN)).alias("_run"), "total").agg(
            F.array_sort(F.collect_list(child)).alias("children")
        )
        nodes = runs.select(
            "tree", F.col("children")[0]["lo"].alias("lo"), F.element_at("children", -1)["hi"].alias("hi"), "total",
            F.unhex(F.sha2(_text(_joined(F.col("children"))), 256)).alias("digest"), "children",
        )
        below = written(nodes, "level")
        out.append(below)
        width *= FAN
    return out


def tops(leaves: DataFrame, above: list[DataFrame]) -> DataFrame:
    """(tree, digest): the node of each tree that covers all its leaves."""
    found = leaves.where("total = 1").select("tree", "digest")
    for nodes in above:
        found = found.unionByName(nodes.where(_is_top()).select("tree", "digest"))
    return found


def _beside(children: Column, own: Column) -> Column:
    """The siblings left and right of a node: its run without the node's own interval."""
    return F.struct(
        _joined(F.filter(children, lambda n: n["hi"] <= own["lo"])).alias("left"),
        _joined(F.filter(children, lambda n: n["lo"] >= own["hi"])).alias("right"),
    )


def with_paths(leaves: DataFrame, above: list[DataFrame], crowns: DataFrame) -> DataFrame:
    """The leaves with ``path``, the siblings of each of their ancestors from the leaf up, and their tree's crown.

    ``crowns`` has one row per tree: tree, ``path`` above its top, and columns that all its leaves
    inherit. Nodes join the ancestor of the next level whose interval contains theirs, in
    buckets of that ancestor's width.
    """
    inherited = [c for c in crowns.columns if c != "tree"]
    crown = crowns.select(F.col("tree").alias("_tree"), *inherited)

    def crowned(nodes: DataFrame) -> DataFrame:
        return nodes.join(crown, F.col("tree").eqNullSafe(F.col("_tree"))).drop("_tree")

    known: DataFrame | None = None
    for k in range(len(above) - 1, -1, -1):
        nodes, width = above[k], FAN ** (k + 2)
        here = crowned(nodes.where(_is_top()))
        if known is not None:
            over = known.select(
                F.col("tree").alias("_tree"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("children").alias("_run"), *inherited
            )
            inside = (F.col("_lo") <= F.col("lo")) & (F.col("hi") <= F.col("_hi"))
            bucket = F.floor(F.col("lo") / width) == F.floor(F.col("_lo") / width)
            found = nodes.where(~_is_top()).join(over, F.col("tree").eqNullSafe(F.col("_tree")) & bucket & inside)
            step = F.array(_beside(F.col("_run"), F.struct("lo", "hi")))
            here = here.unionByName(found.withColumn("path", F.concat(step, "path")).drop("_tree", "_lo", "_hi", "_run"))
        known = written(here, "paths") if k else here
    alone = crowned(leaves.where("total = 1"))
    if known is None:
        return alone
    each = known.select("tree", "total", "children", *inherited, F.explode("children").alias("_own"))
    step = F.array(_beside(F.col("children"), F.col("_own")))
    own = [F.col("_own")[c].alias(c) for c in leaves.columns if c not in ("tree", "total")]
    rest = [c for c in inherited if c != "path"]
    spread = each.select("tree", "total", *own, *rest, F.concat(step, "path").alias("path"))
    return spread.unionByName(alone)


def folded(start: Column, path: Column) -> Column:
    """The top digest that a leaf's digest and its path lead to."""
    return F.aggregate(path, start, lambda held, p: F.unhex(F.sha2(_text(F.concat(p["left"], held, p["right"])), 256)))


def proof(path: Column) -> Column:
    """Digest of all siblings of a path, as hex text."""
    return F.sha2(_text(F.aggregate(path, F.expr("X''"), lambda held, p: F.concat(held, p["left"], p["right"]))), 256)


def manifest(leaves: DataFrame, order: list[str]) -> DataFrame:
    """Leaves (tree, digest, ...) with ``path``, ``subroot`` and ``root``.

    A tree's leaves follow ``order``; the trees' tops, in the order of ``tree`` with null first, are
    the leaves of the upper tree, whose top is the root.
    """
    lower = ranked(leaves, order)
    lower_levels = levels(lower)
    upper = ranked(
        tops(lower, lower_levels).select(F.lit(None).cast("string").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"]
    )
    upper_levels = levels(upper)
    root = tops(upper, upper_levels).select("tree", F.expr(f"cast(array() as {_PATH})").alias("path"), F.col("digest").alias("root"))
    crowns = with_paths(upper, upper_levels, root).select(
        F.col("name").alias("tree"), "path", F.col("digest").alias("subroot"), "root"
    )
    return with_paths(lower, lower_levels, written(crowns, "crowns"))


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of ``docs``.

    A leaf hashes doc_id, source, lang, n_chars and text, other columns do not count; a null is
    ``-`` and so differs from an empty text. Rows of a source without an id come first, and
    rows that share an id are ordered by their digest; equal rows are a leaf each. Every fifth id by
    crc32 has its text lower-cased (A-Z) before its root is folded again from the
    original siblings; null ids and texts never change. An empty table gives an empty result.
    """
    intact = docs.select(*FIELDS)
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER_EVERY == 0, F.lit(False))
    text = lower_ascii(F.col("text"))
    others = [F.col(c) for c in FIELDS[:-1]]
    leaves = intact.select(
        F.col("source").cast("string").alias("tree"), "doc_id", digest(*others, F.col("text")).alias("digest"),
        F.when(tampered, digest(*others, text)).alias("changed"),
    )
    found = manifest(leaves, ["doc_id", "digest"])
    again = folded(F.coalesce("changed", "digest"), F.col("path"))
    out = found.select(
        "doc_id", _text(F.col("digest")).alias("leaf"), _text(F.col("subroot")).alias("subroot"), _text(F.col("root")).alias("root"),
        proof(F.col("path")).alias("proof_sha256"), _text(again).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
