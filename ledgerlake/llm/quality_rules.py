"""Quality rules for whole texts, and lines that too many documents of a host share.

Lines are normalised and hashed. Per host, the distinct documents with a line are counted; a
line above the host's limit is boiler-plate and is removed from every document but the host's
first. A document left with too little is rejected. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import BLANKS, WORD, let, normal_line, words
from ledgerlake.session import written

WINDOW = 5
#: A line is above the limit in more documents than the first number, whatever the host's size; on a small host
#: in more than the share of its documents, once there are more than the second number.
LINE_DOCUMENTS = 75
LINE_SHARE, SHARE_DOCUMENTS = 0.10, 10
#: Least share of its words that a document keeps.
LEAST_LEFT = 0.30
SYMBOLS = r"[#*$%&|<>]"


def repeat_words(listed: Column, window: int = WINDOW) -> Column:
    """Words that lie in windows found twice or more, the first one included.

    Windows are compared by a 64-bit hash chained over their words. Sorted by hash, equal windows
    are neighbours; the stretches they cover are then added up in order of position.
    """
    def hashed(listed: Column) -> Column:
        return F.when(
            F.size(listed) >= window,
            F.transform(
                F.sequence(F.lit(0), F.size(listed) - window),
                lambda i: F.xxhash64(*[listed[i + k] for k in range(window)]),
            ),
        ).otherwise(F.array().cast("array<bigint>"))

    def covered(pairs: Column) -> Column:
        again = F.filter(
            pairs,
            lambda p, i: ((i > 0) & (F.get(pairs, i - 1)["h"] == p["h"]))
            | ((i < F.size(pairs) - 1) & (F.get(pairs, i + 1)["h"] == p["h"])),
        )
        places = F.sort_array(F.transform(again, lambda p: p["i"]))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-window).alias("at"))
        total = F.aggregate(
            places, start,
            lambda a, i: F.struct((a["n"] + F.least(F.lit(window), i - a["at"])).alias("n"), i.alias("at")),
        )
        return total["n"]

    def counted(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("int").alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(pairs, covered))

    # The words are bound, so that no optimizer rule can put their split inside the loops.
    return let(let(listed, hashed), counted)


def measures(docs: DataFrame, host: str = "source") -> DataFrame:
    """(doc_id, host, content, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed).

    One row per row of ``docs``; null texts count as empty. ``content`` is a hash of the text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    listed = docs.select(
        "doc_id", F.col(host).alias("host"), F.xxhash64("text").alias("content"), words(F.col("text")).alias("_w"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "").alias("_lines"),
    )
    counted = listed.select(
        "doc_id", "host", "content", F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"), "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("_w")).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def line_words(docs: DataFrame, host: str = "source") -> DataFrame:
    """(host, content, line, doc_id, n_words): each distinct normalised line of each distinct text.

    Lines without letters or digits are left out. Rows of one host with equal texts are one
    document, so exact copies never push a line over the limit; ``doc_id`` is the least of
    theirs and ``n_words`` the words the line has in all of them together.
    """
    whole = docs.select("doc_id", F.col(host).alias("host"), F.xxhash64("text").alias("content"), "text")
    lines = whole.select("doc_id", "host", "content", F.explode(F.split("text", "\n")).alias("_l"))
    named = lines.select(
        "doc_id", "host", "content", normal_line(F.col("_l")).alias("_l"),
        F.regexp_count("_l", F.lit(WORD)).cast("long").alias("_n"),
    ).where("_l <> ''")
    return named.groupBy("host", "content", F.xxhash64("_l").alias("line")).agg(
        F.min("doc_id").alias("doc_id"), F.sum("_n").alias("n_words")
    )


def removed_lines(
    docs: DataFrame, host: str = "source", documents: int = LINE_DOCUMENTS, share: float = LINE_SHARE, share_documents: int = SHARE_DOCUMENTS
) -> DataFrame:
    """(host, content, lines, removed): per distinct text, hashes and words of the lines it loses.

    A line is lost where more than ``documents`` distinct documents of the host have it, or more than
    ``share_documents`` and more than ``share`` of them; the document with the least id keeps it. Texts that lose nothing
    are absent. Both groupings sum inside the map tasks first, so a line that every document has
    costs one row per task.
    """
    lines = written(line_words(docs, host), "lines")
    texts = docs.select(F.col(host).alias("_h"), F.xxhash64("text").alias("_c"))
    copies = written(texts.groupBy("_h", "_c").agg(F.count(F.lit(1)).alias("_copies")), "copies")
    hosts = copies.groupBy("_h").agg(F.count(F.lit(1)).alias("_all"))
    per_line = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("_docs"), F.min("doc_id").alias("_first"))
    above = (
        per_line.where(F.col("_docs") > min(documents, share_documents))
        .join(hosts, F.col("host").eqNullSafe(F.col("_h")))
        .where((F.col("_docs") > documents) | (F.col("_docs") > share_documents) & (F.col("_docs") > F.col("_all") * share))
        .select(F.col("host").alias("_h"), F.col("line").alias("_l"), "_first")
    )
    hit = lines.join(above, F.col("host").eqNullSafe(F.col("_h")) & (F.col("line") == F.col("_l"))).where(
        ~F.col("doc_id").eqNullSafe(F.col("_first"))
    )
    lost = hit.groupBy("host", "content").agg(F.collect_list("line").alias("lines"), F.sum("n_words").alias("_sum"))
    return lost.join(copies, F.col("host").eqNullSafe(F.col("_h")) & (F.col("content") == F.col("_c"))).select(
        "host", "content", "lines", (F.col("_sum") / F.col("_copies")).cast("long").alias("removed")
    )


def verdicts(docs: DataFrame, host: str = "source", least_left: float = LEAST_LEFT, **limits) -> DataFrame:
    """``measures`` with removed and kept: base rules passed, and enough words left without the shared lines.

    ``docs`` has doc_id, text and the host column; others are ignored. Every row gets a verdict,
    repeated ones alike; null and empty texts fail for want of words; an empty table gives none.
    """
    measured = measures(docs, host)
    lost = removed_lines(docs, host, **limits).select(
        F.col("host").alias("_h"), F.col("content").alias("_c"), "lines", F.col("removed").alias("_removed")
    )
    joined = measured.join(
        lost, F.col("host").eqNullSafe(F.col("_h")) & (F.col("content") == F.col("_c")), "left"
    ).withColumn("removed", F.coalesce("_removed", F.lit(0)))
    enough = F.col("n_words") - F.col("removed") >= F.col("n_words") * least_left
    return joined.withColumn("kept", ~F.col("base_failed") & enough).drop("_h", "_c", "_removed")


def cleaned(docs: DataFrame, host: str = "source", least_left: float = LEAST_LEFT, **limits) -> DataFrame:
    """The rows of ``docs`` that pass, without their lines above the limit; columns as given.

    The verdict belongs to a text and its host, so it is joined on their hash once per text.
    """
    judged = verdicts(docs, host, least_left, **limits).where("kept").groupBy("host", "content").agg(
        F.first("lines").alias("lines")
    ).select(F.col("host").alias("_h"), F.col("content").alias("_c"), F.col("lines").alias("_lost"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(host).alias("_host"), F.xxhash64("text").alias("_content"))
    joined = rows.join(judged, F.col("_host").eqNullSafe(F.col("_h")) & (F.col("_content") == F.col("_c")))
    left = F.array_join(
        F.filter(F.split("_row.text", "\n"), lambda x: ~F.array_contains(F.col("_lost"), F.xxhash64(normal_line(x)))), "\n"
    )
    text = F.when(F.col("_lost").isNull(), F.col("_row.text")).otherwise(left)
    return joined.select(*[(text if c == "text" else F.col("_row").getField(c)).alias(c) for c in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, the four measures, base_failed and kept."""
    return verdicts(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
