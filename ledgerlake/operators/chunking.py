"""Markdown documents to search chunks, as column expressions over whole documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.text import strip

# ---- fixed values: chunk sizes in characters ----
MIN_CHARS = 120
MAX_CHARS = 4000

_HEADING = r"(?md)^(#{2,3})\s+(.+)$"


def cleaned(markdown: Column) -> Column:
    """Text without front matter, fenced code, table lines and comments."""
    text = F.regexp_replace(markdown, r"\r\n?", "\n")
    text = F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n", "")
    text = F.regexp_replace(text, r"(?s)```.*?```", "")
    text = F.regexp_replace(text, r"(?md)^[ \t\f]*\|[^\n]*(?:\n|\z)", "")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def _title_case(text: Column) -> Column:
    """Each run of letters with its first letter raised."""
    runs = F.regexp_extract_all(text, F.lit("[A-Za-z]+|[^A-Za-z]+"), F.lit(0))
    raised = F.transform(
        runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substr(r, F.lit(2))))
    )
    return F.array_join(raised, "")


def document_title(body: Column, path: Column) -> Column:
    """The first level-one heading, else the file name in words."""
    heading = strip(F.regexp_extract(body, r"(?md)^#\s+(.+)$", 1))
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.when(heading != "", heading).otherwise(_title_case(F.replace(stem, F.lit("-"), F.lit(" "))))


def packed(text: Column, limit: int = MAX_CHARS) -> Column:
    """Paragraphs packed into pieces of at most ``limit`` characters, never cut inside one."""
    paragraphs = F.split(text, "\n\n", -1)
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(state: Column, paragraph: Column) -> Column:
        full = (state["open"] != "") & (F.length(state["open"]) + F.length(paragraph) + 2 > limit)
        return F.struct(
            F.when(full, F.concat(state["done"], F.array(strip(state["open"]))))
            .otherwise(state["done"])
            .alias("done"),
            F.when(full | (state["open"] == ""), paragraph)
            .otherwise(F.concat(state["open"], F.lit("\n\n"), paragraph))
            .alias("open"),
        )

    def close(state: Column) -> Column:
        rest = strip(state["open"])
        return F.when(rest != "", F.concat(state["done"], F.array(rest))).otherwise(state["done"])

    return F.when(F.length(text) <= limit, F.array(text)).otherwise(
        F.aggregate(paragraphs, empty, add, close)
    )


def sections(body: Column) -> Column:
    """Array of (heading, text): the opening text with a null heading, then each H2 or H3 section."""
    texts = F.split(body, _HEADING, -1)
    headings = F.concat(
        F.array(F.lit(None).cast("string")), F.regexp_extract_all(body, F.lit(_HEADING), F.lit(2))
    )
    return F.zip_with(
        headings, texts, lambda h, t: F.struct(strip(h).alias("heading"), strip(t).alias("text"))
    )


def chunk_markdown(documents: DataFrame) -> DataFrame:
    """Chunks (doc_id, title, category, source_path, content) of documents (path, category, markdown).

    The opening text is one chunk; longer sections are packed by paragraph. Texts under
    120 characters are dropped. The heading trail and the path stay with every chunk.
    """
    body = documents.select("path", "category", cleaned(F.col("markdown")).alias("body"))
    titled = body.select("path", "category", "body", document_title(F.col("body"), F.col("path")).alias("title"))
    long_enough = F.filter(sections(F.col("body")), lambda s: F.length(s["text"]) >= MIN_CHARS)
    pieces = F.flatten(
        F.transform(
            long_enough,
            lambda s: F.transform(
                F.when(s["heading"].isNull(), F.array(s["text"])).otherwise(packed(s["text"])),
                lambda piece: F.struct(s["heading"].alias("heading"), piece.alias("text")),
            ),
        )
    )
    exploded = titled.select("path", "category", "title", F.posexplode(pieces).alias("n", "piece"))
    trail = F.concat_ws(" — ", "title", "piece.heading")
    return exploded.select(
        F.concat("path", F.lit("#"), F.col("n").cast("string")).alias("doc_id"),
        trail.alias("title"),
        "category",
        F.col("path").alias("source_path"),
        F.concat(F.lit("["), "path", F.lit("] "), trail, F.lit("\n\n"), F.col("piece.text")).alias("content"),
    )


def _glob_to_regex(glob: str) -> str:
    """Path pattern as a regular expression: ``*`` stays in a folder, ``**/`` spans folders."""
    import re

    pieces = re.split(r"(\*\*/|\*)", glob)
    kinds = {"**/": "(?:[^/]+/)*", "*": "[^/]*"}
    return "^" + "".join(kinds.get(p, re.escape(p)) for p in pieces) + "$"


def classify_sources(
    files: DataFrame, sources: Sequence[tuple[str, str]], skip: Sequence[str] = ()
) -> DataFrame:
    """Files (path, …) with the category of the first pattern that matches; others are dropped."""
    category = F.coalesce(*[F.when(F.col("path").rlike(_glob_to_regex(g)), F.lit(c)) for g, c in sources])
    kept = files.where(~F.col("path").isin(list(skip))) if skip else files
    return kept.withColumn("category", category).where(F.col("category").isNotNull())
