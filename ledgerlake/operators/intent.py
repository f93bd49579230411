"""Keyword intent scoring of questions, and shaping of catalogue search results."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.operators.ranking import latest_per_key

# ---- fixed values: keyword lists of each intent; {platform} stands for the platform's name ----
PLATFORM_WORDS = (
    "adr", "architecture", "how does {platform}", "how is {platform}", "why did we",
    "why was", "runbook", "deploy", "terraform", "module", "repo",
    "gateway", "registry", "pipeline", "ci", "cicd", "eval harness",
    "increment", "reference implementation", "decision record", "codebase",
    "implemented", "supported", "what does {platform}",
    "for {platform}", "in {platform}", "of {platform}", "{platform}'s",
    "auth pattern", "authentication", "sign-in", "sign in", "oauth",
    "token budget", "budget", "rate limit", "quota", "service account",
    "identity", "persona", "permission", "iam", "scope",
    "agent", "canary", "drift", "pinning", "model version",
    "bigtable", "spanner", "firestore", "cloud run", "bigquery omni",
    "schema of", "how do you", "how do we", "does {platform}", "can {platform}",
)
KB_WORDS = (
    "fee", "polic", "hour", "branch", "atm", "open", "close", "term", "condition",
    "privacy", "eligib", "require", "interest", "rate", "offer", "document", "contact",
    "support", "location", "how do i", "what is a", "limit", "disclosure",
)
ANALYTICS_WORDS = (
    "how many", "count", "number of", "total", "sum", "average", "avg", "median", "top",
    "most", "least", "list", "per segment", "by segment", "per customer", "distribution",
    "breakdown", "customers with", "which customer", "trend", "over time", "compare",
    "percentage", "ratio", "largest", "smallest", "highest", "lowest", "how much",
)
SEMANTICS_WORDS = (
    "what does", "what is a", "definition", "defined", "define", "mean", "how is",
    "calculated", "computed", "what columns", "what fields", "schema", "join",
    "related to", "what's in", "what is in", "contain", "which view", "which table",
    "data model", "column mean",
)
#: Intents in the order that wins a tie, with the weight of one keyword.
INTENTS = (("kb", KB_WORDS, 1), ("analytics", ANALYTICS_WORDS, 1), ("semantics", SEMANTICS_WORDS, 1), ("platform", PLATFORM_WORDS, 2))
DEFAULT_INTENT = "analytics"


def keyword_hits(question: Column, words: Sequence[str]) -> Column:
    """How many of the words occur at the start of a word; stems match their longer forms."""
    lowered = F.lower(F.coalesce(question, F.lit("")))
    total = F.lit(0)
    for w in words:
        # The plain search is far cheaper and settles almost every word.
        starts_word = lowered.rlike("(^|[^a-z0-9_])" + re.escape(w).replace("\\ ", " "))
        total = total + (lowered.contains(w) & starts_word).cast("int")
    return total


def score_intents(questions: DataFrame, text: str = "question", platform: str = "ledgerlake") -> DataFrame:
    """Questions with the score of every intent and the winning ``intent``."""
    scored = questions.withColumns(
        {
            f"{name}_score": keyword_hits(F.col(text), [w.format(platform=platform) for w in words]) * weight
            for name, words, weight in INTENTS
        }
    )
    best = F.greatest(*[F.col(f"{name}_score") for name, _, _ in INTENTS])
    chosen = F.coalesce(*[F.when(F.col(f"{name}_score") == best, F.lit(name)) for name, _, _ in INTENTS])
    return scored.withColumn("intent", F.when(best > 0, chosen).otherwise(DEFAULT_INTENT))


TERM_TYPES = ("glossary-term", "glossary-category")


def catalog_search(
    entries: DataFrame, words: str, environment: str, prefix: str = "ledger",
    matches: int | None = None, shown: int | None = None,
) -> DataFrame:
    """Entries matching ``words``, as the catalogue page lists them.

    ``entries`` has display_name, resource, entry_name, entry_type, governed and relevance
    (lower is better). Own assets of the environment and glossary terms are kept, once per
    (display_name, entry_type); of the ``matches`` most relevant, governed entries come
    first, terms next, then the rest, ``shown`` of them. Unset, neither limit applies.
    """
    is_term = F.col("entry_type").isin(*TERM_TYPES)
    own = F.col("resource").rlike(f"{prefix}[_-]") | F.col("entry_name").rlike(f"{prefix}[_-]")
    here = F.col("resource").contains(environment) | F.col("entry_name").contains(environment)
    hits = entries.where(F.lower("display_name").contains(words.lower()) & (is_term | (own & here)))
    once = latest_per_key(hits, ["display_name", "entry_type"], [F.asc("relevance"), F.asc("entry_name")])
    group = F.when(F.col("governed"), 0).when(is_term, 1).otherwise(2)
    found = once if matches is None else once.orderBy("relevance", "entry_name").limit(matches)
    listed = found.withColumn("display_group", group).orderBy("display_group", "relevance", "entry_name")
    return listed if shown is None else listed.limit(shown)
