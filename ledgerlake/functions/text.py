"""Tokens and numbers in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: what a search token and a number look like ----
TOKEN_PATTERN = r"\$?[a-z0-9](?:[a-z0-9.\-]*[a-z0-9])?%?"
NUMBER_PATTERN = r"-?[0-9]+\.?[0-9]*"


def tokens(text: Column) -> Column:
    """Lower-case tokens of two or more characters; currency, percent and zip forms survive."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(
        F.regexp_extract_all(lowered, F.lit(TOKEN_PATTERN), F.lit(0)), lambda t: F.length(t) > 1
    )


def numbers(text: Column) -> Column:
    """Distinct number texts, in order of first use."""
    return F.array_distinct(
        F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER_PATTERN), F.lit(0))
    )


def strip(text: Column) -> Column:
    """Text without white space at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")
