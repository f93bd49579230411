"""Stable fingerprints of text keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fingerprint(text: Column) -> Column:
    """The first 60 bits of the text's SHA-256, as a non-negative number."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def sampled(key: Column, rate: float) -> Column:
    """Whether a key falls in a fixed ``rate`` share of all keys; the same on every run."""
    if not 0 <= rate <= 1:
        raise ValueError("rate must be 0 to 1")
    return F.pmod(fingerprint(key), F.lit(1_000_000)) < int(rate * 1_000_000)
