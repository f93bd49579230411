"""Expressions and helpers that several of these operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What separates words: space and the ASCII controls tab to carriage return.
BLANKS = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    """The words of a text, in order; an empty array for null or blank texts."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z lower-cased and nothing else changed."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def normal_line(line: Column) -> Column:
    """A line in lower case, every run of anything but letters and digits one space."""
    return F.btrim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "))


def unit_hash(*parts: Column) -> Column:
    """A reproducible number from 0 up to, but not including, 1; nulls hash like no other text."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("\x00null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Equality on the named columns, nulls equal."""
    out = F.lit(True)
    for name in names:
        out = out & left[name].eqNullSafe(right[name])
    return out


def running_index(rows: DataFrame, group: list[str], lead: list[str], spread: list[str], order: list[str], slices: int = 64) -> DataFrame:
    """``rows`` with ``_index``, a dense number from 0 within each group.

    Rows are numbered inside slices (group, lead, hash of ``spread``) and each slice starts where
    the one before it ended, so a group of any size is never sorted by one task. ``lead``
    columns must take few values per group: they and the slices are summed in one window. The
    order in a group is by lead, then slice, then ``order``; it is the same on every run.
    """
    parts = [*group, *lead, "_slice"]
    marked = rows.withColumn("_slice", F.floor(unit_hash(*[F.col(c) for c in spread]) * slices).cast("int"))
    counts = marked.groupBy(*parts).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy(*lead, "_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(
        *[F.col(c).alias(f"_s{i}") for i, c in enumerate(parts)], "_start"
    )
    inside = marked.withColumn("_row", F.row_number().over(Window.partitionBy(*parts).orderBy(*order)))
    on = F.lit(True)
    for i, c in enumerate(parts):
        on = on & F.col(c).eqNullSafe(F.col(f"_s{i}"))
    joined = inside.join(starts, on)
    return joined.withColumn("_index", F.col("_start") + F.col("_row") - 1).drop(
        *[f"_s{i}" for i in range(len(parts))], "_slice", "_row", "_start"
    )


#: Bits of the filter that :func:`narrowed` broadcasts: 2 MB however many keys there are.
FILTER_BITS = 1 << 24


def narrowed(rows: DataFrame, keys: DataFrame, name: str, bits: int = FILTER_BITS) -> DataFrame:
    """The rows whose ``name`` is in ``keys``: a semi-join that shuffles few rows when few match.

    The keys are hashed into a bitmap of a fixed number of bits, and only that is broadcast; rows
    that hit no set bit are dropped inside the scan. What passes by chance goes in the exact
    semi-join that follows, so the result is the same however full the bitmap is.
    """
    spot = F.pmod(F.xxhash64(name), F.lit(bits))
    bitmaps = keys.groupBy(F.bitmap_bucket_number(spot).alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("_bits")
    )
    at = F.bitmap_bit_position(F.pmod(F.xxhash64(rows[name]), F.lit(bits)))
    byte = F.conv(F.hex(F.substring(bitmaps["_bits"], (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1
    bucket = F.bitmap_bucket_number(F.pmod(F.xxhash64(rows[name]), F.lit(bits)))
    passed = rows.join(F.broadcast(bitmaps), (bucket == bitmaps["_bucket"]) & is_set, "left_semi")
    return passed.join(keys.select(name).distinct(), name, "left_semi")
