"""Word shingles of whole texts as sets of 64-bit hashes, for tasks that run over Arrow batches."""

from __future__ import annotations

import hashlib
import re
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import cloudpickle

# Task functions are shipped by value: workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE = 5
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))


def texts_of(column: pa.Array) -> list[bytes]:
    """A text column as UTF-8 bytes; null is empty."""
    return [t or b"" for t in pc.cast(column, pa.binary()).to_pylist()]


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``x``; a bijection of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_STRETCH = 1 << 22  # bytes whose words are listed at once


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of a text's words, in order; long texts are split a stretch at a time."""
    found, at = [], 0
    while at < len(text):
        cut = len(text)
        if cut - at > _STRETCH:
            blank = _BLANK.search(text, at + _STRETCH)
            cut = blank.start() if blank else cut
        words = text[at:cut].split()
        found.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words)))
        at = cut
    return np.concatenate(found) if found else np.empty(0, dtype=np.uint64)


def shingle_set(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes of a text with A-Z lower-cased.

    Texts of fewer than ``width`` words have one shingle, the whole sequence; texts without
    words have none.
    """
    hashes = word_hashes(text.lower())
    if not len(hashes):
        return hashes
    take = min(width, len(hashes))
    rolled = np.full(len(hashes) - take + 1, take, dtype=np.uint64)
    for i in range(take):
        rolled = rolled * _MIX[2] + hashes[i : i + len(rolled)]
        rolled ^= rolled >> np.uint64(29)
    return np.unique(mixed(rolled))


def fingerprint(shingles: np.ndarray) -> int:
    """A signed 64-bit digest of a whole set."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "big", signed=True)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int(np.count_nonzero(b[at] == a))
