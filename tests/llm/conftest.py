import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, slot string, size string, _n int, component int, line string, node string"


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def find(parent, a):
    while parent[a] != a:
        a = parent[a]
    return a


def union(parent, a, b):
    a, b = find(parent, a), find(parent, b)
    parent[max(a, b)] = min(a, b)


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty and blank texts, ties, repeated rows, a long text, clashing names."""
    prose = "The quick brown fox jumps over the lazy dog and then runs far away from here again"
    rows = [
        (1, prose, "a"), (1, prose, "a"), (2, prose, "b"), (3, None, "a"), (4, "", None), (5, " \t\n ", "b"),
        (None, prose + " today", "a"), (None, None, None), (6, "one two", "a"), (7, prose + "\n" + prose, None),
        (8, " ".join(f"w{i % 977}x{i}" for i in range(30_000)), "c"), (9, "###\n***\n###", "a"), (10, prose.upper(), "a"),
        (1, "another text under the same id as before, of some ten words", "a"),
    ]
    return spark.createDataFrame([(*r, "s", "z", 1, 2, "l", "n") for r in rows], DOCS)


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
