"""The Merkle manifest against a brute-force tree."""

import hashlib
import zlib

from ledgerlake.llm import merkle
from tests.llm.conftest import lower

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    values = (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def brute(rows):
    groups = {}
    for row in rows:
        key = (row["doc_id"] is not None, row["doc_id"] or 0, leaf(row, row["text"]))
        groups.setdefault(row["source"], []).append((key, row))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    members = {s: sorted(groups[s], key=lambda x: x[0]) for s in names}
    trees = {s: tree([key[2] for key, _ in members[s]]) for s in names}
    upper = tree([trees[s][-1][0] for s in names])
    out = []
    for place, s in enumerate(names):
        for i, (key, row) in enumerate(members[s]):
            doc_id, text = row["doc_id"], row["text"]
            tampered = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 and text is not None
            fold, beside = leaf(row, lower(text) if tampered else text), []
            for levels, at in ((trees[s], i), (upper, place)):
                for level in levels[:-1]:
                    low = at // 16 * 16
                    run, at_run = level[low : low + 16], at - low
                    beside += run[:at_run] + run[at_run + 1 :]
                    fold = h("".join(run[:at_run] + [fold] + run[at_run + 1 :]))
                    at //= 16
            root = upper[-1][0]
            out.append((doc_id, key[2], trees[s][-1][0], root, h("".join(beside)), fold, fold == root))
    return sorted(out, key=str)


def got(docs):
    return sorted((tuple(r) for r in merkle.report(docs).collect()), key=str)


def test_manifest_of_documents(documents):
    rows = [r.asDict() for r in documents.collect()]
    found = got(documents)
    assert found == brute(rows)
    assert 0 < sum(not r[-1] for r in found) < len(found)


def test_runs_that_are_full_over_full_or_of_one(spark):
    rows = []
    for size in (1, 2, 15, 16, 17, 33, 256, 257, 273):
        rows += [(i * 3, f"s{size}", "en", i, f"Text {i} of {size}") for i in range(size)]
    rows += [(i, f"ünïque {i}", None, None, "Ä") for i in range(20)]
    docs = spark.createDataFrame(rows, COLUMNS).repartition(7)
    names = COLUMNS.replace(",", "").split()[::2]
    assert got(docs) == brute([dict(zip(names, r)) for r in rows])


def test_one_row_is_the_root(spark):
    docs = spark.createDataFrame([(4, None, None, None, None)], COLUMNS)
    row = merkle.report(docs).first()
    assert row.leaf == row.subroot == row.root == h("1:4----") and row.proof_sha256 == h("")


def test_manifest_of_messy_rows(messy, nothing):
    clashing = messy.selectExpr("*", "'x' as tree", "1 as lo", "2 as hi", "'en' as lang", "length(text) as n_chars", "0 as digest")
    assert got(clashing) == brute([r.asDict() for r in clashing.collect()])
    empty = nothing.selectExpr("*", "'en' as lang", "1 as n_chars")
    assert merkle.report(empty).count() == 0


def test_intervals_are_dense_whatever_the_partitions(spark):
    rows = spark.range(0, 5000, 1, 13).selectExpr("if(id % 3 = 0, 'hot', cast(id % 7 as string)) as tree", "id % 50 as key", "unhex(md5(cast(id as string))) as digest")
    found = merkle.ranked(rows, ["key", "digest"]).collect()
    by_tree = {}
    for r in found:
        by_tree.setdefault(r.tree, []).append(r)
    for members in by_tree.values():
        members.sort(key=lambda r: r.lo)
        assert [r.lo for r in members] == list(range(len(members))) and {r.total for r in members} == {len(members)}
        assert [(r.key, r.digest) for r in members] == sorted((r.key, r.digest) for r in members)
        assert all(r.hi == r.lo + 1 for r in members)
