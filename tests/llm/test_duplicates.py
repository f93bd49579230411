"""Near duplicates, fuzzy lines and components against brute force."""

import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from ledgerlake.llm import line_dedup, near_dedup, shingles
from ledgerlake.llm.common import narrowed
from ledgerlake.llm.components import connected_components, merged_components
from ledgerlake.session import written
from tests.llm.conftest import find, lower, union, words


def test_components(spark):
    random.seed(3)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1120)]
    edges += [(2000, i) for i in range(2001, 2080)] + [(5, 5), (9000, 9000)]
    parent = {n: n for e in edges for n in e}
    for a, b in edges:
        union(parent, a, b)
    got = dict(tuple(r) for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    want = {n: find(parent, n) for e in edges if e[0] != e[1] for n in e}
    assert got == want
    none = spark.createDataFrame([], "a long, b long")
    assert connected_components(none).count() == 0
    half = connected_components(spark.createDataFrame(edges[::2], "a long, b long"))
    for known, more in ((half, edges[1::2]), (connected_components(none), edges)):
        got = dict(tuple(r) for r in merged_components(known, spark.createDataFrame(more, "a long, b long")).collect())
        assert got == want


def test_narrowed_is_a_semi_join(spark):
    rows = spark.range(2000).selectExpr("if(id % 7 = 0, null, id) as k", "id")
    keys = spark.createDataFrame([(i,) for i in (1, 5, 5, 1999, 700, 10**12)] + [(None,)], "k long")
    for bits in (1 << 24, 1 << 16):  # the smaller one lets strangers pass to the exact join
        assert sorted(r.k for r in narrowed(rows, keys, "k", bits).collect()) == [1, 5, 1999]


# ---- near duplicates ----


def shingle_texts(text):
    w = words(lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_classes(rows):
    """Expected (doc_id, n_shingles, component) of (doc_id, text) rows, as a counter."""
    sets = [(i, shingle_texts(t)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}
    held = [(i, s) for i, s in sets if s and i is not None]
    by_shingle = defaultdict(list)
    for at, (_, s) in enumerate(held):
        for x in s:
            by_shingle[x].append(at)
    pairs = {p for ats in by_shingle.values() for p in combinations(ats, 2)}
    for a, b in pairs:
        (i, s), (j, t) = held[a], held[b]
        if 100 * len(s & t) >= 75 * len(s | t):
            union(parent, i, j)
    return Counter((i, len(s), None if i is None else (find(parent, i) if s else i)) for i, s in sets)


def family(spark, members=60):
    """Near copies of one text with more and more words changed, and a few strangers that share half of it."""
    random.seed(8)
    base = [f"w{random.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(members):
        copy = list(base)
        for _ in range(random.choice((0, 1, 1, 2, 3, 4, 5))):
            copy[random.randrange(len(copy))] = f"x{random.randrange(10**6)}"
        rows.append((i * 3 + 1, " ".join(copy)))
    rows += [(1000 + i, " ".join(base[:60] + [f"y{i}z{j}" for j in range(60)])) for i in range(8)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_classes_of_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert Counter(tuple(r) for r in near_dedup.classes(documents).collect()) == brute_classes(rows)


def test_classes_of_a_family_in_crowded_regions(spark):
    rows, docs = family(spark)
    want = brute_classes(rows)
    for crowd in (1024, 16):
        assert Counter(tuple(r) for r in near_dedup.classes(docs, crowd=crowd).collect()) == want


def test_classes_of_a_template_crowd(spark):
    """Pages of one template, just not linked, with pairs that are: no region is small enough for all of them."""
    template = " ".join(f"t{j}" for j in range(89))
    rows = []
    for i in range(200):
        own = [f"u{i}w{j}" for j in range(15)]
        if i < 80:  # each two pages share one shingle more
            own[0] = f"pair{i // 2}"
        rows.append((i, f"{template} {' '.join(own)}"))
    want = brute_classes(rows)
    assert len({c for _, _, c in want}) == 200 - 40
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in near_dedup.classes(docs, crowd=8).collect()) == want


def test_estimates_rarely_drop_a_pair():
    """Chance that a pair at the limit has too few equal signature values to be confirmed."""
    from math import ceil, comb

    p, least = near_dedup.SIMILARITY / 100, ceil(near_dedup.LEAST_ESTIMATE * near_dedup.VALUES)
    assert sum(comb(near_dedup.VALUES, x) * p**x * (1 - p) ** (near_dedup.VALUES - x) for x in range(least)) < 1e-6


def test_classes_of_messy_rows(messy, nothing):
    got = near_dedup.classes(messy).collect()
    assert len(got) == messy.count()
    same_id = {r.doc_id: r.component_id for r in got}
    assert (same_id[1], same_id[2], same_id[3], same_id[4], same_id[5], same_id[9], same_id[10]) == (1, 1, 3, 4, 5, 9, 1)
    out = near_dedup.deduplicated(messy)
    ids = Counter(r.doc_id for r in out.collect())
    assert out.columns == messy.columns and ids[1] == 1 and ids[2] == 0 and ids[10] == 0 and ids[None] == 2 and ids[3] == 1
    assert near_dedup.report(nothing).count() == 0 and near_dedup.deduplicated(nothing).count() == 0


def test_only_the_rows_that_are_duplicates_go(spark):
    prose, other = (" ".join(f"{c}{i}" for i in range(40)) for c in "pq")
    docs = spark.createDataFrame([(1, prose), (2, prose), (2, other), (3, other)], "doc_id long, text string")
    assert sorted(tuple(r) for r in near_dedup.deduplicated(docs).collect()) == [(1, prose), (2, other)]


def test_shingles_of_long_texts_do_not_depend_on_the_stretch(monkeypatch):
    text = " ".join(f"w{i % 91}" for i in range(5000)).encode()
    whole = shingles.shingle_set(text)
    monkeypatch.setattr(shingles, "_STRETCH", 64)
    assert np.array_equal(whole, shingles.shingle_set(text))
    assert len(whole) == 91


# ---- fuzzy lines ----


def normal(line):
    return re.sub(r"[\W_]+", " ", line.lower()).strip(" ")


def brute_lines(spark, rows):
    """Removed (doc_id, at), and the number of like pairs, by edit similarity in characters over all pairs of lines."""
    places = defaultdict(list)
    for i, text in rows:
        for at, line in enumerate((text or "").split("\n")):
            if normal(line):
                places[normal(line)].append((i, at))
    lines = sorted(places)
    parent = {n: n for n in range(len(lines))}
    long = [(n, x) for n, x in enumerate(lines) if len(set(x.split(" "))) >= 5]
    table = spark.createDataFrame(long, "n int, x string").repartition(16)
    near = "abs(length(a.x) - length(b.x)) <= k and levenshtein(a.x, b.x, k) >= 0"
    pairs = table.alias("a").join(table.alias("b"), F.expr("a.n < b.n")).withColumn("k", F.expr("cast(floor(round(greatest(length(a.x), length(b.x)) * 0.1, 6)) as int)"))
    links = [(r[0], r[1]) for r in pairs.where(near).select("a.n", "b.n").collect()]
    for a, b in links:
        union(parent, a, b)
    groups = defaultdict(list)
    for n, x in enumerate(lines):
        groups[find(parent, n)] += places[x]
    return {p for g in groups.values() for p in set(g) - {min(g, key=str) if None in [i for i, _ in g] else min(g)}}, len(links)


def exact_removed(rows):
    """What equal lines alone remove."""
    places = defaultdict(list)
    for i, text in rows:
        for at, line in enumerate((text or "").split("\n")):
            if normal(line):
                places[normal(line)].append((i, at))
    return {p for g in places.values() for p in set(g) - {min(g)}}


def assert_recall(spark, rows, got, least):
    """All that goes should go, and of what only like lines explain at least this share does."""
    want, links = brute_lines(spark, rows)
    fuzzy = want - exact_removed(rows)
    assert links and got <= want and exact_removed(rows) <= got
    recall = len(got & fuzzy) / max(1, len(fuzzy))
    assert recall >= least, (recall, len(fuzzy))


def test_fuzzy_lines_of_a_family(spark):
    random.seed(5)
    base = [f"word{random.randrange(500)}" for _ in range(90)]
    rows = []
    for i in range(40):
        line = list(base)
        for _ in range(random.choice((0, 1, 1, 2, 3))):
            line[random.randrange(len(line))] = f"new{random.randrange(500)}"
        rows.append((i, " ".join(line) + "\nshort line\n" + f"line of its own number {i} " + " ".join(f"q{i}r{j}" for j in range(9))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.at) for r in line_dedup.removed(docs)[1].collect()}
    assert len(got) > 60
    assert_recall(spark, rows, got, 1.0)


def test_fuzzy_lines_of_documents(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = {(r.doc_id, at) for r in line_dedup.report(documents).collect() for at in r.removed_at}
    assert_recall(spark, rows, got, 0.9)


def test_a_mistyped_letter_and_rows_without_an_id(spark):
    a, b = "the careful reader finds nine different words here always", "the careful reeder finds nine different words here always"
    long_a = " ".join(f"w{i * 7919 % 4001}" for i in range(2000))
    long_b = long_a.replace("w7919", "x7919").replace(" w12 ", " w13 ")
    for extra in ([], [(None, b)], [(None, a)]):
        docs = spark.createDataFrame([(1, a), (2, b), (3, long_a), (4, long_b), *extra], "doc_id long, text string")
        gone = {r.doc_id for r in line_dedup.removed(docs)[1].collect()}
        assert gone == ({2, 4} if not extra else {1, 2, 4})


def test_fuzzy_lines_of_messy_rows(messy, nothing):
    out = line_dedup.deduplicated(messy)
    assert out.columns == messy.columns and out.count() == messy.count()
    texts = defaultdict(list)
    for r in out.collect():
        texts[r.doc_id].append(r.text)
    assert texts[3] == [None] and texts[4] == [""] and texts[9] == ["###\n***\n###"] and texts[5] == [" \t\n "]
    assert texts[2] == [""] and texts[7] == [""] and texts[10] == [""] and len(texts[8][0]) > 100_000
    assert line_dedup.report(nothing).count() == 0 and line_dedup.deduplicated(nothing).count() == 0
    plan = out._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_letter_counts_bound_the_edit_distance(spark):
    """Counts are never further apart than twice the edit distance, so the filter by them drops no like line."""
    draw = random.Random(5)
    letters = line_dedup.LETTERS + "xyzäß 0é"
    rows = []
    for _ in range(400):
        a = "".join(draw.choice(letters) for _ in range(draw.randrange(0, 60)))
        b = list(a)
        for _ in range(draw.randrange(0, 12)):
            at = draw.randrange(0, len(b) + 1)
            b[at : at + draw.randrange(0, 2)] = draw.choice(["", draw.choice(letters)])
        rows.append((a, "".join(b)))
    df = spark.createDataFrame(rows, "a string, b string")
    named = [c.alias(f"_{side}{name}") for side in "ab" for c, name in zip(line_dedup._bags(side), line_dedup._BAGS)]
    got = df.select(F.levenshtein("a", "b").alias("steps"), *named).select("steps", line_dedup._counts_apart("_a", "_b").alias("apart"))
    found = got.collect()
    assert all(r.apart <= 2 * r.steps for r in found)
    assert sum(r.apart > 0 for r in found) > 200


def test_candidates_fit_in_kind_and_size(spark, documents, monkeypatch):
    """Buckets of one kind meet no other kind, and no pair that its sizes rule out is looked at."""
    found = written(line_dedup.occurrences(documents), "lines")
    keys = line_dedup._keyed(found.select("simhash", *line_dedup._LONGEST).distinct())
    kinds = {r.simhash: set() for r in keys.select("simhash").distinct().collect()}
    for r in keys.collect():
        kinds[r.simhash].add(r.bucket >> line_dedup.BITS)
    assert all({k % 16 for k in v} <= {*range(10), 15} and len(v) >= 10 for v in kinds.values())
    asked, linked = [], line_dedup._linked
    monkeypatch.setattr(line_dedup, "_linked", lambda pairs, texts, s: asked.append((pairs, texts)) or linked(pairs, texts, s))
    line_dedup.removed(documents)[1].count()
    assert len(asked) == 2
    for pairs, texts in asked:
        sized = pairs.join(texts.select(F.col("line").alias("a"), F.col("size").alias("x")), "a").join(texts.select(F.col("line").alias("b"), F.col("size").alias("y")), "b")
        assert sized.where("abs(x - y) > floor(round(greatest(x, y) * 0.1, 6))").isEmpty()


def crowd(spark, members):
    """A line that occurs three times and copies of it, like it for the most part but seldom like each other."""
    draw = random.Random(11)
    base = [f"w{draw.randrange(10**6)}" for _ in range(60)]
    rows = [(i, " ".join(base)) for i in range(3)]
    for i in range(members):
        line = list(base)
        for at in draw.sample(range(60), draw.choice((4, 6, 7, 8))):
            line[at] = f"x{draw.randrange(10**6)}"
        rows.append((10 + i, " ".join(line)))
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_pairs_of_a_crowd_are_no_rows(spark, monkeypatch):
    """Copies of one line are compared with it; pairs that are not like each other never leave the bucket's join."""
    asked, linked = [], line_dedup._linked
    monkeypatch.setattr(line_dedup, "_linked", lambda pairs, texts, s: asked.append(pairs.count()) or linked(pairs, texts, s))
    made = {}
    for members in (60, 240):
        del asked[:]
        assert line_dedup.removed(crowd(spark, members)[1])[1].count() > members / 3
        made[members] = sum(asked)
    assert made[240] <= 6 * made[60] and made[240] <= 8 * 240


def test_slices_of_a_bucket_lose_no_link(spark, monkeypatch):
    rows, docs = crowd(spark, 80)
    monkeypatch.setattr(line_dedup, "CROWD", 4)
    got = {(r.doc_id, r.at) for r in line_dedup.removed(docs)[1].collect()}
    assert_recall(spark, rows, got, 0.9)


def test_lines_are_told_soon(spark):
    """What is told without the whole edit distance is true, and copies with a few places changed are told so."""
    draw = random.Random(13)
    rows = []
    for i in range(300):
        line = [f"w{draw.randrange(10**4)}é" for _ in range(60)] if i % 2 else [w for w in "abcde" for _ in range(draw.randrange(1, 40))]
        copy = list(line)
        for _ in range(draw.randrange(0, 3) if i < 200 else 14):
            at = draw.randrange(len(copy))
            copy[at : at + draw.randrange(0, 2)] = draw.choice([[], [copy[at]], [f"new{at}"]])
        rows.append((" ".join(line), " ".join(copy)))
    rows += [("a", "b"), ("a" * 32, "a" * 32), ("a" * 33, "b" * 65), (" ".join(["thor"] * 900), " ".join(["thor"] * 990))]
    df = spark.createDataFrame(rows, "x string, y string").withColumn("most", line_dedup._edits("length(x)", "length(y)", 0.9))
    soon = [line_dedup._patched("x", "y", "most").alias("patched"), line_dedup._rerun("x", "y").alias("rerun"), line_dedup._replaced("x", "y").alias("replaced")]
    found = df.select("most", F.levenshtein("x", "y").alias("steps"), *soon).collect()
    assert all(r.patched >= min(r.steps, r.most + 1) and r.rerun >= r.steps for r in found)
    like = [min(r.patched, r.rerun, r.replaced) <= r.most for r in found if r.steps <= r.most]
    assert sum(like) >= 0.8 * len(like) > 150 and found[-1].rerun == found[-1].steps == 450


def test_a_line_is_normalised_and_its_words_are_counted_once(spark):
    """Copies of a line cost no words again, and a line's normal form is not computed again by a filter."""
    docs = spark.createDataFrame([(i, "one two three four five six") for i in range(50)], "doc_id long, text string")
    plan = line_dedup._placed(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1
    counted = []
    hashed = line_dedup._hashed
    line_dedup._hashed = lambda lines, *names: counted.append(lines.count()) or hashed(lines, *names)
    try:
        assert line_dedup.removed(docs)[1].count() == 49
    finally:
        line_dedup._hashed = hashed
    assert counted == [1]


def test_replaced_words_bound_the_edit_distance(spark):
    """Links told from words at the same place are true: what they cost is never below the edit distance."""
    draw = random.Random(7)
    line = lambda n: " ".join("".join(draw.choice("abcé") for _ in range(draw.randrange(1, 6))) for _ in range(n))
    rows = [(line(draw.randrange(1, 9)), line(draw.randrange(1, 9))) for _ in range(300)]
    df = spark.createDataFrame([*rows, ("a b c", "a b c")], "x string, y string")
    found = df.select(line_dedup._replaced("x", "y").alias("most"), F.levenshtein("x", "y").alias("steps")).collect()
    assert all(r.most >= r.steps for r in found) and found[-1].most == 0
