"""Hard negatives against brute force over all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlake.llm import hard_negatives as mining

SMALL = {"codes": 4, "sample": 100, "block_rows": 16, "first_rows": 8}


def moved(vec_id, label):
    return (label + 1) % 10 if vec_id % 7 == 0 else label


def brute(rows):
    """Sorted results of (vec_id, embedding, label) rows; every row is one of its own."""
    held = []
    for vec_id, vector, label in rows:
        if None in (vec_id, vector, label) or any(x is None or not math.isfinite(x) for x in vector):
            continue
        held.append((vec_id, [math.floor(256 * float(x)) for x in vector], moved(vec_id, label)))
    out = []
    for i, (anchor, v, label) in enumerate(held):
        if anchor % 100:
            continue
        others = sorted((-sum(a * b for a, b in zip(v, w)), j, n, m) for n, (j, w, m) in enumerate(held) if n != i)
        for score, positive, _, _ in [o for o in others if o[3] == label][:5]:
            inside = [o for o in others if o[3] != label and 80 * -score <= 100 * -o[0] <= 100 * -score][:5]
            out += [(anchor, positive, rank, o[1], -score, -o[0]) for rank, o in enumerate(inside, 1)]
    return sorted(out)


def table(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")


def got(frame, **shape):
    return sorted(tuple(r) for r in mining.report(frame, **shape).collect())


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (6, 8))
    rows = []
    for i in range(1, 700):
        v = centres[i % 6] + rng.normal(0, 0.25, 8)
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(rng.integers(0, 4))))
    return rows


def test_every_result_and_no_other(spark, vectors):
    want = brute(vectors)
    assert len(want) > 50
    for shape in (SMALL, {"codes": 32}, {**SMALL, "first_rows": 1, "block_rows": 1000}):
        assert got(table(spark, vectors), **shape) == want


def test_very_common_vectors_and_ties(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [0.5, -0.5, 0.25, 0.25] if i % 3 else [float(x) for x in rng.integers(-2, 3, 4) / 2], i % 5) for i in range(400)]
    assert got(table(spark, rows), **SMALL) == brute(rows)


def test_messy_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (0, [0.9, 0.6], 2), (1, [1.0], 1), (2, [], 1), (3, None, 1), (4, [None, 1.0], 1), (5, [nan, 1.0], 1),
        (6, [inf, 1.0], 1), (None, [1.0, 1.0], 1), (8, [1.0, 0.25], None), (9, [0.9, 0.5], 3), (10, [0.8, 0.5], 1), (100, [-1.0, -1.0], 9),
        (101, [1.0, 1.0], 9), (102, [0.0, 0.0], 4), (200, [0.0, 0.0], 4), (201, [0.0, 0.0], 5),
    ]
    frame = spark.createDataFrame(
        [(*r, 1, "x", 2, 3) for r in rows], "vec_id long, embedding array<double>, label int, row int, block string, score int, `group` int"
    )
    want = brute(rows)
    assert want and got(frame) == want and got(frame, **SMALL) == want
    assert got(frame.limit(0)) == [] and got(frame.where("vec_id = 1")) == [] and got(frame.where("vec_id in (0, 9)").limit(1)) == []


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(5)
    for scale in (1e5, 3e6):  # sums past 2^53, whole in 64 bits
        rows = [(i, [float(x) for x in rng.normal(0, scale, 4)], int(i % 3)) for i in range(150)]
        assert got(table(spark, rows, "double"), **SMALL) == brute(rows)
    rows = [(i, [1e12, float(i)], 1) for i in range(3)]
    with pytest.raises(Exception, match="64 bits"):
        got(table(spark, rows, "double"), **SMALL)
    with pytest.raises(Exception, match="too large"):
        got(table(spark, [(0, [1e30], 1), (1, [1.0], 1)], "double"))


def test_no_product_leaves_its_cell_bounds(vectors):
    points = np.array([[math.floor(256 * x) for x in v] for _, v, _ in vectors])
    halves = mining._halves(points)
    books = tuple(mining.codebook(p, 5, s) for s, p in enumerate(halves))
    near = [mining._nearest(p, c) for p, c in zip(halves, books)]
    cells = {}
    for n in range(len(points)):
        key = int(near[0][0][n]), int(near[1][0][n])
        at = cells.setdefault(key, [0, 0.0, 0.0])
        cells[key] = [at[0] + 1, max(at[1], near[0][1][n]), max(at[2], near[1][1][n])]
    book = mining.plan([(*k, *v) for k, v in cells.items()], books, 50)
    assert int(book.rows.sum()) == len(points)
    for vector in points[:40]:
        seen = list(mining.visits(vector, book))
        assert [s[0] for s in seen] == sorted((s[0] for s in seen), reverse=True) and {s[2:] for s in seen} == set(cells)
        bounds = {s[2:]: s[:2] for s in seen}
        for n, product in enumerate(points @ vector):
            high, low = bounds[int(near[0][0][n]), int(near[1][0][n])]
            assert low <= product <= high


def test_far_cells_are_not_visited(spark, vectors):
    """Over well parted vectors most blocks are left out, with the same results."""
    rng = np.random.default_rng(6)
    rows = []
    for i in range(1, 4000):
        v = np.zeros(16)
        v[i % 8], v[8 + (i // 8) % 8] = 4, 4
        rows.append((i, [float(x) for x in v + rng.normal(0, 0.02, 16)], int(rng.integers(0, 3))))
    frame = table(spark, rows, "double")
    label = F.col("label").cast("long")
    index = mining.Index(mining.quantised(frame, F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)), codes=8, block_rows=64, first_rows=64)
    found, visits = mining.mined(index, F.col("vec_id") % 100 == 0)
    assert sorted(tuple(r) for r in found.collect()) == brute(rows)
    pairs = sum(v.count() for v in visits)
    assert pairs < 0.35 * index.blocks.count() * 39 * 2  # two whole searches would meet every block
