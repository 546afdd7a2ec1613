"""Hard negatives against brute force and SQL; the tree's searches against full scans."""

import math
import random

import numpy as np
import pytest
from compare import compare, duck
from pyspark.sql import functions as F

from meteoqc.llm import hard_negatives as hn
from meteoqc.llm.hyperplane_tree import Search, Tree, annulus, inner_products, lifted

LABEL = lambda: F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
ANCHORS = lambda: F.col("vec_id") % 10 == 0


def brute(rows, every=10, positives=5, negatives=10):
    own = []
    for k, (i, v, label) in enumerate(rows):
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) or abs(x) >= 16384 for x in v):
            continue
        own.append((k, i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for k, i, v, label in own:
        if i % every:
            continue
        score = [(-sum(a * b for a, b in zip(v, w)), j, m, other) for m, j, w, other in own if len(w) == len(v) and m != k]
        score.sort()
        near = [(s, j) for s, j, _, other in score if other == label][:positives]
        for s, j in near:
            fits = [(t, n) for t, n, _, other in score if other != label and 30 * -s <= 100 * -t <= 90 * -s][:negatives]
            out += [(i, j, rank + 1, n, -s, -t) for rank, (t, n) in enumerate(fits)]
    return sorted(out)


def vectors(seed, n, width, labels=3, spread=0.25):
    rnd = random.Random(seed)
    centres = [[rnd.uniform(-1, 1) for _ in range(width)] for _ in range(4)]
    return [(i, [c + rnd.gauss(0, spread) for c in rnd.choice(centres)], rnd.randrange(labels)) for i in range(n)]


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed,n,width,sample,block,turn", [(1, 500, 4, 8192, 8192, 16384), (2, 600, 16, 64, 50, 7), (3, 300, 2, 200, 20, 3)])
def test_equals_brute_force(spark, seed, n, width, sample, block, turn):
    rows = vectors(seed, n, width)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    found = hn.hard_negatives(df, ANCHORS(), LABEL(), sample=sample, block=block, turn=turn)
    assert got(found) == brute(rows) != []


def test_odd_rows(spark):
    """Nulls, copies, repeated ids, zeros, several lengths, components too large, ties, clashing columns."""
    nan, inf = float("nan"), float("inf")
    rows = vectors(4, 80, 3) + [(200 + i, [0.5, 0.25, 0.125], i % 2) for i in range(60)]  # one vector, many ids
    rows += [(10, [0.5, 0.25, 0.125], 1), (10, [0.5, 0.25, 0.125], 1), (20, [0.1, 0.2, 0.3], 0), (20, [0.3, 0.2, 0.1], 0)]
    rows += [(300, None, 1), (310, [None, 1.0, 1.0], 1), (320, [nan, 1.0, 1.0], 1), (330, [inf, 0.0, 1.0], 0), (340, [1.0, 1.0, 1.0], None),
             (None, [1.0, 1.0, 1.0], 1), (350, [0.0, 0.0, 0.0], 1), (360, [1e9, 0.0, 0.0], 1), (370, [], 0), (371, [], 0), (372, [], 1)]
    rows += [(400 + i, [0.1 * i, -0.2 * i], i % 2) for i in range(30)]
    df = spark.createDataFrame([(*r, "x", 1, 2.0) for r in rows], "vec_id long, embedding array<double>, label int, cid string, low int, score double")
    assert got(hn.hard_negatives(df, ANCHORS(), LABEL(), sample=30, block=16, turn=4)) == brute(rows)


def test_empty_and_lonely(spark):
    kind = "vec_id long, embedding array<double>, label int"
    for rows in ([], [(10, [1.0, 2.0], 3)], [(10, [1.0, 2.0], 3), (20, [1.0, 2.0], 3)]):
        assert got(hn.hard_negatives(spark.createDataFrame(rows, kind), ANCHORS(), LABEL())) == []


@pytest.mark.parametrize("size", [1, 300, 1 << 21])
def test_search_finds_all_in_windows(size):
    rnd = np.random.default_rng(size)
    x = np.floor(rnd.normal(0, 1, (700, 6)) * size)
    labels = rnd.integers(0, 3, 700)
    q, own = np.vstack([x[:40], np.floor(rnd.normal(0, 1, (40, 6)) * size)]), rnd.integers(0, 3, 80)
    scores = np.array([[int(sum(int(a) * int(b) for a, b in zip(i, j))) for j in x] for i in q])
    assert (inner_products(q, x) == scores).all()
    low = np.sort(rnd.choice(scores.ravel(), (80, 2)), axis=1)
    low, high = np.column_stack([low[:, 0], low[:, 0]]), np.column_stack([low[:, 1], low[:, 0] - 1])  # one window and an empty one
    reach2 = float((x * x).sum(1).max())
    for same in (True, False):
        who, window, row, score = Search(x, labels, reach2, leaf=8).best(q, own, same, low, high, 4)
        assert (window == 0).all() and (scores[who, row] == score).all()
        for k in range(len(q)):
            fits = sorted((s for s, o in zip(scores[k], labels) if low[k, 0] <= s <= high[k, 0] and (o == own[k]) == same), reverse=True)
            assert sorted(score[who == k], reverse=True)[:4] == fits[:4]


def test_narrow_windows_leave_branches_out():
    """Ranges and annuli spare most leaves where rows have structure."""
    rnd = np.random.default_rng(5)
    x = np.floor(256 * np.repeat(rnd.normal(0, 1, (20, 8)), 100, axis=0) + rnd.normal(0, 4, (2000, 8)))
    reach2 = float((x * x).sum(1).max())
    tree = Tree(lifted(x, reach2))
    q = x[::100]
    high = (q * q).sum(1).astype(np.int64)[:, None]
    near, far = annulus(q, high - 20000, high, reach2, 1e-3)
    reached = tree.reached(np.column_stack([q, np.zeros(len(q))]), near, far)
    inside = (inner_products(q, x) >= high - 20000) & (inner_products(q, x) <= high)
    assert all(reached[k, leaf] for leaf, rows in enumerate(tree.members) for k in np.flatnonzero(inside[:, rows].any(1)))
    assert reached.mean() < 0.5


def test_query_matches_sql(spark, sf):
    n, problems = compare("op12", hn.op12_hard_negatives(spark, sf), duck(sf), hn.ORACLE)
    assert not problems and n > 100
