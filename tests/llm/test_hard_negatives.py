"""Hard negatives against scores of all pairs, and what the trees promise."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from greenlattice.llm import hard_negatives as hn

SCHEMA = "vec_id long, label int, vector array<long>, _bucket string, _cell string, score int"


def plain(rows, is_anchor, positives=5, negatives=5, low=80, high=100):
    """Rows of the result by nested loops."""
    kept = {}
    for vec_id, label, vector in rows:
        if vec_id is not None and label is not None and vector is not None and None not in vector:
            kept[vec_id] = min(kept.get(vec_id, (label, list(vector))), (label, list(vector)))

    def score(x, y):
        return max(hn.LEAST, min(hn.MOST, sum(a * b for a, b in zip(x, y))))

    out = []
    for anchor in filter(is_anchor, kept):
        label, vector = kept[anchor]
        ranked = sorted((-score(vector, v), i, x) for i, (x, v) in kept.items() if i != anchor)
        for s, positive, _ in [r for r in ranked if r[2] == label][:positives]:
            window = [r for r in ranked if r[2] != label and low * -s <= 100 * -r[0] <= high * -s]
            out += [(anchor, positive, n + 1, r[1], -s, -r[0]) for n, r in enumerate(window[:negatives])]
    return sorted(out)


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA).repartition(parts)


def clustered(n, dims, seed, labels=4):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(8, dims)) * 100
    of = rng.integers(0, 8, n)
    vectors = np.floor(middles[of] + rng.normal(size=(n, dims)) * 12).astype(int)
    return [(i, int((of[i] + (rng.random() < 0.4)) % labels), vectors[i].tolist()) for i in range(n)]


def mined(spark, rows, every=10, **kw):
    return sorted(map(tuple, hn.mine(frame(spark, rows), F.col("vec_id") % every == 0, **kw).collect()))


@pytest.mark.parametrize("shard_rows,block", [(2048, 1024), (60, 7)])
def test_equals_all_pairs(spark, monkeypatch, shard_rows, block):
    if block == 7:
        monkeypatch.setattr(hn, "ROOTS", 3)
    rows = clustered(700, 12, 1)
    assert mined(spark, rows, shard_rows=shard_rows, block=block) == plain(rows, lambda i: i % 10 == 0)


def test_odd_rows(spark):
    rows = clustered(150, 5, 2)
    rows += [(1000 + i, 1, [9, 9, 9, 9, 9]) for i in range(120)] + [(2000 + i, 2, [9, 9, 9, 9, 9]) for i in range(120)]  # copies, ties
    rows += [(None, 1, [1, 2, 3, 4, 5]), (3000, None, [1, 2, 3, 4, 5]), (3010, 1, None), (3020, 1, [1, None, 3, 4, 5])]
    rows += [(3030, 3, [0, 0, 0, 0, 0]), (3040, 1, []), (3050, 2, [7, 7]), (3060, 77, [1, 2, 3, 4, 5])]
    rows += [(0, 3, rows[0][2]), (5, *rows[5][1:]), (5, *rows[5][1:])]  # shared and repeated ids
    assert mined(spark, rows, shard_rows=40, block=16) == plain(rows, lambda i: i % 10 == 0)


def test_wide_components(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i % 3, [int(x) for x in rng.integers(-2**40, 2**40, 3)]) for i in range(90)]
    assert mined(spark, rows) == plain(rows, lambda i: i % 10 == 0)
    rows = [(i, i % 3, [int(x) for x in rng.integers(-2**28, 2**28, 6)]) for i in range(90)]
    assert mined(spark, rows) == plain(rows, lambda i: i % 10 == 0)


def test_empty_and_single(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, None, [1])]) == []
    assert mined(spark, [(0, 1, [1, 2])]) == []


def test_trees_cover_all_rows():
    rng = np.random.default_rng(3)
    rows = rng.integers(-99, 99, (900, 6))
    rows[:300] = rows[0]
    norm = float(np.sqrt((rows.astype(float) ** 2).sum(axis=1).max()))
    points = hn.raised(rows, norm)
    assert np.allclose((points**2).sum(axis=1), norm * norm)
    tree = hn.Tree(points, norm, leaf=8)
    assert sorted(tree.order) == list(range(900))
    leaves = 0
    for node, kids in enumerate(tree.kids):
        own = tree.order[tree.begin[node]:tree.end[node]]
        assert tree.away(points[own], points[tree.centre[node]]).max() <= tree.radius[node] + 1e-9
        if kids:
            under = range(tree.first[node], tree.first[node] + kids)
            assert [tree.begin[k] for k in under] == [tree.begin[node], *[tree.end[k] for k in under][:-1]]
            assert tree.end[under[-1]] == tree.end[node] and all(tree.radius[k] <= tree.radius[node] + 1e-9 for k in under)
        else:
            leaves += len(own)
    assert leaves == 900
    q = rng.integers(-99, 99, 6).astype(float)
    low, high = hn.bounds(points[tree.centre][:, :6] @ q, float(np.sqrt(q @ q)), norm, np.array(tree.radius))
    for node in range(len(tree.kids)):
        score = rows[tree.order[tree.begin[node]:tree.end[node]]] @ q
        assert low[node] <= score.min() and score.max() <= high[node]


def test_best_first_search_opens_few_leaves(monkeypatch):
    """On clustered rows a search verifies a small share of them."""
    rows = clustered(4000, 8, 5)
    vectors = np.array([r[2] for r in rows])
    norm = float(np.sqrt((vectors.astype(float) ** 2).sum(axis=1).max()))
    tree = hn.Tree(hn.raised(vectors, norm), norm)
    place = np.argsort(tree.order)
    shard = hn.Shard({"ids": tree.order, "labels": np.array([r[1] for r in rows])[tree.order], "vectors": vectors[tree.order].ravel(),
                      "centre": place[tree.centre], "radius": np.array(tree.radius), "begin": tree.begin, "end": tree.end, "first": tree.first,
                      "kids": tree.kids}, 8, norm, True)
    seen = []
    inner = hn.inner
    monkeypatch.setattr(hn, "inner", lambda r, q, exact: seen.append(len(r)) or inner(r, q, exact))
    found = shard.search(vectors[0], 0, rows[0][1], True, np.array([hn.LEAST]), np.array([hn.MOST]), 5)
    score = vectors @ vectors[0]
    best = sorted((-score[i], i) for i in range(1, 4000) if rows[i][1] == rows[0][1])[:5]
    assert [(-s, i) for _, s, i in found] == best and sum(seen) < 1200
