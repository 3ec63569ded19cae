from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from flowlens.llm import hard_negatives, topk_search

SCHEMA = "vec_id long, embedding array<double>, label int, rank string, part int"


def vectors(seed, n=150, dims=6, spread=1.0):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(8)]
    rows = []
    for i in range(n):
        v = [x + r.gauss(0, spread) for x in r.choice(centres)]
        if i % 9 == 0 and rows:
            v = list(r.choice(rows)[1])  # repeated vectors make ties
        rows.append((i, v, r.randrange(3), "x", i))
    rows += [(i, list(rows[i][1]), 1, "y", i) for i in (0, 20, 40)]  # ids of two rows
    odd = [None, [1.0, None], [math.nan] * 6, [math.inf, 0.0], [1e300], [], [0.5], [3.0] * 8]
    rows += [(1000 + 10 * i, v, 2, None, None) for i, v in enumerate(odd)]
    return rows + [(None, [1.0] * dims, 1, "z", 0), (10, [2.0] * dims, None, "z", 0)]


def whole(rows, scale):
    """Rows that take part, with whole components."""
    out = []
    for vec_id, v, label, *_ in rows:
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = [math.floor(scale * x) for x in v]
        if sum(x * x for x in v) < 2**62:
            out.append((vec_id, v, label))
    return out


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))


def order(row, score):
    return (-score, row[0] is None, row[0] or 0)


def plain_top(rows, k, step):
    out = []
    for i, (q, v, _) in enumerate(rows):
        if q is not None and q % step == 0:
            scored = [(order(r, dot(v, r[1])), r[0], dot(v, r[1])) for j, r in enumerate(rows) if j != i]
            out += [(q, n + 1, c, s) for n, (_, c, s) in enumerate(sorted(scored, key=lambda x: x[0])[:k])]
    return out


def plain_negatives(rows, step, most):
    rows = [r for r in rows if r[2] is not None]
    out = []
    for i, (a, v, label) in enumerate(rows):
        if a is None or a % step:
            continue
        scored = sorted(
            ((order(r, dot(v, r[1])), r[0], dot(v, r[1]), r[2]) for j, r in enumerate(rows) if j != i),
            key=lambda x: x[0],
        )
        for _, p, ps, _ in [x for x in scored if x[3] == label][:5]:
            inside = [x for x in scored if x[3] != label and 50 * ps <= 100 * x[2] <= 95 * ps][:most]
            out += [(a, p, n + 1, x[1], ps, x[2]) for n, x in enumerate(inside)]
    return out


def same(frame, expected):
    assert sorted(map(tuple, frame.collect()), key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize(("fragments", "shard", "block", "k"), [(4, 4096, 2048, 10), (1, 40, 3, 2), (3, 2, 7, 5)])
def test_top_k_equals_full_comparison(spark, fragments, shard, block, k):
    rows = vectors(shard)
    table = spark.createDataFrame(rows, SCHEMA)
    out = topk_search.top_k(table, F.expr("vec_id % 10 = 0"), k, fragments=fragments, shard=shard, block=block)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    same(out, plain_top(whole(rows, 1024), k, 10))


def test_collected_rows_are_sufficient():
    import numpy as np

    r = np.random.default_rng(1)
    x, y = r.integers(-50, 50, (5, 12)), r.integers(-50, 50, (300, 12))
    lists = topk_search.scores_by_fragment(x, y, 4)
    own = np.zeros((5, 300), dtype=bool)
    sums = x @ y.T
    cutoffs = np.sort(sums, axis=1)[:, -7]
    marks = topk_search.collected(lists, own, cutoffs)
    assert ((sums >= cutoffs[:, None]) <= marks).all() and not marks.all()


@pytest.mark.parametrize(("shard", "block", "spread"), [(4096, 512, 1.0), (30, 4, 0.01), (2, 7, 0.2)])
def test_hard_negatives_equal_full_comparison(spark, shard, block, spread):
    rows = vectors(block, spread=spread)
    table = spark.createDataFrame(rows, SCHEMA)
    out = hard_negatives.mine(table, F.expr("vec_id % 10 = 0"), shard=shard, block=block)
    expected = plain_negatives(whole(rows, 256), 10, 3)
    assert len(expected) > 20
    same(out, expected)


def test_bounds_hold_and_leave_rows_out():
    import numpy as np

    r = np.random.default_rng(3)
    rows = r.integers(-200, 200, (400, 16)).astype(float)
    anchors = np.repeat(r.integers(-200, 200, (3, 16)), 5, axis=0) + r.integers(-3, 3, (15, 16)).astype(float)
    bounds = hard_negatives.Bounds(anchors, rows)
    scored = 0
    for a, low, high in bounds:
        exact = rows @ anchors[a]
        assert (low <= exact).all() and (exact <= high).all()
        at, scores = bounds.score(a, high >= np.sort(exact)[-5], low, high)
        scored += len(at)
        assert (scores == exact[at]).all() and set(np.argsort(exact)[-5:]) <= set(at)
    assert scored < 0.5 * len(anchors) * len(rows) and not bounds.known


def test_spanning_tree_is_shortest():
    import itertools

    import numpy as np

    points = np.random.default_rng(2).integers(0, 30, (6, 3)).astype(float)
    tree = hard_negatives.spanning_tree(points)
    assert sorted(a for a, _, _ in tree) == list(range(6))
    seen = set()
    for a, parent, distance in tree:
        assert parent in seen or (parent == -1 and not seen)
        assert parent == -1 or distance == pytest.approx(np.linalg.norm(points[a] - points[parent]))
        seen.add(a)
    edges = list(itertools.combinations(range(6), 2))

    def spans(some):
        group = list(range(6))
        for a, b in some:
            group = [group[a] if g == group[b] else g for g in group]
        return len(set(group)) == 1

    least = min(
        sum(np.linalg.norm(points[a] - points[b]) for a, b in some)
        for some in itertools.combinations(edges, 5) if spans(some)
    )
    assert sum(d for _, _, d in tree) == pytest.approx(least)


def test_long_scores_are_exact(spark):
    rows = [(i, [3e8 + i, -1.0 - i % 5], i % 2, "", 0) for i in range(30)]
    table = spark.createDataFrame(rows, SCHEMA)
    same(topk_search.top_k(table, F.lit(True), 4, scale=1, shard=7), plain_top(whole(rows, 1), 4, 1))
    rows = [(i, [3e8 + 1e7 * i, 1.0 + i], i % 2, "", 0) for i in range(30)]
    table = spark.createDataFrame(rows, SCHEMA)
    expected = plain_negatives(whole(rows, 1), 1, 3)
    same(hard_negatives.mine(table, F.lit(True), scale=1, shard=7, block=4), expected)
    assert expected


@pytest.mark.parametrize("rows", [[], [(5, [1.0], 1, "", 0)], [(0, None, 1, "", 0)]])
def test_no_results(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA)
    assert topk_search.top_k(table, F.expr("vec_id % 5 = 0")).collect() == []
    assert hard_negatives.mine(table, F.expr("vec_id % 5 = 0")).collect() == []
