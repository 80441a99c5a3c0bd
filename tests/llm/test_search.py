"""Nearest vectors against the whole table, row by row."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventlens.llm import search

SCHEMA = "vec_id long, embedding array<float>"


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute(rows, every, k, kind=np.float32):
    rows = [(i, [math.floor(64 * float(kind(x))) for x in v]) for i, v in rows if usable(v)]
    found = []
    for n, (i, q) in enumerate(rows):
        if i is None or i % every:
            continue
        scores = [(-max(min(sum(a * b for a, b in zip(q, v)), 2**63 - 1), -2**63), j is None, j or 0)
                  for m, (j, v) in enumerate(rows) if m != n and len(v) == len(q)]
        found += [(i, r + 1, None if x else j, -s) for r, (s, x, j) in enumerate(sorted(scores)[:k])]
    return sorted(map(str, found))


def check(spark, rows, every=5, k=7, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    found = search.top_k(df, F.col("vec_id") % every == 0, k, **options).select("query_id", "rank", "vec_id", "score")
    assert sorted(str(tuple(r)) for r in found.collect()) == brute(rows, every, k)


def vectors(seed, n, dims, spread=1.0):
    random.seed(seed)
    return [[random.gauss(0, spread) for _ in range(dims)] for _ in range(n)]


@pytest.mark.parametrize("shard_rows, query_rows, leaf", [(8192, 4096, 256), (40, 10, 4), (300, 1000, 1)])
def test_against_all_rows(spark, shard_rows, query_rows, leaf):
    check(spark, list(enumerate(vectors(1, 300, 8))), shard_rows=shard_rows, query_rows=query_rows, leaf=leaf)


def test_ties_and_one_common_vector(spark):
    rows = list(enumerate(vectors(2, 100, 4) + [[0.5, -0.25, 0.0, 1.0]] * 150))
    random.shuffle(rows)
    check(spark, rows, shard_rows=60, query_rows=20, leaf=8)


def test_odd_vectors(spark):
    rows = [
        (0, [1.0, 2.0]), (5, [1.0, 2.0]), (5, [1.0, 2.0]), (10, None), (15, [1.0, None]), (20, [float("nan"), 1.0]),
        (25, [float("inf"), 1.0]), (30, []), (35, []), (40, [3.0]), (None, [1.0, 2.0]), (None, [0.5, 2.0]), (1, [-1.0, 0.001]),
        (45, [3e30, -3e30]), (2, [1e9, 1e9]), (3, [-3e30, 1e20]), (50, [0.0, 0.0]),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    found = search.top_k(df, F.col("vec_id") % 5 == 0, 20).collect()
    assert sorted(str((r["query_id"], r["rank"], r["vec_id"], r["score"])) for r in found) == brute(rows, 5, 20)


def test_empty_and_small_tables(spark):
    check(spark, [(0, [1.0])])
    check(spark, [(1, [1.0]), (2, [2.0])])
    assert search.top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 5 == 0).count() == 0


def test_clashing_columns(spark):
    rows = list(enumerate(vectors(3, 60, 3)))
    plain = spark.createDataFrame(rows, SCHEMA)
    odd = plain.selectExpr("*", "1 AS uid", "'x' AS shard", "2 AS rank", "3 AS is_query", "0 AS score")
    one, other = (search.top_k(d, F.col("vec_id") % 5 == 0, 4, shard_rows=20).collect() for d in (plain, odd))
    assert sorted(one) == sorted(other)


def test_boxes_are_tight_and_leaves_hold_all():
    points = np.array(vectors(4, 500, 3))
    tree = search.KdTree(points, np.arange(500), leaf=16)
    leaves = [k for k, c in enumerate(tree.children) if c is None]
    assert sorted(i for k in leaves for i in tree.order[slice(*tree.span[k])]) == list(range(500))
    for k, (lo, hi) in enumerate(tree.span):
        inside = tree.points[lo:hi]
        assert (tree.low_of[k] == inside.min(axis=0)).all() and (tree.high_of[k] == inside.max(axis=0)).all()
    assert all(hi - lo <= 16 for lo, hi in (tree.span[k] for k in leaves))


def clustered(seed, clusters, each, dims):
    random.seed(seed)
    return [
        [c + random.gauss(0, 0.05) for c in centre]
        for centre in vectors(seed, clusters, dims, 2.0) for _ in range(each)
    ]


def test_cells_hold_equal_shares_and_copies_stay_together():
    points = [np.floor(64 * np.array(v)) for v in vectors(5, 1000, 6)] + [np.zeros(6)] * 500 + [np.ones(2)] * 40
    cells = search.Cells(points, 16)
    found = cells.of(points)
    assert len(set(found[1000:1500])) == 1 and len(set(found[1500:])) == 1
    assert np.bincount(found[:1000]).max() < 200
    assert list(cells.of([np.zeros(9)])) == [-1]


def test_a_query_reaches_few_cells_and_none_too_few():
    points = [np.floor(64 * np.array(v)) for v in clustered(6, 32, 40, 8)]
    cells = search.Cells(points, 32)
    found, matrix = cells.of(points), np.array(points)
    names = np.unique(found)
    boxes = {8: (names, *(np.array([side(matrix[found == c], axis=0) for c in names]) for side in (np.min, np.max)))}
    scores = matrix @ matrix.T
    kth = np.sort(scores, axis=1)[:, -10]
    reached = search.reaching(boxes, points, kth)
    for row, at in zip(scores >= kth[:, None], reached):
        assert set(found[row]) <= set(at)
    assert np.mean([len(at) for at in reached]) < len(names) / 4
    assert all(len(at) == len(names) for at in search.reaching(boxes, points[:3], np.full(3, math.nan)))


@pytest.mark.parametrize("shard_rows, query_rows", [(50, 10), (100, 1000)])
def test_clusters_and_a_common_vector_against_all_rows(spark, shard_rows, query_rows):
    rows = list(enumerate(clustered(7, 12, 25, 5) + [[0.5, -0.25, 0.0, 1.0, 2.0]] * 150 + vectors(8, 40, 3)))
    random.shuffle(rows)
    check(spark, rows, shard_rows=shard_rows, query_rows=query_rows, leaf=8)


def test_odd_vectors_in_many_cells(spark):
    rows = [(i, [float(i % 7), -float(i % 5)]) for i in range(60)] + [(60, []), (65, []), (70, [1e300, 1e300]),
            (75, [-1e300, 1e300]), (80, None), (None, [2.0, 3.0]), (85, [1.0] * 9), (86, [2.0] * 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = search.top_k(df, F.col("vec_id") % 5 == 0, 6, shard_rows=10, query_rows=4, leaf=2).collect()
    wanted = brute(rows, 5, 6, float)
    assert sorted(str((r["query_id"], r["rank"], r["vec_id"], r["score"])) for r in found) == wanted
