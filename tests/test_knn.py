"""Pruned kNN join against all distances."""

import tracemalloc

import numpy as np
import pytest

from eventlens.operators import knn


def brute(q, r, k, exclude_self, digits=6):
    out = []
    for i, v in q:
        if v is None:
            continue
        d = sorted((round(float(((np.array(v) - np.array(w)) ** 2).sum()), digits), j) for j, w in r if w is not None and not (exclude_self and i == j))
        out += [(i, j, n + 1, x) for n, (x, j) in enumerate(d[:k])]
    return sorted(out)


def run(spark, q, r, k, **kw):
    schema = "id long, v array<double>"
    got = knn.knn_join(spark.createDataFrame(q, schema), spark.createDataFrame(r, schema), "id", "v", k, **kw)
    return sorted((x["id"], x["nn_id"], x["rank"], x["dist2"]) for x in got.collect())


def clustered(n, dims=4, clusters=12, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 50, (clusters, dims))
    return [(i, (centres[i % clusters] + rng.normal(0, 1, dims)).tolist()) for i in range(n)]


@pytest.mark.parametrize("block_rows", [8, 64, 4096])
def test_ties_duplicates_and_clusters(spark, block_rows):
    rows = clustered(240)
    rows += [(1000 + i, rows[0][1]) for i in range(70)] + [(2000 + i, [float(i % 3), 0.0, 0.0, 0.0]) for i in range(30)] + [(3000, None), (-5, [0.0] * 4)]
    assert run(spark, rows, rows, 5, block_rows=block_rows) == brute(rows, rows, 5, True)


def test_two_sides(spark):
    q, r = clustered(60, seed=2), clustered(90, seed=3)
    assert run(spark, q, r, 3, exclude_self=False, block_rows=16) == brute(q, r, 3, False)
    assert run(spark, q, r[:2], 5, exclude_self=False, block_rows=16) == brute(q, r[:2], 5, False)
    assert run(spark, q, [], 5) == [] and run(spark, [], r, 5) == []
    assert run(spark, [(1, [1.0])], [(1, [1.0])], 5) == []


def test_unclustered(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 1, 16).tolist()) for i in range(150)]
    assert run(spark, rows, rows, 4, block_rows=16) == brute(rows, rows, 4, True)


def test_few_blocks_are_visited(spark):
    """On clustered data a query visits less than a tenth of the blocks."""
    rows = clustered(4000, clusters=40)
    refs = spark.createDataFrame(rows, "rid long, rv array<double>")
    blocks, rings, pivots = knn.index_blocks(refs, 160, 40)
    assert blocks.groupBy("cell", "sub").count().agg({"count": "max"}).first()[0] <= 40
    query = refs.selectExpr("rid AS qid", "rv AS qv")
    first = knn.first_blocks(query, rings, pivots)
    assert first.count() == 4000
    near = knn._search(first, blocks, 6, 40, 6)
    bound = near.groupBy("qid").agg({"dist2": "max", "nn_id": "count"}).selectExpr("qid AS q", "if(`count(nn_id)` >= 6, sqrt(`max(dist2)`), double('inf')) AS reach")
    more = knn.further_blocks(first.join(bound, first.qid == bound.q), rings, pivots)
    assert more.count() + 4000 < 4000 * rings.count() / 10


def test_memory_of_one_task():
    """The distances of a full block are never held at once (134 MB each time)."""
    rng = np.random.default_rng(5)
    v, ids = rng.normal(0, 1, (knn.BLOCK_ROWS, 8)), np.arange(knn.BLOCK_ROWS)
    tracemalloc.start()
    got = knn._nearest(v, v, ids, ids, 3, 6)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
    assert len(got) == 3 * len(v) and (got["qid"].to_numpy()[::3] == ids).all()


def test_routes_come_without_vectors(spark):
    """Where no block is ruled out there is a route for each query and block."""
    rng = np.random.default_rng(6)
    refs = spark.createDataFrame([(i, rng.normal(0, 1, 16).tolist()) for i in range(200)], "rid long, rv array<double>")
    _, rings, pivots = knn.index_blocks(refs, 8, 16)
    query = refs.selectExpr("rid AS qid", "rv AS qv")
    first = knn.first_blocks(query, rings, pivots).selectExpr("*", "double('inf') AS reach")
    more = knn.further_blocks(first, rings, pivots)
    assert more.columns == ["qid", "cell", "sub"] and more.count() == 200 * (rings.count() - 1)
