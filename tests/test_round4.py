"""Steps that were mended for time: few records, and the same results."""

import numpy as np
import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(0, 1, 4000), rng.integers(0, 3, 4000)
    y = (a + (b == 1) + rng.normal(0, 0.5, 4000) > 0.5).astype(int)
    rows = [(i, int(y[i]), None if i % 13 == 0 else float(a[i]), float(b[i]), float(i % 2)) for i in range(4000)]
    return spark.createDataFrame(rows, "id long, y int, a double, b double, c double").repartition(3)


def test_rows_travel_to_their_trees_in_few_records(labelled, monkeypatch):
    """A record for each block of rows, tree and upper node, not one a row."""
    from eventlens.plans import forest as FO
    kind = type(labelled)
    seen, plain = [], kind.mapInArrow

    def kept(self, f, schema, *args, **more):
        out = plain(self, f, schema, *args, **more)
        if "top" in out.columns and "bins" in out.columns:
            seen.append(out)
        return out

    monkeypatch.setattr(kind, "mapInArrow", kept)
    FO.store_forest(labelled, ["a", "b", "c"], "y", 6, None, 2, local_rows=1500)
    tops = seen[0].select("tree", "top").distinct().count()
    assert tops > 6 and seen[0].count() <= 3 * tops


@pytest.mark.parametrize("depth", [4, 1000])
def test_levels_summed_by_cells_and_sorted_grow_the_same_nodes(depth):
    """Against each node's best split on its own rows."""
    from eventlens.plans import forest as FO
    rng = np.random.default_rng(5)
    n, width, mtry, weights = 3000, 5, 2, (0.8, 1.3)
    bins = rng.integers(0, [255, 3, 2, 40, 255], (n, width)).astype(np.uint8)
    y, c = ((bins[:, 0] > 100) ^ (rng.random(n) < 0.2)).astype(int), rng.integers(1, 4, n)
    nodes = {r[0]: r for r in FO.grow(bins, y, c, weights, 3, 0, depth, mtry, 2, 42)}
    subtree, todo, seen = np.uint64(0), [(0, np.arange(n), depth)], 0
    while todo:
        number, rows, left_levels = todo.pop()
        _, feature, cut, a, b, value = nodes[number]
        n0, n1 = (int(c[rows][y[rows] == k].sum()) for k in (0, 1))
        assert value == pytest.approx(weights[1] * n1 / (weights[0] * n0 + weights[1] * n1))
        seen += 1
        chosen = FO._choices(3, np.array([number]).view(np.uint64) ^ subtree, width, mtry, 42)[0]
        options = {}
        for f in chosen if left_levels and n0 and n1 and n0 + n1 >= 4 else ():
            order = rows[np.argsort(bins[rows, f], kind="stable")]
            got = FO.best_splits(np.zeros(len(order), int), bins[order, f].astype(int), (c * (y == 0))[order], (c * (y == 1))[order], weights, 1, 2).get(0)
            if got:
                l = rows[bins[rows, f] <= got[1]]
                options[int(f), got[1]] = sum(((weights[0] * p) ** 2 + (weights[1] * q) ** 2) / (weights[0] * p + weights[1] * q)
                                              for p, q in ([c[m][y[m] == k].sum() for k in (0, 1)] for m in (l, np.setdiff1d(rows, l))))
        if not options:
            assert feature == -1
        else:
            assert options[feature, cut] == pytest.approx(max(options.values()), rel=1e-9)
            todo += [(a, rows[bins[rows, feature] <= cut], left_levels - 1), (b, rows[bins[rows, feature] > cut], left_levels - 1)]
    assert seen == len(nodes)


@pytest.mark.parametrize("repeats", [7, 300])
def test_permuted_rows_walk_down_together(repeats):
    """Against every permuted row on its own, with splits above the subtrees."""
    from eventlens.plans import forest as FO
    rng = np.random.default_rng(6)
    n, width = 200, 4
    bins = rng.integers(0, [255, 3, 40, 2], (2000, width)).astype(np.uint8)
    bins[rng.random(bins.shape) < 0.05] = FO.MISSING
    y = ((bins[:, 0] > 100) ^ (rng.random(2000) < 0.3)).astype(int)
    packed = FO._packed_piece(*FO._grown(bins, y, np.ones(2000, int), (1.0, 1.0), 0, 1, 1000, 2, 1, 42))
    other = FO._packed_piece(*FO._grown(bins[::2], 1 - y[::2], np.ones(1000, int), (1.0, 1.0), 1, 4, 1000, 2, 1, 42))
    last = FO._packed_piece(np.array([-1]), np.array([0]), np.array([0]), np.array([0.25]))
    trees = [FO._joined([], [(0, *packed)]), FO._joined([(0, 0, 90, 1, 2), (2, 2, 10, 3, 4)], [(1, *packed), (3, *last), (4, *other)])]
    rows = bins[:n]
    moved = np.stack([rows[rng.permutation(n)].T for _ in range(repeats)], axis=2).transpose(1, 0, 2)

    def plain(tree, x):
        node = 0
        while tree[0][node] >= 0:
            node = tree[2][node] if x[tree[0][node]] <= tree[1][node] else tree[3][node]
        return tree[4][node]

    block = FO._Permuted(rows, np.ascontiguousarray(moved))
    for tree in map(FO._walkable, trees):
        block.add(tree)
    got = block.spread(block.sums())
    assert np.allclose(sum(FO._binned_total(FO._walkable(t), rows) for t in trees), [sum(plain(t, x) for t in trees) for x in rows])
    for i in range(0, n, 9):
        for j in range(width):
            for k in range(0, repeats, 3):
                x = rows[i].copy()
                x[j] = moved[i, j, k]
                assert got[i, j, k] == pytest.approx(sum(plain(t, x) for t in trees))


def test_permutation_drops_of_a_stored_forest(spark, labelled, monkeypatch):
    """As those of the exploded rows, which are not made."""
    from eventlens.plans import explain as X
    from eventlens.plans import forest as FO
    names = ["a", "b", "c"]
    stored = FO.store_forest(labelled, names, "y", 9, None, 2, local_rows=1500)
    test = labelled.where("id % 3 = 0").withColumn("y", F.when(F.col("id") % 50 > 0, F.col("y")))
    monkeypatch.setattr(FO, "PERMUTED_SLAB", 500)
    monkeypatch.setattr(FO, "PERMUTED_BLOCK", 100)
    monkeypatch.setattr(FO, "PERMUTED_NODES", stored.nodes() // 3)
    order = ["c", "a", "b"]
    want = X.permutation_drops(FO.ForestScorer("RF", stored.read(), names), test, order, "y", "id", 4, threshold=0.41)
    monkeypatch.setattr(X, "permuted_frame", None)
    got = X.permutation_drops(FO.ForestScorer("RF", stored, names), test, order, "y", "id", 4, threshold=0.41)
    a, b = ({(r["feature"], r["repeat"]): r["drop"] for r in d.collect()} for d in (want, got))
    assert len(a) == 12 and a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a) and any(a.values())


def test_explanation_run_takes_every_learner(labelled, monkeypatch):
    """Small settings here; the query's own are the functions' defaults."""
    from functools import partial
    from eventlens.plans.catalog import QUERIES, learning
    names, T = ["a", "b", "c"], learning.T
    rows = labelled.select(F.col("id").alias(learning.ID), "y", F.coalesce("a", F.lit(0.0)).alias("a"), "b", "c")
    bundle = T.SplitBundle(rows.where("o_orderkey % 10 > 0"), rows.where("o_orderkey % 100 = 0"), names, "y", learning.ID)
    monkeypatch.setattr(learning, "_split", lambda *a: bundle)
    monkeypatch.setattr(learning, "rounded", lambda df: df)
    for fn, small in (("fit_random_forest", {"n_trees": 2}), ("fit_gbt", {"n_estimators": 2, "max_depth": 2}), ("fit_boost", {"n_estimators": 2}), ("fit_logit", {"max_iter": 3}),
                      ("fit_svm", {"max_iter": 2, "n_components": 4, "folds": 2}), ("fit_mlp", {"max_iter": 2, "hidden": (3,)})):
        monkeypatch.setattr(T, fn, partial(getattr(T, fn), **small))
    monkeypatch.setattr(learning.X, "sampling_shapley", partial(learning.X.sampling_shapley, n_perm=1))
    monkeypatch.setattr(learning.X, "explain_models", partial(learning.X.explain_models, repeats=2))
    out = QUERIES["explanation_run"](labelled.sparkSession, "").groupBy("model", "kind").count().toPandas()
    assert set(out.model) == {"RandomForest", "GBT", "AdaBoost", "RUSBoost", "Logit", "SVM", "MLP"}
    assert set(out.kind) == {"shap_mean_abs", "dependence", "case", "perm_drop", "perm_low", "perm_high"}
    assert (out[out.kind == "shap_mean_abs"]["count"] == 3).all() and (out[out.kind == "case"]["count"] == 15).all()


def test_neighbours_and_routes_are_not_broadcast(spark, monkeypatch):
    """Tables with rows for each query meet by sort and merge, however small their files."""
    from eventlens.operators import knn
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (300, 3))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    plans, plain = {}, knn.materialize
    monkeypatch.setattr(knn, "materialize", lambda d, tag: (plans.setdefault(tag, d._jdf.queryExecution().executedPlan().toString()), plain(d, tag))[1])
    out = knn.knn_join(df, df, "id", "v", 3, block_rows=40)
    got = {(r["id"], r["rank"]): r["nn_id"] for r in out.collect()}
    for i in range(0, 300, 29):
        d = np.round(((x - x[i]) ** 2).sum(1), 6)
        want = [int(j) for j in np.lexsort((np.arange(300), d)) if j != i][:3]
        assert [got[i, k] for k in (1, 2, 3)] == want
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [qid" in plans["knn-routes"] and "SortMergeJoin [qid" in plans["knn-found"]


def test_folds_are_fitted_side_by_side(spark):
    """Two fits wait for each other; one after the other they never meet."""
    import threading
    from eventlens.plans import training
    df = spark.createDataFrame([(float(i), i % 2) for i in range(200)], "x double, y int")
    met = threading.Barrier(2)

    def fit(rows):
        met.wait(60)
        return rows.count()

    out = training.out_of_fold(df, "y", fit, lambda model, d: d.withColumn("m", F.lit(float(model))), ["x"], folds=2).toPandas()
    sizes = out.groupby("m").size()
    assert len(out) == 200 and all(m == 200 - n for m, n in sizes.items())
