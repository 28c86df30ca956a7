"""What the third round's findings asked for."""

import os

import numpy as np
import pytest

from eventlens.operators.corr import pair_moments
from eventlens.operators.pit import prior_experience
from eventlens.session import checkpoint_dir


def _written(spark, tag):
    base = checkpoint_dir(spark).removeprefix("file:")
    return {n for n in os.listdir(base) if n.startswith(f"eventlens-{tag}-")}


def _events(heavy):
    """400 events of 100 entities, ``heavy`` of them of entity 0, some of none."""
    keys = [0] * heavy + [1 + i % 99 for i in range(400 - heavy)]
    return [(k, None if k == 7 else k, (k * 37 + i * 13) % 50, i % 3 % 2) for i, k in enumerate(keys)]


@pytest.mark.parametrize("heavy, blocks_written", [(4, 0), (150, 1), (400, 1)])
def test_experience_splits_heavy_keys_only(spark, heavy, blocks_written):
    rows = [(i, e, t, y) for i, (_, e, t, y) in enumerate(_events(heavy))]
    df = spark.createDataFrame(rows, "k long, e int, t int, y int")
    before = _written(spark, "blocks")
    out = {r["k"]: r for r in prior_experience(df, "e", "t", "k", "y", "x", base_rate=0.5, blocks=5).collect()}
    assert len(_written(spark, "blocks") - before) == blocks_written
    assert len(out) == len(rows)
    for k, e, t, _ in rows:
        earlier = [y for k2, e2, t2, y in rows if e2 == e and (t2, k2) < (t, k)]
        r = out[k]
        if e is None:
            assert r["x_prior_launches"] is None and r["x_prior_successes"] is None
        else:
            assert (r["x_prior_launches"], r["x_prior_successes"], r["x_is_first"]) == (len(earlier), sum(earlier), int(not earlier))


@pytest.mark.parametrize("with_nulls", [False, True])
def test_pair_moments_are_those_of_the_pairs(spark, with_nulls):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 3)) * [1.0, 10.0, 0.1] + 5.0
    rows = [[None if with_nulls and (i + j) % 7 == 0 else float(v) for j, v in enumerate(r)] for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    full = np.array([[np.nan if v is None else v for v in r] for r in rows])
    shift = np.nanmean(full, axis=0)
    for only in (None, 1):
        for r in pair_moments(df, ["a", "b", "c"], only).collect():
            p, q = full[:, r["a"]] - shift[r["a"]], full[:, r["b"]] - shift[r["b"]]
            both = ~np.isnan(p) & ~np.isnan(q)
            p, q = p[both], q[both]
            assert np.allclose([r["n"], r["s_a"], r["s_aa"], r["s_ab"]], [len(p), p.sum(), (p * p).sum(), p @ q])


def _training_rows(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(600, 4)).round(2)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=600) > 0).astype(int)
    return spark.createDataFrame([(i, int(v), *map(float, r)) for i, (v, r) in enumerate(zip(y, x))], "id long, y int, a double, b double, c double, d double").coalesce(2).cache()


def test_forests_of_less_depth_are_the_deepest_cut_off(spark):
    from eventlens.plans.forest import fit_forest, store_forests
    df, names = _training_rows(spark), list("abcd")
    # nodes of more than 60 rows are split level by level, so the cuts lie above and inside the gathered subtrees
    made = store_forests(df, names, "y", 5, [1, 3, 6, None], local_rows=60, trees_at_once=3)
    for depth, n in ((1, 5), (3, 2), (6, 4), (None, 5)):
        alone = fit_forest(df, names, "y", n, depth, local_rows=60, trees_at_once=3)
        cut = made[depth].first(n).read()
        x = np.array([r[:] for r in df.select(*names).collect()], float)
        assert len(cut.feature) == len(alone.feature) and np.array_equal(cut.total(x), alone.total(x))


def test_sweep_grows_the_forests_of_common_rows_once(spark, monkeypatch):
    from eventlens.plans import forest, sweep
    df = _training_rows(spark).selectExpr("id", "y", "a", "b", "c", "d", "IF(id % 4 = 0, 2012, 2005) AS year")
    calls, grow = [], forest.store_forests
    monkeypatch.setattr(forest, "store_forests", lambda *a, **k: calls.append(a[3:5]) or grow(*a, **k))
    grid = {"rf_n_estimators": [3, 5], "rf_max_depth": [2, 4], "threshold": [0.4, 0.5]}
    base = {"apply_smote": False}
    results, _ = sweep.grid_sweep(df, list("abcd"), "y", "id", "year", grid, ["RandomForest"], base)
    assert len(calls) == 1 and calls[0][0] == 5 and sorted(calls[0][1]) == [2, 4]
    got = {(r["rf_n_estimators"], r["rf_max_depth"], r["threshold"]): (r["TP"], r["FP"], r["auc_roc"]) for r in results.collect()}
    assert len(got) == 8
    for n, depth in ((3, 2), (5, 4)):
        alone = sweep.run_config(df, list("abcd"), "y", "id", "year", {**base, "rf_n_estimators": n, "rf_max_depth": depth}, ["RandomForest"], [0.4, 0.5])
        assert {r["threshold"]: (r["TP"], r["FP"], r["auc_roc"]) for r in alone.collect()} == {t: got[n, depth, t] for t in (0.4, 0.5)}


def test_fits_take_as_many_partitions_as_rows_fill(spark, monkeypatch):
    from eventlens.plans import training
    df = spark.range(100).repartition(32)
    assert training.fewer_partitions(df).rdd.getNumPartitions() == 1
    monkeypatch.setattr(training, "PARTITION_ROWS", 30)
    assert training.fewer_partitions(df).rdd.getNumPartitions() == 4
    monkeypatch.setattr(training, "PARTITION_ROWS", 1)
    assert training.fewer_partitions(df).rdd.getNumPartitions() == 32
    fitted = []
    monkeypatch.setattr(training.LinearSVC, "fit", lambda self, d: fitted.append(d.rdd.getNumPartitions()) or "model")
    training.fit_svm(df.selectExpr("double(id) AS a", "int(id % 2) AS y"), ["a"], "y", kernel="linear", folds=0)
    assert fitted == [32]
    monkeypatch.setattr(training, "PARTITION_ROWS", 1 << 14)
    training.fit_svm(df.selectExpr("double(id) AS a", "int(id % 2) AS y"), ["a"], "y", kernel="linear", folds=0)
    assert fitted == [32, 1]
