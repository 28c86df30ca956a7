"""Sampling, sweeps, explanations and training: properties and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from eventlens.operators import sampling as S
from eventlens.operators.knn import knn_join
from eventlens.plans import explain as X
from eventlens.plans import sweep as SW
from eventlens.plans import training as T


def test_knn_matches_bruteforce_multi_block(spark):
    rng = np.random.default_rng(5)
    V = rng.normal(size=(120, 4)).round(3)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(V)], "id long, v array<double>")
    got = {(r["id"], r["rank"]): r["nn_id"] for r in knn_join(df, df, "id", "v", 3, block_rows=25).collect()}
    for i in range(120):
        d = ((V - V[i]) ** 2).sum(1).round(6)
        d[i] = np.inf
        order = sorted(range(120), key=lambda j: (d[j], j))[:3]
        assert [got[(i, r)] for r in (1, 2, 3)] == order


def test_knn_hot_duplicate_vector(spark):
    """A third of the rows share one vector: every query still gets exactly
    k neighbours, ties broken by id, as in brute force."""
    rng = np.random.default_rng(7)
    V = rng.normal(size=(90, 3)).round(2)
    V[::3] = V[0]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(V)], "id long, v array<double>")
    res = knn_join(df, df, "id", "v", 4, block_rows=20).collect()
    assert len(res) == 90 * 4
    got = {(r["id"], r["rank"]): r["nn_id"] for r in res}
    for i in range(90):
        d = ((V - V[i]) ** 2).sum(1).round(6)
        d[i] = np.inf
        order = sorted(range(90), key=lambda j: (d[j], j))[:4]
        assert [got[(i, r)] for r in (1, 2, 3, 4)] == order


def test_smote_rows_on_segment(spark):
    e = spark.read.parquet(f"{SF001}/embeddings.parquet").where("label = 0")
    out = S.smote(e, "vec_id", "embedding", 40, k=5, seed=1)
    assert out.count() == 40
    vecs = {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in e.collect()}
    for r in out.collect():
        x, z, g = vecs[r["base_id"]], vecs[r["nn_id"]], r["gap"]
        assert 0 <= g < 1 and np.allclose(np.array(r["embedding"]), x + g * (z - x))


def test_smote_count():
    assert S.smote_count(472, 4548, 0.3) == 892  # published split: 5,020 train rows, 472 failures


def test_permute_is_permutation(spark):
    o = spark.read.parquet(f"{SF001}/orders.parquet").select("o_orderkey", "o_totalprice")
    p = S.permute_column(o, "o_totalprice", "o_orderkey", seed=3)
    a = sorted(r[0] for r in o.select("o_totalprice").collect())
    b = sorted(r[0] for r in p.select("o_totalprice").collect())
    assert a == b and p.count() == o.count()
    moved = p.join(o.withColumnRenamed("o_totalprice", "orig"), "o_orderkey").where("o_totalprice <> orig").count()
    assert moved > 0.9 * o.count()


def test_undersample_exact(spark):
    from eventlens.plans.catalog.common import orders_y
    o = orders_y(spark, SF001).select("o_orderkey", "y")
    u = S.undersample(o, "y", "o_orderkey")
    c = {r["y"]: r["count"] for r in u.groupBy("y").count().collect()}
    assert c[0] == c[1]


@pytest.mark.parametrize("grid", [
    {"rf_n_estimators": [10, 20], "logit_C": [0.1, 1.0, 10.0], "threshold": [0.3, 0.5]},
    {"svm_kernel": ["linear", "rbf"], "mlp_hidden_layer_sizes": [(8,), (16, 8)], "cut_year": [2000, 2005],
     "ada_n_estimators": [5]},
])
def test_grid_runs_are_the_first_of_each_projection(spark, grid):
    """A model runs at the smallest ordinal of every distinct projection of
    the full product onto the axes it uses."""
    import itertools
    product = list(enumerate(itertools.product(*grid.values())))
    want = set()
    for model, used in SW.MODEL_PARAM_KEYS.items():
        axes = [i for i, k in enumerate(grid) if k in used]
        first = {}
        for ordinal, values in reversed(product):
            first[tuple(values[i] for i in axes)] = ordinal
        want |= {(o, model) for o in first.values()}
    got = {(r["ordinal"], m) for r in SW.grid_runs(spark, grid, SW.BASE_CONFIG).collect() for m in r["models"]}
    assert got == want


def test_grid_rejects_unknown_keys(spark):
    with pytest.raises(KeyError):
        SW.grid_runs(spark, {"svm_gamme": [1, 2]}, SW.BASE_CONFIG)
    with pytest.raises(KeyError):
        SW.check_config({"svm_gamme": 1})


def test_typed_config(spark):
    best = spark.createDataFrame([("MLP", "[64, 32]", 0.3)], "model string, mlp_hidden_layer_sizes string, threshold double")
    best = best.withColumn("mlp_hidden_layer_sizes", F.from_json("mlp_hidden_layer_sizes", "array<int>"))
    cfg = SW.typed_config(best, "mlp_hidden_layer_sizes array<int>, threshold double").first()["config"]
    assert list(cfg["mlp_hidden_layer_sizes"]) == [64, 32] and cfg["threshold"] == 0.3


def test_sampling_shapley_additivity(spark):
    rows = spark.createDataFrame([(i, float(i % 7), float(i % 3), float(i % 5)) for i in range(60)],
                                 "id long, a double, b double, c double")
    scorer = X.LinearLogistic({"a": 0.3, "b": -0.5, "c": 0.2}, 0.1)
    bg = X.background_sample(rows, "id", 10)
    sh = X.sampling_shapley(scorer, rows.where("id < 12"), bg, ["a", "b", "c"], "id", n_perm=3)
    values = {(r["id"], r["feature"]): r["value"] for r in sh.collect()}
    assert values == {(r["id"], f): r[f] for r in rows.where("id < 12").collect() for f in ("a", "b", "c")}
    per = sh.groupBy("id").agg(F.sum("shap").alias("s"), F.first("f_x").alias("fx"), F.first("f_bg").alias("fb"))
    for r in per.collect():
        assert abs(r["s"] - (r["fx"] - r["fb"])) < 1e-9


def test_linear_shapley_sums(spark):
    df = spark.createDataFrame([(i, float(i), float(i * i % 11)) for i in range(30)], "id long, a double, b double")
    coef = {"a": 0.5, "b": -1.0}
    sh = X.linear_shapley(df, coef, "id").groupBy("id").agg(F.sum("shap").alias("s"))
    means = df.agg(F.avg("a"), F.avg("b")).first()
    for r, src in zip(sorted(sh.collect()), sorted(df.collect())):
        assert abs(r["s"] - (0.5 * (src["a"] - means[0]) - (src["b"] - means[1]))) < 1e-9


def test_train_and_evaluate_small(spark):
    from eventlens.plans.features import ORDER_FEATURES, order_model_table
    b = T.make_split(order_model_table(spark, SF001), ORDER_FEATURES, "y", "o_orderkey", "year", 2000)
    for scorer in (T.fit_majority(b.train, "y"), T.fit_logit(b.train, ORDER_FEATURES, "y"),
                   T.fit_boost(b.train, ORDER_FEATURES, "y", 2, id_col="o_orderkey")):
        m = T.evaluate(scorer, b.test, "y", [0.5]).first()
        assert 0 <= m["f1"] <= 1 and m["TP"] + m["FP"] + m["TN"] + m["FN"] == b.test.count()
    b.unpersist()


def test_explanation_run(spark):
    """The long table of one linear scorer, whose Shapley values have a closed form."""
    rows = spark.createDataFrame([(i, i % 2, float(i % 7), float(i % 3), 1.0) for i in range(84)], "id long, y int, a double, b double, c double")
    coef = {"a": 0.5, "b": -0.25, "c": 2.0}
    scorer = X.LinearLogistic(coef, -1.0)
    out = X.explain_models({"lin": (scorer, lambda r, bg: X.linear_shapley(r, coef, "id"))}, rows, rows, list(coef), "y", "id", requested=["b"], cases=2, repeats=5).collect()
    by = {}
    for r in out:
        by.setdefault(r["kind"], []).append(r)
    top = {r["feature"]: (r["rank"], round(r["number"], 6)) for r in by["shap_mean_abs"]}
    assert top == {"a": (1, round(0.5 * 12 / 7, 6)), "b": (2, round(0.25 * 2 / 3, 6)), "c": (3, 0.0)}
    assert sorted((r["rank"], r["feature"]) for r in by["dependence"]) == [(1, "b"), (2, "a")]
    assert sorted((r["id"], r["rank"], r["feature"], round(r["number"], 6), r["value"]) for r in by["case"]) == [
        (0, 1, "a", -1.5, 0.0), (0, 2, "b", 0.25, 0.0), (0, 3, "c", 0.0, 1.0), (2, 1, "a", -0.5, 2.0), (2, 2, "b", -0.25, 2.0), (2, 3, "c", 0.0, 1.0)]
    perm = X.permutation_importance(scorer, rows, list(coef), "y", "id", 5)
    assert {(r["feature"], r["number"]) for r in by["perm_drop"]} == {(r["feature"], r["mean_drop"]) for r in perm.collect()}
    assert {r["feature"]: r["number"] for r in by["perm_drop"]}["c"] == 0.0
