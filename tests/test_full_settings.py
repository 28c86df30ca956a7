"""The registered learning queries run with the full settings."""

import inspect
import math

import pytest
from pyspark.sql import functions as F

from eventlens.plans import sweep, training
from eventlens.plans.catalog import QUERIES, learning

FOREST = {"n_trees": 300, "max_depth": None}
GBT = {"n_estimators": 300, "max_depth": 6, "learning_rate": 0.05}
BOOST = {"n_estimators": 200, "learning_rate": 0.1}
EXPECTED = {
    "train_random_forest": {"fit_random_forest": FOREST},
    "train_gbt": {"fit_gbt": GBT},
    "train_adaboost": {"fit_boost": BOOST | {"undersample": False}},
    "train_rusboost": {"fit_boost": BOOST | {"undersample": True}},
    "train_svm": {"fit_svm": {"n_components": 200, "max_iter": 100, "kernel": "rbf"}},
    "svm_weights": {"fit_svm": {"max_iter": 100, "kernel": "linear"}},
    "train_mlp": {"fit_mlp": {"hidden": (64, 32), "max_iter": 200}},
    "shapley_sampling": {"fit_random_forest": FOREST, "background_sample": {"n": 500}, "sampling_shapley": {"n_perm": 8}},
    "explain_models": {"fit_random_forest": FOREST, "fit_gbt": GBT, "permutation_importance": {"repeats": 30}},
}


class Frame:
    """Stands for any frame or model."""

    def __getattr__(self, name):
        return Frame()

    def __call__(self, *args, **kwargs):
        return self

    def __gt__(self, other):
        return False

    def __rtruediv__(self, other):
        return self

    __radd__ = __truediv__ = __rtruediv__


def record(monkeypatch, module, name, calls, result):
    real = inspect.signature(getattr(module, name))

    def stub(*args, **kwargs):
        bound = real.bind(*args, **kwargs)
        bound.apply_defaults()
        calls.setdefault(name, []).append(bound.arguments)
        return result() if callable(result) else result

    monkeypatch.setattr(module, name, stub)


@pytest.mark.parametrize("name", sorted(EXPECTED))
def test_settings(spark, monkeypatch, name):
    calls = {}
    monkeypatch.setattr(learning, "_split", lambda *a: Frame())
    monkeypatch.setattr(learning, "_prepared", lambda *a: (Frame(), Frame(), ["f"]))
    monkeypatch.setattr(learning, "_eval", lambda *a: None)
    monkeypatch.setattr(learning, "rounded", lambda df: df)
    monkeypatch.setattr(learning.T, "linear_weights", lambda s: [("f", 1.0)])
    frame = Frame()
    if name == "train_gbt":
        frame.where = lambda *a: type("N", (), {"count": lambda self: 3})()
        bundle = Frame()
        bundle.train = frame
        monkeypatch.setattr(learning, "_split", lambda *a: bundle)
    for fn in ("fit_random_forest", "fit_gbt", "fit_boost", "fit_svm", "fit_mlp"):
        record(monkeypatch, learning.T, fn, calls, Frame())
    for fn in ("background_sample", "sampling_shapley"):
        record(monkeypatch, learning.X, fn, calls, Frame())
    record(monkeypatch, learning.X, "permutation_importance", calls, lambda: spark.createDataFrame([("f", 0.1)], "feature string, mean_drop double"))
    QUERIES[name](spark, "")
    for fn, settings in EXPECTED[name].items():
        assert all({k: c[k] for k in settings} == settings for c in calls[fn]), calls[fn]


def test_sweep_settings(spark, monkeypatch):
    calls = {}
    monkeypatch.setattr(learning, "order_model_table", lambda *a: Frame())
    monkeypatch.setattr(learning, "rounded", lambda df: df)
    record(monkeypatch, sweep, "run_config", calls, Frame())
    record(monkeypatch, sweep, "grid_sweep", calls, (Frame(), Frame()))
    record(monkeypatch, sweep, "per_model_configs", calls, Frame())
    for name in ("one_shot", "grid_sweep", "per_model_configs"):
        QUERIES[name](spark, "")
    assert calls["run_config"][0]["cfg"] == calls["grid_sweep"][0]["base_cfg"] == {"cut_year": learning.CUT}
    assert calls["grid_sweep"][0]["grid"] == {"rf_n_estimators": [100, 200, 300, 400], "rf_max_depth": [7, 10, 13], "threshold": [0.3, 0.5, 0.7]}
    models = {m: sweep.BASE_CONFIG | c for m, c in calls["per_model_configs"][0]["model_configs"].items()}
    assert models["rf"]["rf_n_estimators"] == 200 and models["rf"]["rf_max_depth"] == 10 and models["ada"]["ada_n_estimators"] == 300


def test_boost_scores_are_the_trees_votes(spark):
    df = spark.range(400).select("id", F.rand(1).alias("a"), F.rand(2).alias("b"))
    df = df.withColumn("y", (F.col("a") + F.col("b") > 1).cast("int")).cache()
    boost = training.fit_boost(df, ["a", "b"], "y", n_estimators=3, id_col="id")
    want = {}
    for alpha, model in boost.stages:
        for r in model.transform(df).select("id", "prediction").collect():
            want[r.id] = want.get(r.id, 0.0) + alpha * (2 * r.prediction - 1)
    total = sum(alpha for alpha, _ in boost.stages)
    got = {r.id: r.p for r in boost.score(df).collect()}
    assert len(boost.stages) == 3 and got.keys() == want.keys()
    assert all(abs(got[i] - 1 / (1 + math.exp(-want[i] / total))) < 1e-9 for i in want)


def test_boost_plan_does_not_grow_with_the_rounds(spark):
    df = spark.range(50).select("id", F.rand(1).alias("a"), (F.col("id") % 2).cast("int").alias("y"))
    boost = training.fit_boost(df, ["a"], "y", n_estimators=1, id_col="id")
    boost.stages = boost.stages * 200
    plan = boost.score(df)._jdf.queryExecution().analyzed().toString()
    assert plan.count("Project") <= 4
    assert boost.score(df).count() == 50
