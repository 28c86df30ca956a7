"""Unit, golden and property tests of the operators (inline fixtures)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from eventlens.functions import parse as P
from eventlens.operators import aggs as A
from eventlens.operators import clean as CL
from eventlens.operators import corr as CR
from eventlens.operators import metrics as M
from eventlens.operators import schema_ops as S
from eventlens.operators.aggs import child_rollup, rate_by_bins, right_closed_bin
from eventlens.operators.pit import prior_experience
from eventlens.operators.reshape import best_per_group


# --- unit_strings ---------------------------------------------------------------

def test_unit_strings(spark):
    df = spark.createDataFrame([("$59.5 million", "4,940 kN", "54.9 m", "100%"),
                                ("$1,059.5 million", None, None, "85.7%"),
                                (None, None, None, None)], "c string, t string, h string, p string")
    rows = df.select(P.parse_currency("c").alias("c"), P.parse_unit("t", "kN").alias("t"),
                     P.parse_unit("h", "m").alias("h"), P.parse_percent("p").alias("p")).collect()
    assert rows[0]["c"] == 59.5 and rows[1]["c"] == 1059.5 and rows[2]["c"] is None
    assert rows[0]["t"] == 4940.0 and rows[1]["t"] is None
    assert rows[0]["h"] == 54.9
    assert rows[0]["p"] == 1.0 and abs(rows[1]["p"] - 0.857) < 1e-12 and rows[2]["p"] is None


def test_bad_text_raises_under_ansi(spark):
    df = spark.createDataFrame([("$abc million",)], "c string")
    with pytest.raises(Exception):
        df.select(P.parse_currency("c")).collect()
    assert df.select(P.try_numeric(F.lit("abc")).alias("x")).first()["x"] is None


# --- pit_ties -------------------------------------------------------------------

def test_pit_ties(spark):
    """Two events of one entity at the same time are ordered by the tie-break;
    a single event is first; a null time sorts last."""
    df = spark.createDataFrame([(1, "a", 5, 1), (2, "a", 5, 0), (3, "b", 7, 1), (4, "a", None, 1)],
                               "k long, e string, t int, y int")
    out = {r["k"]: r for r in prior_experience(df, "e", "t", "k", "y", "x", base_rate=0.25).collect()}
    assert [out[i]["x_prior_launches"] for i in (1, 2, 4)] == [0, 1, 2]
    assert out[3]["x_prior_launches"] == 0 and out[3]["x_prior_success_rate"] == 0.25
    assert out[4]["x_prior_successes"] == 1 and out[4]["x_prior_success_rate"] == 0.5
    assert out[1]["x_is_first"] == 1 and out[2]["x_is_first"] == 0


def test_pit_properties(spark):
    from eventlens.plans.catalog.common import orders_y
    p = prior_experience(orders_y(spark, SF001), "o_custkey", "o_orderdate", "o_orderkey", "y", "c", blocks=3)
    bad = p.where((F.col("c_prior_successes") > F.col("c_prior_launches"))
                  | (F.col("c_prior_success_rate") < 0) | (F.col("c_prior_success_rate") > 1)).count()
    assert bad == 0
    per = p.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("c_prior_launches").alias("mx"),
                                     F.count_distinct("c_prior_launches").alias("nd"))
    assert per.where((F.col("mx") != F.col("n") - 1) | (F.col("nd") != F.col("n"))).count() == 0


# --- child_nulls ----------------------------------------------------------------

def test_child_nulls(spark):
    fact = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    child = spark.createDataFrame([(1, None), (1, None), (3, 2.0), (None, 5.0)], "k long, mass double")
    roll = child_rollup(child, "k", {"total_mass": "mass"}, "mass", "n_mass")
    got = {r["k"]: (r["total_mass"], r["n_mass"]) for r in roll.collect()}
    assert got == {1: (0.0, 0), 3: (2.0, 1)}          # all-null group sums to 0; null key dropped
    j = fact.join(roll, "k", "left")
    out = {r["k"]: r for r in CL.join_miss_flag_fill(j.withColumn("probe", F.col("n_mass")), "probe",
                                                     "missing", ["total_mass"]).collect()}
    assert out[2]["missing"] == 1 and out[2]["total_mass"] == 0 and out[1]["missing"] == 0


# --- scores_ties / metric_cells ---------------------------------------------------

def test_scores_ties(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.4, 1), (0.3, 0), (0.2, 1)], "s double, y int")
    aa = M.auc_ap(M.cum_confusion(df, "y", "s")).first()
    assert abs(aa["auc_pr"] - 0.7708333) < 1e-7
    assert abs(aa["auc_roc"] - 0.5625) < 1e-12
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    ev = BinaryClassificationEvaluator(rawPredictionCol="s", labelCol="yd", metricName="areaUnderROC", numBins=0)
    assert abs(ev.evaluate(df.withColumn("yd", F.col("y").cast("double"))) - 0.5625) < 1e-12
    pr = M.pr_curve(M.cum_confusion(df, "y", "s")).collect()
    assert any(r["threshold"] is None and r["precision"] == 1.0 and r["recall"] == 0.0 for r in pr)


# Published confusion cells and metrics (model, TP, FP, TN, FN, precision, recall, f1, f2, mcc, acc).
PUBLISHED = [
    ("RandomForest", 1068, 50, 20, 10, 0.95528, 0.99072, 0.97268, 0.98343, 0.41464, 0.94774),
    ("SVM", 1065, 52, 18, 13, 0.95345, 0.98794, 0.97039, 0.98084, 0.36180, 0.94338),
    ("XGBoost", 1069, 57, 13, 9, 0.94938, 0.99165, 0.97005, 0.98290, 0.30956, 0.94251),
    ("Logit", 1072, 63, 7, 6, 0.94449, 0.99443, 0.96882, 0.98403, 0.21356, 0.93990),
    ("Baseline majority", 1078, 70, 0, 0, 0.93902, 1.00000, 0.96855, 0.98718, 0.00000, 0.93902),
    ("Baseline prior rate", 1078, 70, 0, 0, 0.93902, 1.00000, 0.96855, 0.98718, 0.00000, 0.93902),
    ("MLP", 1075, 69, 1, 3, 0.93969, 0.99722, 0.96760, 0.98515, 0.04671, 0.93728),
    ("RUSBoost", 1061, 56, 14, 17, 0.94987, 0.98423, 0.96674, 0.97716, 0.27196, 0.93641),
    ("AdaBoost", 1042, 48, 22, 36, 0.95596, 0.96660, 0.96125, 0.96446, 0.30688, 0.92683),
]


def test_metric_cells_golden(spark):
    df = spark.createDataFrame([p[:5] for p in PUBLISHED], "model string, TP long, FP long, TN long, FN long")
    got = {r["model"]: r for r in M.cells_to_metrics(df).collect()}
    for name, *_, prec, rec, f1, f2, mcc, acc in PUBLISHED:
        r = got[name]
        for k, v in (("precision", prec), ("recall", rec), ("f1", f1), ("f2", f2), ("mcc", mcc), ("accuracy", acc)):
            assert abs(r[k] - v) < 6e-6, (name, k, r[k], v)


def test_single_class_metrics(spark):
    df = spark.createDataFrame([(1, 1), (1, 1)], "y int, pred int")
    r = M.cells_to_metrics(M.confusion(df, "y", "pred")).first()
    assert (r["TN"], r["FP"], r["FN"]) == (0, 0, 0) and r["mcc"] == 0.0 and r["f1"] == 1.0


def test_odds_ratio_golden(spark):
    from eventlens.plans.inference import odds_ratio_table
    # Two published (coef, std_err) rows and their odds ratios / CI.
    t = spark.createDataFrame([("org_is_first_launch", -1.20583, 0.37664), ("is_multistage", 1.11732, 0.56235)],
                              "feature string, coef double, std_err double")
    got = {r["feature"]: r for r in odds_ratio_table(t).collect()}
    assert abs(got["org_is_first_launch"]["odds_ratio"] - 0.29944) < 1e-4
    assert abs(got["org_is_first_launch"]["or_ci_upper"] - 0.6265) < 1e-3
    assert abs(got["is_multistage"]["or_ci_lower"] - 1.01522) < 1e-3


def test_perm_ci_golden(spark):
    from eventlens.plans.explain import importance_ci
    # mean .0222, population sd .0037 over 30 repeats: drops +/- sd alternating
    drops = spark.createDataFrame([("f", i, 0.0222 + (0.0037 if i % 2 else -0.0037)) for i in range(30)],
                                  "feature string, repeat int, drop double")
    r = importance_ci(drops).first()
    assert (r["mean_drop"], r["std_drop"], r["ci_lower"], r["ci_upper"], r["significant"]) == \
        (0.0222, 0.0037, 0.0209, 0.0235, 1)


# --- corr_columns ---------------------------------------------------------------------

def test_corr_columns_prune(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=300)
    ind = rng.normal(size=300)
    rows = [(float(x), float(x), float(-x), 1.0, float(z)) for x, z in zip(a, ind)]
    df = spark.createDataFrame(rows, "a double, dup double, inv double, const double, ind double")
    pairs = CR.pair_correlations(df, df.columns)
    assert abs(pairs[("a", "dup")] - 1) < 1e-9 and abs(pairs[("a", "inv")] + 1) < 1e-9
    assert pairs[("a", "const")] is None
    _, dropped = CR.corr_prune(df, df.columns, 0.85)
    assert set(dropped) == {"dup", "inv"} and "const" not in dropped
    near = spark.createDataFrame([(float(x), float(x + 0.01 * z2), float(z)) for x, z, z2 in
                                  zip(a, ind, rng.normal(size=300))], "a double, near double, ind double")
    kept = CR.vif_prune(near, ["a", "near", "ind"], 10.0)
    assert "ind" in kept and len(kept) == 2


def test_corr_matches_numpy_with_nulls(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=200)
    y = x * 0.5 + rng.normal(size=200)
    rows = [(float(a) if i % 7 else None, float(b) if i % 5 else None) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "x double, y double")
    mask = [i for i in range(200) if i % 7 and i % 5]
    want = np.corrcoef(x[mask], y[mask])[0, 1]
    assert abs(CR.pair_correlations(df, ["x", "y"])[("x", "y")] - want) < 1e-12


# --- binary_classes ----------------------------------------------------------------------

def test_binary_classes(spark):
    rows = [(0, 1 if i < 3 else 0, -1 if i == 0 else i, -2 if i == 0 else i, None) for i in range(20)]
    df = spark.createDataFrame(rows, "zero int, few int, m1 int, m2 int, nul double")
    got = {r["column"]: (r["kind"], r["sentinel"]) for r in S.classify_columns(df, df.columns).collect()}
    assert got["zero"] == ("binary", 0) and got["few"] == ("binary", 0) and got["nul"] == ("binary", 0)
    assert got["m1"] == ("continuous", 1) and got["m2"] == ("continuous", 0)
    keep = S.drop_rare_binary(df, ["zero", "few"], 10)
    assert "few" not in keep and "zero" not in keep and "m1" in keep


# --- bins / best rows / one-hot -----------------------------------------------------------

def test_right_closed_bins(spark):
    df = spark.createDataFrame([(v, 1) for v in (-1, 0, 1, 4, 5, 999, 1000)], "n int, y int")
    got = {r["n"]: r["b"] for r in df.select("n", right_closed_bin("n", [-1, 0, 4, 999], ["z", "s", "l"]).alias("b"))
           .collect()}
    assert got == {-1: None, 0: "z", 1: "s", 4: "s", 5: "l", 999: "l", 1000: None}
    assert rate_by_bins(df, "n", [-1, 0, 4, 999], ["z", "s", "l"], "y").count() == 3


def test_best_per_group_true_row(spark):
    df = spark.createDataFrame([("m", 0.9, "run2", None), ("m", 0.9, "run1", 5.0), ("m", 0.5, "run0", 7.0)],
                               "model string, f1 double, run_id string, extra double")
    r = best_per_group(df, ["model"], desc=["f1"], asc=["run_id"]).first()
    assert (r["run_id"], r["extra"]) == ("run1", 5.0)


def test_one_hot_null_all_zero(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    rows = CL.one_hot(df, "c", "c").collect()
    assert [(r["c_a"], r["c_b"]) for r in rows] == [(1, 0), (0, 1), (0, 0)]


def test_sentinel_flag_only_when_nulls(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 3.0)], "`Price (x)` double, ok double")
    out = CL.sentinel_flag_fill(df, ["Price (x)", "ok", "absent"])
    assert "Price_x_missing" in out.columns and "ok_missing" not in out.columns
    assert [r["Price (x)"] for r in out.collect()] == [1.0, -1.0]


def test_star_join_row_check(spark):
    from eventlens.plans.cleaning import Dim, star_join
    fact = spark.createDataFrame([(1, 10), (2, 20)], "k long, d long")
    dup_dim = spark.createDataFrame([(10, "x"), (10, "y")], "d long, v string")
    with pytest.raises(ValueError):
        star_join(fact, [Dim(dup_dim, "d", "d", suffix="_r")])
    ok = star_join(fact, [Dim(dup_dim.limit(1), "d", "d", suffix="_r")])
    assert ok.count() == 2


def test_rolling_centered_equals_pandas(spark):
    rng = np.random.default_rng(3)
    vals = [None if i % 11 == 0 else float(v) for i, v in enumerate(rng.normal(size=200))]
    df = spark.createDataFrame(list(enumerate(vals)), "k long, v double")
    a = {r["k"]: r["rolling"] for r in A.rolling_centered_mean(df, "k", "v", 5).collect()}
    import pandas as pd
    want = pd.Series(vals, dtype=float).rolling(5, center=True).mean()
    b = {k: None if np.isnan(v) else v for k, v in want.items()}
    assert a.keys() == b.keys()
    for k in a:
        assert (a[k] is None and b[k] is None) or abs(a[k] - b[k]) < 1e-12


def test_histogram_edges(spark):
    from eventlens.operators.profile import histogram
    # min = max: every value in bucket 1; nulls counted in the null bucket
    df = spark.createDataFrame([(2.0,)] * 5 + [(None,)], "x double")
    got = {r["bucket"]: r["n"] for r in histogram(df, "x", 30).collect()}
    assert got == {1: 5, None: 1}
    # the maximum falls in the last bucket (closed), the minimum in the first
    df = spark.createDataFrame([(float(v),) for v in range(31)], "x double")
    rows = {r["bucket"]: (r["n"], r["lo"], r["hi"]) for r in histogram(df, "x", 30).collect()}
    assert sum(v[0] for v in rows.values()) == 31 and rows[30][0] == 2 and rows[1][0] == 1
    assert rows[1][1] == 0.0 and abs(rows[30][2] - 30.0) < 1e-12
    # all null: one null bucket
    df = spark.createDataFrame([(None,)] * 3, "x double")
    assert [(r["bucket"], r["n"]) for r in histogram(df, "x", 30).collect()] == [(None, 3)]
