"""The logit in one pass an iteration, against MLlib's GLM and numpy."""

import numpy as np
import pytest
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import functions as F

from eventlens.plans import inference as I
from eventlens.plans.training import assemble


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(800, 3)) * [1.0, 50.0, 0.01] + [0.0, 1000.0, 0.0]
    y = rng.random(800) < 1 / (1 + np.exp(-(0.4 + x[:, 0] - 0.02 * (x[:, 1] - 1000))))
    rows = [(int(v), *map(float, r), float(r[0] + 2)) for v, r in zip(y, x)]
    return spark.createDataFrame(rows, "y int, a double, b double, `c.d` double, again double").repartition(3).cache()


def test_equals_glm(spark, frame):
    d = frame.withColumnRenamed("c.d", "c")
    rows = I.wald_table(d, ["a", "b", "c"], "y")
    glm = GeneralizedLinearRegression(family="binomial", link="logit", labelCol="y", maxIter=50, tol=1e-12).fit(assemble(d, ["a", "b", "c"]))
    assert np.allclose([r["coef"] for r in rows], [glm.intercept, *glm.coefficients], rtol=1e-6)
    se = list(glm.summary.coefficientStandardErrors)
    assert np.allclose([r["std_err"] for r in rows], [se[-1], *se[:-1]], rtol=1e-6)
    p = list(glm.summary.pValues)
    assert np.allclose([r["p_value"] for r in rows], [p[-1], *p[:-1]], atol=1e-6)
    dotted = I.wald_table(frame, ["a", "b", "c.d"], "y")
    assert np.allclose([r["coef"] for r in dotted], [r["coef"] for r in rows])


def test_one_job_an_iteration(spark, frame):
    calls, real = [], I.logit_moments
    try:
        I.logit_moments = lambda *a: calls.append(1) or real(*a)
        beta, _ = I.fit_wald(frame, ["a", "b"], "y")
        cold = len(calls)
        again, _ = I.fit_wald(frame, ["a", "b"], "y", beta)
    finally:
        I.logit_moments = real
    assert cold <= 9 and len(calls) - cold <= 2 and np.allclose(beta, again)


def test_singular_design(spark, frame):
    """``again`` is ``a`` + 2: fitted values are those without it, and the
    errors are the pseudo-inverse's."""
    rows = I.wald_table(frame, ["a", "again"], "y")
    alone = {r["feature"]: r["coef"] for r in I.wald_table(frame, ["a"], "y")}
    by = {r["feature"]: r for r in rows}
    assert by["a"]["coef"] + by["again"]["coef"] == pytest.approx(alone["a"], rel=1e-6)
    assert by["const"]["coef"] + 2 * by["again"]["coef"] == pytest.approx(alone["const"], rel=1e-6)
    p = frame.toPandas()
    x = np.column_stack([np.ones(len(p)), p.a, p.again])
    q = 1 / (1 + np.exp(-(x @ [r["coef"] for r in rows])))
    want = np.sqrt(np.diag(np.linalg.pinv(x.T @ (x * (q * (1 - q))[:, None]), rcond=1e-12)))
    assert np.allclose([r["std_err"] for r in rows], want, rtol=1e-6)


def test_hard_cases(spark, frame):
    with pytest.raises(ValueError, match="1 rows"):
        I.wald_table(frame.unionByName(frame.limit(1).withColumn("a", F.lit(None).cast("double"))), ["a"], "y")
    assert all(r["coef"] == 0 and r["std_err"] == 0 for r in I.wald_table(frame.where("y > 1"), ["a"], "y"))
    apart = frame.withColumn("a", F.col("y") * 2.0 - 1)  # the feature is the label
    row = I.wald_table(apart, ["a"], "y")[1]
    assert row["coef"] > 10 and row["p_value"] > 0.5


def test_backward_select_drops_noise(spark, frame):
    kept, rows = I.backward_select(frame.withColumnRenamed("c.d", "c"), ["a", "b", "c"], "y")
    assert kept == ["a", "b"] and [r["feature"] for r in rows] == ["const", "a", "b"]
