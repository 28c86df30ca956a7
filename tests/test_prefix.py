"""The two-level (blocked) prefix sums equal the plain window."""

from pyspark.sql import functions as F

from conftest import SF001
from eventlens.operators.pit import prior_experience
from eventlens.operators.prefix import exact_quantiles, global_rank, running_totals
from eventlens.plans.catalog.common import orders_y


def _rows(df, cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_blocked_equals_plain_hot_entity(spark):
    o = orders_y(spark, SF001)
    cols = ["o_orderkey", "prio_prior_launches", "prio_prior_successes", "prio_prior_success_rate", "prio_is_first"]
    plain = prior_experience(o, "o_orderpriority", "o_orderdate", "o_orderkey", "y", "prio", blocks=1)
    blocked = prior_experience(o, "o_orderpriority", "o_orderdate", "o_orderkey", "y", "prio", blocks=7)
    assert _rows(plain, cols) == _rows(blocked, cols)


def test_null_entity_gets_nulls(spark):
    df = spark.createDataFrame(
        [(1, "a", 1, 1), (2, "a", 1, 0), (3, "b", 2, 1), (4, None, 3, 1), (5, "a", None, 1)],
        "k long, e string, t int, y int")
    out = {r["k"]: r for r in prior_experience(df, "e", "t", "k", "y", "x", base_rate=0.5).collect()}
    assert out[4]["x_prior_launches"] is None
    assert (out[1]["x_prior_launches"], out[2]["x_prior_launches"], out[5]["x_prior_launches"]) == (0, 1, 2)
    assert out[2]["x_prior_successes"] == 1 and out[1]["x_prior_success_rate"] == 0.5
    assert out[5]["x_prior_success_rate"] == 0.5  # 1 success of 2 prior


def test_global_rank_blocked(spark):
    df = spark.range(0, 5000).withColumn("v", (F.col("id") * 7919) % 5003)
    r = global_rank(df, [F.col("v"), F.col("id")], blocks=5)
    got = [x["id"] for x in r.orderBy("rank").collect()]
    want = [x["id"] for x in df.orderBy("v", "id").collect()]
    assert got == want
    assert r.agg(F.min("rank"), F.max("rank")).first() == (0, 4999)


def test_running_totals_inclusive(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(100)], "k long, v long")
    out = running_totals(df, ["k"], ["v"], inclusive=True, blocks=4)
    rows = {r["k"]: (r["prior_n"], r["prior_v"]) for r in out.collect()}
    assert rows[0] == (1, 0) and rows[99] == (100, sum(i % 3 for i in range(100)))


def test_exact_quantiles_match_numpy(spark):
    import numpy as np
    vals = [float(x) for x in np.random.default_rng(3).normal(size=501)] + [1.0] * 40
    df = spark.createDataFrame([(v,) for v in vals] + [(None,)], "x double")
    q = exact_quantiles(df, ["x"], [0.0, 0.25, 0.5, 0.75, 1.0])["x"]
    assert np.allclose(q, np.quantile(np.array(vals), [0, .25, .5, .75, 1.0]))


def test_exact_quantiles_blocked_two_columns(spark):
    """Blocked prefix sums (tiny blocks), a hot value, two columns, one all-null."""
    import numpy as np
    rng = np.random.default_rng(11)
    a = [float(x) for x in rng.integers(0, 50, size=400)] + [7.0] * 200
    b = [float(x) for x in rng.normal(size=600)]
    df = spark.createDataFrame([(x, y, None) for x, y in zip(a, b)], "a double, b double, z double")
    probs = [0.1, 0.25, 0.5, 0.9]
    q = exact_quantiles(df, ["a", "b", "z"], probs, blocks=7)
    assert np.allclose(q["a"], np.quantile(np.array(a), probs))
    assert np.allclose(q["b"], np.quantile(np.array(b), probs))
    assert q["z"] == [None] * 4
