"""Sinks, seeded draws, pruning, and operators on odd values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventlens.functions.rng import uniform
from eventlens.operators import clean, corr, profile, schema_ops
from eventlens.operators.pit import prior_experience
from eventlens.plans import explain, sweep
from eventlens.sources import files


def test_missing_input_is_a_typed_error(spark, tmp_path):
    for read in (lambda: files.read_csv_typed(spark, str(tmp_path / "no.csv"), "a int"), lambda: files.read_parquet(spark, str(tmp_path / "no.parquet")),
                 lambda: files.read_versioned(spark, str(tmp_path / "none"))):
        with pytest.raises(files.SourceError):
            read()


def test_malformed_csv_fails(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2\nx,3\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_csv_typed(spark, str(tmp_path / "x.csv"), "a int, b int").collect()


def test_versions_are_unique_and_repeatable(spark, tmp_path):
    path = str(tmp_path / "v")
    one, two = files.write_versioned(spark.range(3), path), files.write_versioned(spark.range(5), path)
    assert one != two
    files.write_versioned(spark.range(7), path, "9999")
    files.write_versioned(spark.range(7), path, "9999")
    assert files.read_versioned(spark, path, one).count() == 3
    assert files.read_versioned(spark, path).count() == 7


def test_draws_are_independent(spark):
    df = spark.range(4000).select("id", uniform("id", 1).alias("a"), uniform("id", 2).alias("b"), uniform("id", F.col("id") % 3).alias("c"))
    rows = np.array([tuple(r) for r in df.collect()])
    a, b = rows[:, 1], rows[:, 2]
    assert abs(np.corrcoef(a, b)[0, 1]) < 0.06 and abs(np.corrcoef(a[1:], a[:-1])[0, 1]) < 0.06
    assert np.allclose(np.histogram(a, 10, (0, 1))[0], 400, atol=90)
    assert len(set(np.round((b - a) % 1, 9))) > 3900  # not one rotation


def test_permutations_differ_by_feature_and_repeat(spark):
    df = spark.range(50).select("id", F.col("id").cast("double").alias("x"), F.col("id").cast("double").alias("y"))
    got = {}
    for r in explain.permuted_frame(df, ["x", "y"], "id", 3).collect():
        got.setdefault((r["feature"], r["repeat"]), {})[r["id"]] = r[r["feature"]]
    perms = [tuple(v for _, v in sorted(p.items())) for p in got.values()]
    assert len(got) == 6 and len(set(perms)) == 6 and all(sorted(p) == list(range(50)) for p in perms)
    assert len({tuple((p[i] - perms[0][i]) % 50 for i in range(50)) for p in perms}) == 6


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 97, 100, 1000])
def test_keyed_permutations_are_bijections(spark, n):
    from eventlens.functions.rng import with_permutation
    df = spark.range(n).withColumn("key", F.explode(F.expr("sequence(bigint(42), bigint(49))")))
    got = {}
    for r in with_permutation(df, "id", "key", n, "h").collect():
        got.setdefault(r["key"], {})[r["id"]] = r["h"]
    assert all(sorted(p.values()) == list(range(n)) for p in got.values())
    if n == 1000:
        places = np.array([[p[i] for i in range(n)] for _, p in sorted(got.items())])
        assert np.abs(np.corrcoef(np.vstack([places, np.arange(n)])) - np.eye(9)).max() < 0.12
        steps = np.diff(places, axis=1)
        assert all(len(np.unique(s)) > 500 for s in steps) and abs((steps > 0).mean() - 0.5) < 0.05


def test_many_events_of_one_entity(spark):
    df = spark.range(12_000).select(F.col("id").alias("k"), F.lit("e").alias("e"), F.col("id").alias("t"), (F.col("id") % 2).cast("int").alias("y"))
    out = prior_experience(df, "e", "t", "k", "y", "p", base_rate=0.5)
    assert out.where((F.col("p_prior_launches") != F.col("k")) | (F.col("p_prior_successes") != F.floor(F.col("k") / 2))).count() == 0


def test_numeric_features_only(spark):
    df = spark.createDataFrame([(1, "a", 2.0, 3, True)], "id long, s string, x double, y int, b boolean")
    assert schema_ops.feature_cols(df, "y", ["id"]) == ["x"]


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (float("nan"),), (None,)], "x double")
    r = profile.describe_numeric(df, ["x"]).first()
    assert (r["count"], r["mean"], r["max"], r["p50"]) == (2, 2.0, 3.0, 2.0)
    h = {b["bucket"]: b["n"] for b in profile.histogram(df, "x", 2).collect()}
    assert h == {1: 1, 2: 1, None: 2}


def test_constant_and_varied_columns(spark):
    df = spark.createDataFrame([(1, "a", None, i, i % 3, i % 2) for i in range(9)], "one int, s string, n int, many int, three int, two int")
    assert {r["column"]: r["dropped"] for r in clean.constant_table(df).collect()} == {"one": 1, "s": 1, "n": 1, "many": 0, "three": 0, "two": 0}
    cols = ["one", "n", "many", "three", "two"]
    assert schema_ops.varied_columns(df, cols, 3) == ["many", "three"] and schema_ops.varied_columns(df, cols, 2) == ["many", "three", "two"]
    assert schema_ops.varied_columns(df, cols, 4) == ["many"]
    assert "Expand" not in schema_ops.column_stats(df, cols)._jdf.queryExecution().toString()


def test_vif_of_two_columns_and_exact_dependence(spark):
    rng = np.random.default_rng(5)
    a, b, c = rng.normal(size=(3, 400))
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(a, b, a + 0.1 * c, a + b)], "a double, b double, n double, s double")
    r = np.corrcoef(a, a + 0.1 * c)[0, 1]
    assert corr.vif_prune(df, ["a", "n"], 1 / (1 - r * r) + 1e-6) == ["a", "n"]
    assert len(corr.vif_prune(df, ["a", "n"], 1 / (1 - r * r) - 1e-6)) == 1
    kept = corr.vif_prune(df, ["a", "b", "s"], 1e9)
    assert len(kept) == 2


def test_grid_axes_without_effect_are_refused(spark):
    with pytest.raises(ValueError):
        sweep.grid_runs(spark, {"mlp_alpha": [1, 2]}, sweep.BASE_CONFIG)
    assert sweep.resolve_model(" Neural network ") == "MLP" and sweep.resolve_model("LR") == "Logit" and sweep.resolve_model("svc") == "SVM"
    assert math.isclose(sweep.BASE_CONFIG["mlp_alpha"], 1e-3)


@pytest.mark.parametrize("offset", [0.0, 1e6, 1e8])
def test_knn_far_from_the_origin(spark, offset):
    from eventlens.operators.knn import knn_join
    x = np.random.default_rng(2).integers(-500, 500, size=(200, 3)) / 16 + offset
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, v array<double>")
    got = {(r["id"], r["rank"]): r["nn_id"] for r in knn_join(df, df, "id", "v", 5, block_rows=64).collect()}
    d = np.round(((x[:, None] - x[None]) ** 2).sum(2), 6)
    np.fill_diagonal(d, np.inf)
    for i in range(200):
        order = sorted((d[i, j], j) for j in range(200))[:5]
        assert [got[i, k + 1] for k in range(5)] == [j for _, j in order]


def test_experience_bin_has_no_end(spark, tmp_path):
    """A customer with more than 1,000 earlier orders is in the last bin, in the query and in its SQL."""
    from oracle import compare
    import duckdb
    from eventlens.plans.catalog.core import EXPERIENCE_SQL, experience_outcome
    o = spark.range(1, 1301).selectExpr("id AS o_orderkey", "CAST(if(id <= 1250, 1, id) AS BIGINT) AS o_custkey", "if(id % 3 = 0, 'F', 'O') AS o_orderstatus",
                                        "date_add(date'1995-01-01', CAST(id AS INT)) AS o_orderdate", "CAST(id AS DOUBLE) AS o_totalprice", "'1-URGENT' AS o_orderpriority")
    li = spark.range(1, 900).selectExpr("id AS l_orderkey", "CAST(1 AS BIGINT) AS l_linenumber", "CAST(2 AS DOUBLE) AS l_quantity", "CAST(3 AS DOUBLE) AS l_extendedprice")
    o.write.parquet(f"{tmp_path}/orders.parquet")
    li.write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = experience_outcome(spark, str(tmp_path))
    assert not compare(got, con, EXPERIENCE_SQL)
    assert sum(r["n"] for r in got.collect()) == 1300


def test_permuted_values_travel_without_rows(spark, monkeypatch):
    """Every copy of a row takes the value at its rank's place under the keyed
    bijection, nulls included, over many blocks, and no join carries rows."""
    import numpy as np
    from eventlens.functions.rng import permuted, with_permutation
    from eventlens.plans import explain
    n = 53
    df = spark.createDataFrame([(i, i % 2, None if i % 5 == 0 else float(i), float(-i)) for i in range(n)], "id long, y int, a double, b double")
    monkeypatch.setattr(explain, "PERMUTED_ROWS", 7)
    out = explain.permuted_frame(df, ["a", "b"], "id", 3, seed=9)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r["feature"], r["repeat"], r["id"]): (r["y"], r["a"], r["b"]) for r in out.collect()}
    assert len(got) == n * 6
    ranks = spark.range(n).withColumn("key", F.lit(0).cast("bigint"))
    for j, f in enumerate(["a", "b"]):
        for k in range(3):
            key = explain.permutation_seed(j, k, 9)
            h = {r["id"]: r["h"] for r in with_permutation(ranks.withColumn("key", F.lit(key).cast("bigint")), "id", "key", n, "h").collect()}
            there = permuted(np.arange(n), key, n)
            assert there.tolist() == [h[i] for i in range(n)] and permuted(there, key, n, back=True).tolist() == list(range(n))
            for i in range(n):
                a, b = (h[i] if f == "a" else i), (h[i] if f == "b" else i)
                assert got[f, k, i] == (i % 2, None if a % 5 == 0 else float(a), float(-b))


def test_grouped_auc_needs_no_table_of_scores(spark, monkeypatch):
    """Exact whatever the ranges are, with ties over their edges, one class, and null scores."""
    from eventlens.operators.metrics import auc_ap, cum_confusion
    from eventlens.plans import explain
    rng = np.random.default_rng(4)
    rows = [(f, k, int(rng.integers(0, 2)) if (f, k) != ("b", 1) else 1, None if i % 50 == 0 else float(rng.integers(0, 9 if k else 10**9)) / 10) for f in "ab" for k in range(2) for i in range(400)]
    scored = spark.createDataFrame(rows, "feature string, repeat int, y int, p double").repartition(5)
    keys = ["feature", "repeat"]
    want = {(r["feature"], r["repeat"]): r["auc_roc"] for r in auc_ap(cum_confusion(scored, "y", "p", keys), keys).collect()}
    monkeypatch.setattr(explain, "cum_confusion", None)
    for edges in ([], [0.4], [0.1, 0.2, 0.2, 0.5, 3e7, 7e7]):
        got = {(r["feature"], r["repeat"]): r["metric"] for r in explain.grouped_auc(scored, "y", edges, ["b", "a"]).collect()}
        assert got.keys() == want.keys() and got["b", 1] is None and want["b", 1] is None
        assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want if want[k] is not None)
