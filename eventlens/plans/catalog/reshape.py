"""Best rows, de-duplication, top-k, unions, pivots, sensitivity axes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import metrics as M
from ...operators import reshape as R
from ...operators.corr import target_corr
from ...sources.tables import table
from .. import sweep as SW
from ..registry import query, rounded
from .common import Y_SQL
from .evaluation import MODELS_SQL, scored
from .profiling import _CORR_COLS, _CORR_SRC, _corr_expr, _corr_frame


@query("best_per_group", """SELECT o_custkey, o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY round(o_totalprice, -4) DESC, o_orderkey) AS rn
  FROM orders) WHERE rn = 1""")
def q_best_per_group(spark, sf):
    """Best order per customer by price bucket (ties common) then lowest key."""
    o = table(spark, sf, "orders").withColumn("bucket", F.round("o_totalprice", -4))
    best = R.best_per_group(o, ["o_custkey"], desc=["bucket"], asc=["o_orderkey"])
    return rounded(best.select("o_custkey", "o_orderkey", "o_totalprice"))


@query("dedup_keep_best", """SELECT o_custkey, o_orderpriority, o_orderkey FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority
                               ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def q_dedup_keep_best(spark, sf):
    """Latest order per (customer, priority); ties on date -> lowest key."""
    o = table(spark, sf, "orders").withColumn("t", F.unix_micros(F.col("o_orderdate").cast("timestamp")))
    return R.dedup_keep_best(o, ["o_custkey", "o_orderpriority"], desc=["t"], asc=["o_orderkey"]).select(
        "o_custkey", "o_orderpriority", "o_orderkey")


@query("topk", """SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM orders
ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""")
def q_topk(spark, sf):
    return rounded(R.topk(table(spark, sf, "orders"), 10, ["o_totalprice"], ["o_orderkey"])
                   .select("o_orderkey", "o_totalprice"))


@query("first_failures", f"""SELECT o_orderkey, o_custkey FROM (SELECT *, {Y_SQL} AS y FROM orders)
WHERE y = 0 ORDER BY o_orderkey LIMIT 20""")
def q_first_failures(spark, sf):
    from .common import orders_y
    o = orders_y(spark, sf).where("y = 0")
    return R.topk(o, 20, asc=["o_orderkey"]).select("o_orderkey", "o_custkey")


@query("sort_by_abs", "SELECT feature, round(r, 6) AS r, CAST(row_number() OVER (ORDER BY round(abs(r), 9) DESC NULLS LAST, "
                      "feature) AS INTEGER) AS rank FROM (" + " UNION ALL ".join(
                          f"SELECT '{c}' AS feature, {_corr_expr(c, 'y')} AS r FROM {_CORR_SRC}" for c in _CORR_COLS)
                      + ")")
def q_sort_by_abs(spark, sf):
    """Target correlations ordered by absolute size."""
    tc = target_corr(_corr_frame(spark, sf), _CORR_COLS, "y").select("feature", "r")
    return rounded(R.sort_by_abs(tc, "r", "feature"))


@query("union_results", f"""{MODELS_SQL},
  a AS (SELECT model, count(*) FILTER (WHERE y = 1 AND score >= 0.5) AS TP, count(*) FILTER (WHERE y = 0 AND score >= 0.5) AS FP
        FROM m WHERE model <> 'const' GROUP BY model),
  b AS (SELECT 'Baseline majority' AS model, round(avg(y), 6) AS p, count(*) AS n FROM m WHERE model = 'const')
SELECT model, TP, FP, NULL::DOUBLE AS p, NULL::BIGINT AS n FROM a
UNION ALL SELECT model, NULL, NULL, p, n FROM b""")
def q_union_results(spark, sf):
    """Two result frames with unequal columns appended by name."""
    s = scored(spark, sf)
    a = M.confusion(s.where("model <> 'const'").withColumn("pred", (F.col("score") >= 0.5).cast("int")),
                    "y", "pred", ["model"]).select("model", "TP", "FP")
    b = s.where("model = 'const'").agg(F.avg("y").alias("p"), F.count(F.lit(1)).alias("n")).select(
        F.lit("Baseline majority").alias("model"), "p", "n")
    return rounded(R.union_results([a, b]))


# --- importance reports -------------------------------------------------------

# Two linear scorers over order features (coefficient per
# feature) used to derive per-row linear Shapley contributions.
LINEAR_SCORERS = {
    "lin_a": {"o_totalprice": 1.0e-5, "o_custkey": 2.0e-3, "month": -0.05},
    "lin_b": {"o_totalprice": -2.0e-6, "o_custkey": 5.0e-4, "month": 0.1},
}
_FEATS = ["o_totalprice", "o_custkey", "month"]


def order_features(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.col("o_custkey").cast("double")
                                             .alias("o_custkey"), F.month("o_orderdate").cast("double").alias("month"))


_ORDER_FEATS_SQL = ("(SELECT o_orderkey, o_totalprice, CAST(o_custkey AS DOUBLE) AS o_custkey, "
                    "CAST(month(o_orderdate) AS DOUBLE) AS month FROM orders)")


def _shap_long_sql():
    means = ", ".join(f"avg({f}) AS m_{f}" for f in _FEATS)
    parts = []
    for model, coef in LINEAR_SCORERS.items():
        for f in _FEATS:
            parts.append(f"SELECT '{model}' AS model, o_orderkey, '{f}' AS feature, {f} AS value, "
                         f"{coef[f]} * ({f} - m_{f}) AS shap FROM {_ORDER_FEATS_SQL}, mm")
    return f"WITH mm AS (SELECT {means} FROM {_ORDER_FEATS_SQL}), sl AS ({' UNION ALL '.join(parts)})"


@query("shapley_linear", _shap_long_sql() + " SELECT model, o_orderkey, feature, round(value, 6) AS value, "
                                            "round(shap, 6) AS shap FROM sl")
def q_shapley_linear(spark, sf):
    from ..explain import linear_shapley
    df = order_features(spark, sf)
    parts = [linear_shapley(df, coef, "o_orderkey").withColumn("model", F.lit(m))
             for m, coef in LINEAR_SCORERS.items()]
    return rounded(R.union_results(parts).select("model", "o_orderkey", "feature", "value", "shap"))


@query("shap_report", _shap_long_sql() + """,
  per AS (SELECT feature, model, avg(abs(shap)) AS v FROM sl GROUP BY ALL)
SELECT feature, round(max(v) FILTER (WHERE model = 'lin_a'), 6) AS lin_a, round(max(v) FILTER (WHERE model = 'lin_b'), 6) AS lin_b,
       round(avg(v), 6) AS mean FROM per GROUP BY feature""")
def q_shap_report(spark, sf):
    """Mean |Shapley| per feature and model, with the cross-model mean."""
    from ..explain import linear_shapley, shap_report
    df = order_features(spark, sf)
    parts = [linear_shapley(df, coef, "o_orderkey").withColumn("model", F.lit(m))
             for m, coef in LINEAR_SCORERS.items()]
    return rounded(shap_report(R.union_results(parts), list(LINEAR_SCORERS)))


def _shap_long(spark, sf):
    from ..explain import linear_shapley
    df = order_features(spark, sf)
    return R.union_results([linear_shapley(df, coef, "o_orderkey").withColumn("model", F.lit(m)) for m, coef in LINEAR_SCORERS.items()])


@query("case_contributions", _shap_long_sql() + f""",
  ff AS (SELECT o_orderkey FROM (SELECT *, {Y_SQL} AS y FROM orders) WHERE y = 0 ORDER BY o_orderkey LIMIT 20)
SELECT model, o_orderkey, feature, round(value, 6) AS value, round(shap, 6) AS shap, CAST(rank AS INTEGER) AS rank
FROM (SELECT sl.*, row_number() OVER (PARTITION BY model, sl.o_orderkey ORDER BY abs(shap) DESC, feature) AS rank
      FROM sl JOIN ff ON sl.o_orderkey = ff.o_orderkey) WHERE rank <= 15""")
def q_case_contributions(spark, sf):
    """The 15 largest contributions to each of the first 20 failures."""
    from ..explain import case_contributions
    from .common import orders_y
    failures = R.topk(orders_y(spark, sf).where("y = 0"), 20, asc=["o_orderkey"])
    out = case_contributions(_shap_long(spark, sf), failures, "o_orderkey")
    return rounded(out.select("model", "o_orderkey", "feature", "value", "shap", "rank"))


@query("top_features", _shap_long_sql() + """,
  per AS (SELECT model, feature, avg(abs(shap)) AS importance FROM sl GROUP BY ALL),
  b AS (SELECT * FROM per UNION ALL SELECT 'all models', feature, avg(importance) FROM per GROUP BY feature)
SELECT model, feature, round(importance, 6) AS importance, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY importance DESC, feature) AS rank FROM b) WHERE rank <= 15""")
def q_top_features(spark, sf):
    """Ranked features by mean |shap|, per model and across models."""
    from ..explain import top_features
    return rounded(top_features(_shap_long(spark, sf)).select("model", "feature", "importance", "rank"))


@query("importance_pivot", f"""{MODELS_SQL},
  imp AS (SELECT model, 'score_mean' AS feature, avg(score) AS v FROM m GROUP BY model
          UNION ALL SELECT model, 'pos_score_mean', avg(score) FILTER (WHERE y = 1) FROM m GROUP BY model)
SELECT feature, round(max(v) FILTER (WHERE model = 'len97'), 6) AS len97, round(max(v) FILTER (WHERE model = 'id13'), 6) AS id13,
       round(max(v) FILTER (WHERE model = 'const'), 6) AS const, round(avg(v), 6) AS mean FROM imp GROUP BY feature""")
def q_importance_pivot(spark, sf):
    s = scored(spark, sf)
    long = s.groupBy("model").agg(F.avg("score").alias("score_mean"),
                                  F.avg(F.when(F.col("y") == 1, F.col("score"))).alias("pos_score_mean"))
    long = R.unpivot(long, ["model"], ["score_mean", "pos_score_mean"], "feature", "v")
    return rounded(R.importance_pivot(long, "feature", "model", "v", ["len97", "id13", "const"]))


# --- sensitivity axis -----------------------------------------------------------

_AXIS_KEYS = {"len97": {"threshold"}, "id13": {"threshold"}, "const": {"threshold"}, "Baseline x": {"threshold"}}


_F1_BY_T_SQL = f"""{MODELS_SQL},
  r AS (SELECT model, t AS threshold,
               CASE WHEN 2 * count(*) FILTER (WHERE y = 1 AND score >= t) + count(*) FILTER (WHERE y = 0 AND score >= t)
                         + count(*) FILTER (WHERE y = 1 AND score < t) = 0 THEN 0
                    ELSE 2.0 * count(*) FILTER (WHERE y = 1 AND score >= t)
                         / (2 * count(*) FILTER (WHERE y = 1 AND score >= t) + count(*) FILTER (WHERE y = 0 AND score >= t)
                            + count(*) FILTER (WHERE y = 1 AND score < t)) END AS f1
        FROM m, (VALUES (0.3), (0.5), (0.7)) th(t) GROUP BY model, t)"""


@query("sensitivity_axis", f"""{_F1_BY_T_SQL},
  pv AS (SELECT model, 'threshold' AS param, CAST(CAST(threshold AS DOUBLE) AS VARCHAR) AS value, max(f1) AS best_metric
         FROM r GROUP BY ALL),
  ax AS (SELECT model, param, arg_max(value, (best_metric, value)) AS bv FROM pv GROUP BY ALL HAVING count(*) >= 2)
SELECT pv.model, pv.param, pv.value, round(pv.best_metric, 6) AS best_metric, CAST(pv.value = ax.bv AS INTEGER) AS is_best
FROM pv JOIN ax USING (model, param)""")
def q_sensitivity_axis(spark, sf):
    """F1 by threshold per scorer (only pairs with >= 2 values), best marked."""
    res = M.metrics_table(scored(spark, sf), "y", "score", [0.3, 0.5, 0.7], ["model"])
    return rounded(SW.sensitivity_axis(res, ["threshold"], model_keys=_AXIS_KEYS))


@query("typed_config", f"""{_F1_BY_T_SQL}
SELECT model, CAST(0 AS BIGINT) AS run, CAST(threshold AS DOUBLE) AS threshold, round(f1, 6) AS f1
FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, threshold) AS rn FROM r) WHERE rn = 1""")
def q_typed_config(spark, sf):
    """Best result row per scorer (F1; ties -> lowest threshold) turned into a
    typed configuration struct, then read back field by field."""
    res = M.metrics_table(scored(spark, sf), "y", "score", [0.3, 0.5, 0.7], ["model"]).withColumn(
        "run", F.lit(0).cast("bigint"))
    best = SW.best_configs(res).select("model", "run", "threshold", "f1")
    cfg = SW.typed_config(best, "run bigint, threshold double, f1 double")
    return rounded(cfg.select("model", "config.run", "config.threshold", "config.f1"))
