"""Metrics over score tables: three fixed scorers of labelled documents act
as "models" (y = document quality)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ...operators import metrics as M
from ...sources.tables import table
from ..registry import query, rounded

# The scorer definitions (shared with the SQL oracles).
MODELS_SQL = """WITH s AS (SELECT l.doc_id, l.quality AS y, d.n_chars FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
  m AS (SELECT 'len97' AS model, doc_id, y, CAST(n_chars % 97 AS DOUBLE) / 96.0 AS score FROM s
        UNION ALL SELECT 'id13', doc_id, y, CAST(doc_id % 13 AS DOUBLE) / 12.0 FROM s
        UNION ALL SELECT 'const', doc_id, y, 0.5 FROM s)"""

THRESHOLDS = [0.3, 0.5, 0.7]


def scored(spark, sf) -> DataFrame:
    lab = table(spark, sf, "labels")
    doc = table(spark, sf, "documents").select("doc_id", "n_chars")
    s = lab.join(doc, "doc_id").select("doc_id", F.col("quality").alias("y"), "n_chars")
    # one pass: each labelled document yields one row per scorer (a generator, not a join)
    scorers = F.array(
        F.struct(F.lit("len97").alias("model"), ((F.col("n_chars") % 97).cast("double") / 96.0).alias("score")),
        F.struct(F.lit("id13").alias("model"), ((F.col("doc_id") % 13).cast("double") / 12.0).alias("score")),
        F.struct(F.lit("const").alias("model"), F.lit(0.5).alias("score")))
    return s.select("doc_id", "y", F.explode(scorers).alias("m")).select("m.model", "doc_id", "y", "m.score")


def _pred_sql(t=0.5):
    return f"CAST(score >= {t} AS INTEGER)"


_CELLS_SQL = f"""{MODELS_SQL},
  cells AS (SELECT model, t AS threshold,
     count(*) FILTER (WHERE y = 1 AND score >= t) AS TP, count(*) FILTER (WHERE y = 0 AND score >= t) AS FP,
     count(*) FILTER (WHERE y = 0 AND score < t) AS TN, count(*) FILTER (WHERE y = 1 AND score < t) AS FN
     FROM m, (VALUES (0.3), (0.5), (0.7)) th(t) GROUP BY model, t),
  met AS (SELECT *,
     CASE WHEN TP + TN + FP + FN = 0 THEN 0 ELSE (TP + TN) / (TP + TN + FP + FN) END AS accuracy,
     CASE WHEN TP + FP = 0 THEN 0 ELSE TP / (TP + FP) END AS precision,
     CASE WHEN TP + FN = 0 THEN 0 ELSE TP / (TP + FN) END AS recall,
     CASE WHEN 2 * TP + FP + FN = 0 THEN 0 ELSE 2 * TP / (2 * TP + FP + FN) END AS f1,
     CASE WHEN 5 * TP + 4 * FN + FP = 0 THEN 0 ELSE 5 * TP / (5 * TP + 4 * FN + FP) END AS f2,
     CASE WHEN (TP + FP) * (TP + FN) * (TN + FP) * (TN + FN) = 0 THEN 0
          ELSE (CAST(TP AS DOUBLE) * TN - CAST(FP AS DOUBLE) * FN)
               / sqrt(CAST(TP + FP AS DOUBLE) * (TP + FN) * (TN + FP) * (TN + FN)) END AS mcc
     FROM cells)"""

_CUM_SQL = f"""{MODELS_SQL},
  g AS (SELECT model, score, CAST(sum(y) AS BIGINT) AS tp, CAST(sum(1 - y) AS BIGINT) AS fp FROM m GROUP BY ALL),
  c AS (SELECT *, CAST(sum(tp) OVER w AS BIGINT) AS ctp, CAST(sum(fp) OVER w AS BIGINT) AS cfp,
               CAST(sum(tp) OVER (PARTITION BY model) AS BIGINT) AS P, CAST(sum(fp) OVER (PARTITION BY model) AS BIGINT) AS N
        FROM g WINDOW w AS (PARTITION BY model ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  aa AS (SELECT model, CASE WHEN any_value(P) > 0 AND any_value(N) > 0
                       THEN sum(CAST(fp AS DOUBLE) / N * (ctp - tp / 2.0) / P) END AS auc_roc,
                CASE WHEN any_value(P) > 0 THEN sum(CAST(tp AS DOUBLE) / P * ctp / (ctp + cfp)) END AS auc_pr
         FROM c GROUP BY model)"""


@query("confusion", f"""{_CELLS_SQL} SELECT model, TP, FP, TN, FN FROM met WHERE threshold = 0.5""")
def q_confusion(spark, sf):
    s = scored(spark, sf).withColumn("pred", (F.col("score") >= 0.5).cast("int"))
    return M.confusion(s, "y", "pred", ["model"])


@query("prf_metrics", f"""{_CELLS_SQL} SELECT model, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision,
  round(recall, 6) AS recall, round(f1, 6) AS f1, round(f2, 6) AS f2 FROM met WHERE threshold = 0.5""")
def q_prf_metrics(spark, sf):
    s = scored(spark, sf).withColumn("pred", (F.col("score") >= 0.5).cast("int"))
    return rounded(M.cells_to_metrics(M.confusion(s, "y", "pred", ["model"]))
                   .select("model", "accuracy", "precision", "recall", "f1", "f2"))


@query("mcc", f"""{_CELLS_SQL} SELECT model, round(CAST(threshold AS DOUBLE), 6) AS threshold, round(mcc, 6) AS mcc FROM met""")
def q_mcc(spark, sf):
    cells = M.threshold_confusion(scored(spark, sf), "y", "score", THRESHOLDS, ["model"])
    return rounded(M.cells_to_metrics(cells).select("model", "threshold", "mcc"))


_ROW_COLS = "accuracy precision recall f1 f2 mcc auc_roc auc_pr".split()


def _metrics_sql(where="", extra=""):
    rounded_cols = ", ".join(f"round({c}, 6) AS {c}" for c in _ROW_COLS)
    aa = _CUM_SQL.split(MODELS_SQL + ",", 1)[1]
    return f"""{_CELLS_SQL}, {aa}
SELECT met.model, round(CAST(threshold AS DOUBLE), 6) AS threshold, {rounded_cols.replace('round(auc', 'round(aa.auc')}, TP, FP, TN, FN {extra}
FROM met LEFT JOIN aa ON met.model = aa.model {where}"""


@query("metrics_row", _metrics_sql())
def q_metrics_row(spark, sf):
    """Every metric for every (model, threshold) in one plan."""
    return rounded(M.metrics_table(scored(spark, sf), "y", "score", THRESHOLDS, ["model"]))


@query("model_comparison", f"""SELECT *, CAST(row_number() OVER (ORDER BY f1 DESC, model) AS INTEGER) AS rank
FROM ({_metrics_sql('WHERE threshold = 0.5')})""")
def q_model_comparison(spark, sf):
    """Report at threshold 0.5 ranked by F1 (window over one row per model)."""
    t = M.metrics_table(scored(spark, sf), "y", "score", [0.5], ["model"])
    w = Window.orderBy(F.col("f1").desc(), F.col("model"))
    return rounded(t.withColumn("rank", F.row_number().over(w).cast("int")))


@query("cum_confusion", f"""{_CUM_SQL} SELECT model, round(score, 6) AS score, tp, fp, ctp, cfp, P, N FROM c""")
def q_cum_confusion(spark, sf):
    return rounded(M.cum_confusion(scored(spark, sf), "y", "score", ["model"]))


@query("roc_curve", f"""{_CUM_SQL}
SELECT model, round(score, 6) AS threshold, round(CASE WHEN N = 0 THEN 0 ELSE CAST(cfp AS DOUBLE) / N END, 6) AS fpr,
       round(CASE WHEN P = 0 THEN 0 ELSE CAST(ctp AS DOUBLE) / P END, 6) AS tpr FROM c
UNION ALL SELECT DISTINCT model, NULL, 0.0, 0.0 FROM c""")
def q_roc_curve(spark, sf):
    return rounded(M.roc_curve(M.cum_confusion(scored(spark, sf), "y", "score", ["model"]), ["model"]))


@query("pr_curve", f"""{_CUM_SQL}
SELECT model, round(score, 6) AS threshold, round(CASE WHEN ctp + cfp = 0 THEN 0 ELSE CAST(ctp AS DOUBLE) / (ctp + cfp) END, 6) AS precision,
       round(CASE WHEN P = 0 THEN 0 ELSE CAST(ctp AS DOUBLE) / P END, 6) AS recall FROM c WHERE ctp - tp < P
UNION ALL SELECT DISTINCT model, NULL, 1.0, 0.0 FROM c""")
def q_pr_curve(spark, sf):
    return rounded(M.pr_curve(M.cum_confusion(scored(spark, sf), "y", "score", ["model"]), ["model"]))


@query("roc_auc", f"{_CUM_SQL} SELECT model, round(auc_roc, 6) AS auc_roc FROM aa")
def q_roc_auc(spark, sf):
    return rounded(M.auc_ap(M.cum_confusion(scored(spark, sf), "y", "score", ["model"]), ["model"])
                   .select("model", "auc_roc"))


@query("average_precision", f"{_CUM_SQL} SELECT model, round(auc_pr, 6) AS auc_pr FROM aa")
def q_average_precision(spark, sf):
    return rounded(M.auc_ap(M.cum_confusion(scored(spark, sf), "y", "score", ["model"]), ["model"])
                   .select("model", "auc_pr"))


@query("score_threshold", """SELECT o_orderkey, round(p, 6) AS p, CAST(p >= 0.6 AS INTEGER) AS pred
FROM (SELECT o_orderkey, 1 / (1 + exp(-((o_totalprice - 250000) / 100000))) AS p FROM orders)""")
def q_score_threshold(spark, sf):
    """Scores through a sigmoid (SVM-like margins), label = p >= threshold."""
    from ...plans.training import score_threshold
    o = table(spark, sf, "orders").select("o_orderkey", ((F.col("o_totalprice") - 250000) / 100000).alias("margin"))
    return rounded(score_threshold(o, "margin", 0.6, margin=True).select("o_orderkey", "p", "pred"))
