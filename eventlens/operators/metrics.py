"""Binary-classification metrics as aggregates over (y, score) tables.

Positive class is 1. Every metric is computed for all groups (models,
runs, thresholds) in one pass:

* confusion cells with ``count_if`` (a missing class gives 0 cells);
* precision / recall / F1 / F2 / accuracy / MCC from the cells, 0 when
  undefined;
* curves from cumulative counts over *distinct* scores in descending
  order - first a per-(group, score) aggregate (map-side combined, so a
  score value shared by a third of the rows is one row), then the
  skew-safe :func:`running_totals` (no single-task window);
* ROC-AUC by the tie-aware trapezoid, average precision as
  sum(delta recall * precision) - the scikit-learn definitions (MLlib's
  ``areaUnderPR`` interpolates and gives a different number).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import running_totals


def _safe(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num.cast("double"), F.when(den != 0, den.cast("double"))), F.lit(0.0))


def cells_to_metrics(df: DataFrame) -> DataFrame:
    """Add accuracy, precision, recall, f1, f2, mcc to a frame with TP FP TN FN."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("TP", "FP", "TN", "FN"))
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return df.withColumns({
        "accuracy": _safe(tp + tn, tp + fp + tn + fn),
        "precision": _safe(tp, tp + fp),
        "recall": _safe(tp, tp + fn),
        "f1": _safe(2 * tp, 2 * tp + fp + fn),
        "f2": _safe(5 * tp, 5 * tp + 4 * fn + fp),
        "mcc": _safe(tp * tn - fp * fn, den),
    })


def confusion(df: DataFrame, y: str, pred: str, group_cols: Sequence[str] = ()) -> DataFrame:
    yc, pc = F.col(y), F.col(pred)
    return df.groupBy(*group_cols).agg(
        F.count_if((yc == 1) & (pc == 1)).alias("TP"), F.count_if((yc == 0) & (pc == 1)).alias("FP"),
        F.count_if((yc == 0) & (pc == 0)).alias("TN"), F.count_if((yc == 1) & (pc == 0)).alias("FN"))


def threshold_confusion(df: DataFrame, y: str, score: str, thresholds: Sequence[float],
                        group_cols: Sequence[str] = ()) -> DataFrame:
    """Confusion cells for every threshold (pred = score >= t) in ONE pass:
    one set of ``count_if`` per threshold, then unpivoted to rows."""
    yc, s = F.col(y), F.col(score)
    aggs = []
    for i, t in enumerate(thresholds):
        p = s >= F.lit(float(t))
        aggs += [F.count_if((yc == 1) & p).alias(f"tp{i}"), F.count_if((yc == 0) & p).alias(f"fp{i}"),
                 F.count_if((yc == 0) & ~p).alias(f"tn{i}"), F.count_if((yc == 1) & ~p).alias(f"fn{i}")]
    wide = df.where(s.isNotNull()).groupBy(*group_cols).agg(*aggs)
    arr = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"tp{i}").alias("TP"),
                             F.col(f"fp{i}").alias("FP"), F.col(f"tn{i}").alias("TN"), F.col(f"fn{i}").alias("FN"))
                    for i, t in enumerate(thresholds)])
    return wide.select(*group_cols, F.explode(arr).alias("c")).select(*group_cols, "c.*")


def cum_confusion(df: DataFrame, y: str, score: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """Per group and distinct score (descending): tp, fp at that score and
    cumulative ctp, cfp of all scores >= it, plus group totals P, N."""
    yc = F.col(y).cast("bigint")
    g = df.where(F.col(score).isNotNull()).groupBy(*group_cols, F.col(score).alias("score")).agg(
        F.sum(yc).alias("tp"), F.sum(1 - yc).alias("fp"))
    cum = running_totals(g, [F.col("score").desc()], ["tp", "fp"], group_cols, inclusive=True,
                         count_name="_k", prefix="c")
    tot = g.groupBy(*group_cols).agg(F.sum("tp").alias("P"), F.sum("fp").alias("N"))
    out = _attach_totals(cum, tot, group_cols)
    return out.select(*group_cols, "score", "tp", "fp", F.col("ctp"), F.col("cfp"), "P", "N")


def _attach_totals(cum: DataFrame, tot: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    if group_cols:
        return cum.join(tot, list(group_cols), "inner")
    # a single totals row: read it (one small action) and attach as literals
    row = tot.first()
    types = dict(tot.dtypes)
    return cum.withColumns({c: F.lit(row[c] if row is not None else None).cast(types[c]) for c in tot.columns})


def roc_curve(cum: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score plus the (0, 0) start
    (threshold null). Intermediate collinear points are kept."""
    pts = cum.select(*group_cols, F.col("score").alias("threshold"),
                     _safe(F.col("cfp"), F.col("N")).alias("fpr"), _safe(F.col("ctp"), F.col("P")).alias("tpr"))
    start = cum.select(*group_cols).distinct().select(
        *group_cols, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return pts.unionByName(start)


def pr_curve(cum: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """(threshold, precision, recall) from the highest score down to the
    first score reaching full recall, plus the (recall 0, precision 1) end."""
    keep = (F.col("ctp") - F.col("tp")) < F.col("P")
    pts = cum.where(keep).select(*group_cols, F.col("score").alias("threshold"),
                                 _safe(F.col("ctp"), F.col("ctp") + F.col("cfp")).alias("precision"),
                                 _safe(F.col("ctp"), F.col("P")).alias("recall"))
    end = cum.select(*group_cols).distinct().select(
        *group_cols, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"))
    return pts.unionByName(end)


def auc_ap(cum: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """(auc_roc, auc_pr) per group. AUC is null when a class is missing."""
    P, N = F.col("P").cast("double"), F.col("N").cast("double")
    roc_term = F.col("fp") / N * (F.col("ctp") - F.col("tp") / 2.0) / P
    ap_term = F.col("tp") / P * F.col("ctp") / (F.col("ctp") + F.col("cfp"))
    return cum.groupBy(*group_cols).agg(
        F.when(F.first("P") * F.first("N") > 0, F.sum(F.when((P > 0) & (N > 0), roc_term))).alias("auc_roc"),
        F.when(F.first("P") > 0, F.sum(F.when(P > 0, ap_term))).alias("auc_pr"))


METRIC_COLUMNS = ["accuracy", "precision", "recall", "f1", "f2", "mcc", "auc_roc", "auc_pr", "TP", "FP", "TN", "FN"]


def metrics_table(df: DataFrame, y: str, score: str, thresholds: Sequence[float],
                  group_cols: Sequence[str] = ()) -> DataFrame:
    """One row per (group, threshold): all metrics of the reference's report
    row. Thresholds are data (one pass), not refits."""
    cells = cells_to_metrics(threshold_confusion(df, y, score, thresholds, group_cols))
    aa = auc_ap(cum_confusion(df, y, score, group_cols), group_cols)
    if group_cols:
        out = cells.join(aa, list(group_cols), "left")
    else:
        out = _attach_totals(cells, aa, [])
    return out.select(*group_cols, "threshold", *METRIC_COLUMNS)
