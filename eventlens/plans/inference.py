"""Statistical inference on a logistic model: Wald table, backward
elimination, odds ratios, and the end-to-end analysis.

The fit is Newton's method (IRLS) with one job an iteration: every task adds up
X'WX, X'(y - p) and the log-likelihood of its rows, one matrix product per Arrow
batch, and Spark sums them entry by entry; (k + 1)(k + 2) / 2 + k + 3 numbers
reach the driver. The covariance is the inverse of the last X'WX. A singular
design has no unique coefficients: there the pseudo-inverse gives the shortest
steps and, as the reference table does, the standard errors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corr import vif_prune
from ..operators.prepare import fit_prepare
from ..operators.schema_ops import classes_dict, classify_columns, drop_rare_binary
#: Smallest share of the largest eigenvalue that counts (of X'WX scaled to a unit diagonal; of X'WX itself in the pseudo-inverse).
RANK_TOLERANCE, PINV_TOLERANCE = 1e-10, 1e-12
MAX_ITERATIONS, MAX_HALVINGS = 50, 20


def _normal_two_sided_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


@dataclass
class Moments:
    """Of a logit at one point: ``gram`` X'WX, ``slope`` X'(y - p), both with
    the constant first, and the log-likelihood."""

    gram: np.ndarray
    slope: np.ndarray
    loglik: float
    n: int


def logit_moments(df: DataFrame, features: Sequence[str], y: str, beta: np.ndarray) -> Moments:
    """One pass over ``df``. A row with a missing value or label is an error."""
    k = len(features) + 1
    upper = np.triu_indices(k)
    size = len(upper[0])
    src = df.select(*[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate([y, *features])])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size + k + 3)  # X'WX, X'(y - p), log-likelihood, rows, incomplete rows
        for b in batches:
            m = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns])
            label = m[:, 0].copy()
            m[:, 0] = 1.0
            bad = np.isnan(label) | np.isnan(m).any(axis=1)
            m, label = m[~bad], label[~bad]
            z = m @ beta
            p = np.exp(-np.logaddexp(0.0, -z))
            w = p * np.exp(-np.logaddexp(0.0, z))  # p (1 - p), not rounded to 0 early
            sums[:size] += (m.T @ (m * w[:, None]))[upper]
            sums[size : size + k] += m.T @ (label - p)
            sums[size + k :] += (label * z - np.logaddexp(0.0, z)).sum(), len(m), bad.sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array(sums)], names=["i", "v"])

    cells = src.mapInArrow(add_up, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()  # size + k + 3 rows
    sums = np.zeros(size + k + 3)
    for r in cells:
        sums[r["i"]] = r["v"]
    if sums[-1]:
        raise ValueError(f"{int(sums[-1])} rows have a missing value or label")
    gram = np.zeros((k, k))
    gram[upper] = sums[:size]
    return Moments(gram + np.triu(gram, 1).T, sums[size : size + k], float(sums[-3]), int(sums[-2]))


def covariance(gram: np.ndarray) -> np.ndarray:
    """The inverse, or the pseudo-inverse of a singular matrix; the rank is
    judged on a unit diagonal, so that units of columns do not matter."""
    d = np.sqrt(np.diag(gram))
    d = np.where(d > 0, d, 1.0)
    scaled = gram / np.outer(d, d)
    values = np.linalg.eigvalsh(scaled)
    if values[0] > RANK_TOLERANCE * values[-1]:
        return np.linalg.inv(scaled) / np.outer(d, d)
    return np.linalg.pinv(gram, rcond=PINV_TOLERANCE, hermitian=True)


def fit_wald(df: DataFrame, features: Sequence[str], y: str, start: Sequence[float] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, covariance), the constant first. A step that lowers the
    likelihood is halved. Without rows both are zero. Where a feature separates
    the classes the coefficients have no limit and those after
    ``MAX_ITERATIONS`` are returned, with their large standard errors."""
    beta = np.zeros(len(features) + 1) if start is None else np.asarray(start, float)
    at = logit_moments(df, features, y, beta)
    for _ in range(MAX_ITERATIONS):
        cov = covariance(at.gram)
        step = cov @ at.slope
        if at.slope @ step <= 1e-20 * (1.0 + abs(at.loglik)):
            break
        for _ in range(MAX_HALVINGS):
            new = logit_moments(df, features, y, beta + step)
            if new.loglik >= at.loglik - 1e-12 * (1.0 + abs(at.loglik)):
                break
            step = step / 2
        else:
            break
        beta, last, at = beta + step, at.loglik, new
        if abs(at.loglik - last) <= 1e-15 * (1.0 + abs(last)):  # rounding is all that is left
            break
    return beta, covariance(at.gram)


def wald_table(df: DataFrame, features: Sequence[str], y: str, start: Sequence[float] | None = None) -> list[dict]:
    """Rows (feature, coef, std_err, z, p_value), intercept first as 'const'."""
    coefs, cov = fit_wald(df, features, y, start)
    rows = []
    for name, c, s_ in zip(["const", *features], coefs.tolist(), np.sqrt(np.maximum(np.diag(cov), 0.0)).tolist()):
        z = c / s_ if s_ and s_ > 0 else float("nan")
        rows.append({"feature": name, "coef": c, "std_err": s_, "z": z,
                     "p_value": _normal_two_sided_p(z) if not math.isnan(z) else float("nan")})
    return rows


def backward_select(df: DataFrame, features: Sequence[str], y: str, p_threshold: float = 0.05) -> tuple[list, list]:
    """Drop the least significant feature while its p-value >= threshold.
    Returns (kept features, final Wald rows). The frame is cached for the loop,
    and a fit starts at the coefficients of the one before."""
    feats, start = list(features), None
    cached = df.select(*feats, y).cache()
    try:
        while True:
            rows = wald_table(cached, feats, y, start)
            cand = [r for r in rows if r["feature"] != "const"]
            worst = max(cand, key=lambda r: (r["p_value"] if not math.isnan(r["p_value"]) else 2.0), default=None)
            if worst is None or (not math.isnan(worst["p_value"]) and worst["p_value"] < p_threshold) or len(feats) == 1:
                return feats, rows
            feats.remove(worst["feature"])
            start = [r["coef"] for r in rows if r is not worst]
    finally:
        cached.unpersist()


def odds_ratios(spark: SparkSession, rows: Sequence[dict]) -> DataFrame:
    """exp(coef) with 95 % CI, intercept first, then by |coef| descending."""
    df = spark.createDataFrame([(r["feature"], float(r["coef"]), float(r["std_err"]), float(r["z"]),
                                 float(r["p_value"])) for r in rows],
                               "feature string, coef double, std_err double, z double, p_value double")
    return odds_ratio_table(df)


def odds_ratio_table(table: DataFrame) -> DataFrame:
    out = table.withColumns({
        "odds_ratio": F.exp("coef"),
        "or_ci_lower": F.exp(F.col("coef") - F.lit(1.96) * F.col("std_err")),
        "or_ci_upper": F.exp(F.col("coef") + F.lit(1.96) * F.col("std_err")),
    })
    return out.orderBy((F.col("feature") != "const").cast("int"), F.abs("coef").desc(), "feature")


def logit_analysis(df: DataFrame, features: Sequence[str], y: str, year_col: str, cut_year: int = 2010,
                   p_threshold: float = 0.05, vif_threshold: float = 10.0, min_binary_count: int = 10,
                   cyclical: dict | None = None) -> DataFrame:
    """Split -> classify (train) -> prepare -> drop rare binaries -> VIF ->
    backward elimination -> odds ratios (on the unresampled train side)."""
    from ..operators.schema_ops import CYCLICAL_PERIODS
    cyclical = CYCLICAL_PERIODS if cyclical is None else cyclical
    train = df.where(F.col(year_col) < cut_year)
    classes = classes_dict(classify_columns(train, features, cyclical))
    prep = fit_prepare(train, classes["continuous"], classes["binary"],
                       {c: cyclical[c] for c in classes["cyclical"]}, classes["sentinel"])
    x = prep.apply(train, keep=[y])
    kept = [c for c in drop_rare_binary(x, classes["binary"], min_binary_count) if c != y]
    kept = vif_prune(x, kept, vif_threshold)
    final, rows = backward_select(x, kept, y, p_threshold)
    return odds_ratios(df.sparkSession, rows)
