"""Pearson correlations (pairwise complete), greedy correlation pruning and
variance-inflation pruning.

Correlations are pairwise complete (a pair uses the rows where both values
are present). Moment matrices are added up per partition with numpy (one
matrix product per Arrow batch) and summed per pair by Spark: one pass, one
row per pair out of each partition, and a plan whose size does not grow with
the columns. A constant column gives NULL, never a division error. The
pruning steps are k x k and run on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Eigenvalues of a correlation matrix below this count as zero.
TOLERANCE = 1e-10


def _pair_r(df: DataFrame, cols: Sequence[str], only_with: int | None = None) -> DataFrame:
    return _r_from_moments(pair_moments(df, cols, only_with))


def pair_moments(df: DataFrame, cols: Sequence[str], only_with: int | None = None) -> DataFrame:
    """Pairwise-complete moments for every ordered pair (a, b), or those with
    the column ``only_with``, in one pass.

    Each Arrow batch adds to k x k matrices (rows where both a and b are
    present): n, sum a, sum a^2, sum a*b - on values shifted by a first-pass
    mean for numerical stability. A partition gives one row per pair, summed
    per pair by a grouped aggregate; nothing is gathered in one task.
    Output: (a, b, n, s_a, s_aa, s_ab) with a, b column indexes.
    """
    k = len(cols)
    means = df.agg(*[F.avg(F.nanvl(F.col(c).cast("double"), F.lit(None))).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    shift = np.array([means[f"m{i}"] if means[f"m{i}"] is not None else 0.0 for i in range(k)])
    src = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    ia, ib = np.meshgrid(np.arange(k), np.arange(k), indexing="ij")
    wanted = (ia == only_with) | (ib == only_with) if only_with is not None else np.ones((k, k), bool)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((4, k, k))
        t = slice(None) if only_with is None else slice(only_with, only_with + 1)
        for b in batches:
            X = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]) - shift
            M = ~np.isnan(X)
            if only_with is None and M.all():  # every pair has the same rows
                for i, v in enumerate((np.full(k, float(len(X))), X.sum(axis=0), (X * X).sum(axis=0))):
                    sums[i] += v[:, None]
                sums[3] += X.T @ X
                continue
            X0, Mf = np.where(M, X, 0.0), M.astype(float)
            sums[:, :, t] += np.stack([Mf.T @ Mf[:, t], X0.T @ Mf[:, t], (X0 * X0).T @ Mf[:, t], X0.T @ X0[:, t]])
            if only_with is not None:
                row = np.stack([Mf[:, t].T @ Mf, X0[:, t].T @ Mf, (X0[:, t] ** 2).T @ Mf, X0[:, t].T @ X0])
                row[:, 0, only_with] = 0.0  # in the column already
                sums[:, t, :] += row
        yield pa.record_batch({"a": pa.array(ia[wanted], pa.int32()), "b": pa.array(ib[wanted], pa.int32()),
                               **{n: pa.array(s[wanted]) for n, s in zip(("n", "s_a", "s_aa", "s_ab"), sums)}})

    part = src.mapInArrow(moments, "a int, b int, n double, s_a double, s_aa double, s_ab double")
    return part.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "s_a", "s_aa", "s_ab")])


def _r_from_moments(m: DataFrame) -> DataFrame:
    """r for pairs a < b from ``pair_moments`` (NULL when undefined).

    The (a, b) row holds sums of a, the (b, a) row sums of b, both over the
    rows where a and b are present; one aggregate over the k^2 rows pairs them."""
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    fwd = F.col("a") < F.col("b")
    g = m.where(F.col("a") != F.col("b")).groupBy(lo.alias("a"), hi.alias("b")).agg(
        F.max(F.when(fwd, F.col("n"))).alias("n"), F.max(F.when(fwd, F.col("s_ab"))).alias("s_ab"),
        F.max(F.when(fwd, F.col("s_a"))).alias("s_a"), F.max(F.when(fwd, F.col("s_aa"))).alias("s_aa"),
        F.max(F.when(~fwd, F.col("s_a"))).alias("s_b"), F.max(F.when(~fwd, F.col("s_aa"))).alias("s_bb"))
    n = F.col("n")
    cov = n * F.col("s_ab") - F.col("s_a") * F.col("s_b")
    va = n * F.col("s_aa") - F.col("s_a") * F.col("s_a")
    vb = n * F.col("s_bb") - F.col("s_b") * F.col("s_b")
    den = F.sqrt(va * vb)
    r = F.when((n > 1) & (va > 0) & (vb > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cov / den)))
    return g.select("a", "b", r.alias("r"))


def _names(df: DataFrame, cols: Sequence[str], ca: str, cb: str) -> DataFrame:
    name = F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("a") + 1)
    other = F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("b") + 1)
    return df.select(name.alias(ca), other.alias(cb), "r")


def pair_correlations(df: DataFrame, cols: Sequence[str]) -> dict[tuple[str, str], float | None]:
    """r for every pair i < j (None when undefined); k^2 numbers reach the driver."""
    out: dict[tuple[str, str], float | None] = {}
    for row in _pair_r(df, cols).collect():
        v = row["r"]
        out[(cols[row["a"]], cols[row["b"]])] = None if v is None or np.isnan(v) else float(v)
    return out


def corr_long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(col_a, col_b, r) for i < j as a DataFrame."""
    return _names(_pair_r(df, cols), cols, "col_a", "col_b")


def target_corr(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """(feature, r, abs_r): correlation of each feature with the target."""
    allc = list(cols) + [target]
    r = _pair_r(df, allc, only_with=len(cols))
    return _names(r, allc, "feature", "_t").select("feature", "r", F.abs("r").alias("abs_r"))


def matrix(cols: Sequence[str], pairs: dict) -> np.ndarray:
    k = len(cols)
    m = np.full((k, k), np.nan)
    for i in range(k):
        for j in range(i + 1, k):
            v = pairs.get((cols[i], cols[j]))
            if v is not None:
                m[i, j] = m[j, i] = v
    for i in range(k):
        # self-correlation is 1 unless the column is constant (all of its r undefined)
        if k == 1 or not np.all(np.isnan(np.delete(m[i], i))):
            m[i, i] = 1.0
    return m


def centrality(cols: Sequence[str], pairs: dict) -> dict[str, float | None]:
    """Mean absolute correlation of each column, self term included."""
    m = np.abs(matrix(cols, pairs))
    out = {}
    for i, c in enumerate(cols):
        row = m[i][~np.isnan(m[i])]
        out[c] = float(row.mean()) if row.size else None
    return out


def greedy_prune(cols: Sequence[str], pairs: dict, threshold: float = 0.85, strict: bool = False) -> list[str]:
    """Columns to drop, in drop order.

    For i < j in column order with |r| > threshold: drop ``b`` when
    centrality[a] >= centrality[b] else ``a``. As in the analysed workload,
    once ``a`` is dropped the inner loop still compares against it (so a
    dropped column can drop others); ``strict=True`` skips dropped ones.
    """
    k = len(cols)
    r = matrix(cols, pairs)
    with np.errstate(invalid="ignore"):
        over = np.triu(np.abs(r) > threshold, 1)  # undefined pairs compare false
    score = np.array([np.nan if c is None else c for c in centrality(cols, pairs).values()]) if k else np.zeros(0)
    wins = score[:, None] >= score[None, :]
    alive, order = np.ones(k, bool), []
    for i in range(k):
        rivals = np.flatnonzero(over[i] & alive) if alive[i] else np.zeros(0, int)
        beaten = rivals[~wins[i, rivals]][:1]  # the first rival that drops this column
        if strict and len(beaten):
            rivals = rivals[rivals <= beaten[0]]
        lost = [(int(b), int(b)) for b in rivals[wins[i, rivals]]] + [(int(b), i) for b in beaten]
        order += [c for _, c in sorted(lost)]
        alive[[c for _, c in lost]] = False
    return [cols[c] for c in order]


def corr_prune(df: DataFrame, cols: Sequence[str], threshold: float = 0.85, forced: Sequence[str] = (),
               exempt_suffix: str = "_missing", target: str | None = None,
               strict: bool = False) -> tuple[DataFrame, list[str]]:
    """Drop forced columns, then greedily one of each highly correlated
    pair among numeric columns (flags ending ``exempt_suffix`` and the
    target are never checked). Returns (frame, dropped list)."""
    forced_present = [c for c in forced if c in df.columns]
    check = [c for c in cols if c not in forced_present and c != target and not c.endswith(exempt_suffix)]
    pairs = pair_correlations(df, check)
    auto = greedy_prune(check, pairs, threshold, strict)
    dropped = forced_present + auto
    return df.drop(*dropped), dropped


def vif_prune(df: DataFrame, cols: Sequence[str], threshold: float = 10.0) -> list[str]:
    """Drop the column with the largest VIF while one is above ``threshold``.

    VIF_i = [R^-1]_ii of the correlation matrix, which is computed once in
    Spark. Columns inside an exact linear dependence (eigenvalue below
    ``TOLERANCE``) have no finite VIF and go first, the one with the largest
    part in the dependences at a time. The rest is inverted once; leaving a
    column out is a rank-one downdate of the inverse. Exact when the columns
    have no nulls.
    """
    m = matrix(list(cols), pair_correlations(df, list(cols))) if len(cols) > 1 else np.eye(len(cols))
    left = np.array([i for i in range(len(cols)) if not np.isnan(m[i, i])], int)
    r = np.nan_to_num(m[np.ix_(left, left)], nan=0.0)
    values, vectors = np.linalg.eigh(r)
    while len(left) > 1 and values[0] < TOLERANCE:
        out = int(np.argmax((vectors[:, values < TOLERANCE] ** 2).sum(axis=1)))
        left, r = np.delete(left, out), np.delete(np.delete(r, out, 0), out, 1)
        values, vectors = np.linalg.eigh(r)
    inverse = (vectors / values) @ vectors.T
    while len(left) > 1 and inverse.diagonal().max() > threshold:
        out = int(np.argmax(inverse.diagonal()))
        rest = inverse - np.outer(inverse[:, out], inverse[out]) / inverse[out, out]
        left, inverse = np.delete(left, out), np.delete(np.delete(rest, out, 0), out, 1)
    return [cols[i] for i in left]
