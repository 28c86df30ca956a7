"""Splitting and resampling."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def temporal_split(df: DataFrame, year_col: str, cut: int = 2010) -> tuple[DataFrame, DataFrame]:
    """(train, test) = (year < cut, year >= cut). Rows with a null year go to
    neither side. Both sides are filters on the same plan, so a persisted
    input is scanned once per side at most and the filter reaches the scan."""
    y = F.col(year_col)
    return df.where(y < cut), df.where(y >= cut)


def uniform_rank(df: DataFrame, id_col: str, seed: int, uniform=None, name: str = "_rank") -> DataFrame:
    """0-based rank of a seeded per-row uniform (ties by id) - a random
    order that is the same on every run and every engine ."""
    from ..functions.rng import uniform as seeded_uniform
    from .prefix import global_rank
    uniform = uniform or seeded_uniform
    return global_rank(df.withColumn("_u", uniform(F.col(id_col), seed)), [F.col("_u"), F.col(id_col)],
                       name).drop("_u")


def undersample(df: DataFrame, y: str, id_col: str, seed: int = 42, ratio: float = 1.0, uniform=None) -> DataFrame:
    """Random under-sampling of the majority class to ``ratio`` x minority
    (exact count): all minority rows plus the majority rows with the
    smallest seeded uniform."""
    counts = {r[y]: r["n"] for r in df.groupBy(y).agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return df
    minority = min(counts, key=lambda c: (counts[c], c))
    keep = int(math.floor(ratio * counts[minority]))
    maj = uniform_rank(df.where(F.col(y) != minority), id_col, seed, uniform)
    return df.where(F.col(y) == minority).unionByName(maj.where(F.col("_rank") < keep).drop("_rank"))


def permute_column(df: DataFrame, col: str, id_col: str, seed: int = 42, name: str | None = None,
                   uniform=None) -> DataFrame:
    """Shuffle one column across rows: the row of rank i (by id) takes the
    value of the row whose id-rank equals i's rank under a seeded uniform.
    A bijection, computed with two distributed ranks and one equi-join."""
    from .prefix import global_rank
    name = name or col
    by_id = global_rank(df, [F.col(id_col)], "_ri")
    shuffled = uniform_rank(df.select(id_col), id_col, seed, uniform, "_h")
    donors = by_id.select(F.col("_ri").alias("_dr"), F.col(col).alias("_dv"))
    out = by_id.drop(col).join(shuffled, id_col).join(donors, F.col("_h") == F.col("_dr"))
    return out.drop("_ri", "_h", "_dr").withColumnRenamed("_dv", name)


def smote(minority: DataFrame, id_col: str, vec_col: str, n_new: int, k: int = 5, seed: int = 42,
          knn: DataFrame | None = None, uniform=None) -> DataFrame:
    """SMOTE (Chawla et al. 2002): ``n_new`` synthetic rows, each on the
    segment between a minority row and one of its ``k`` nearest minority
    neighbours: x + gap * (x_nn - x).

    Sample s picks base index floor(u1 * n_min) (rows ranked by id),
    neighbour rank floor(u2 * k) + 1 and gap u3, with seeded per-sample
    uniforms that any SQL engine can repeat.
    Returns (sample_id, base_id, nn_id, gap, <vec_col>).
    """
    from ..functions.rng import uniform as seeded_uniform
    from .knn import knn_join
    from .prefix import global_rank
    uniform = uniform or seeded_uniform
    spark = minority.sparkSession
    n_min = minority.count()  # one count sizes both kNN sides
    if n_new <= 0 or n_min < 2:
        return spark.createDataFrame([], f"sample_id long, base_id long, nn_id long, gap double, {vec_col} array<double>")
    ranked = global_rank(minority.select(id_col, vec_col), [F.col(id_col)], "_i")
    nn = knn if knn is not None else knn_join(minority, minority, id_col, vec_col, k, sizes=(n_min, n_min))
    kk = min(k, n_min - 1)
    s = spark.range(n_new).withColumnRenamed("id", "sample_id")
    s = s.select("sample_id",
                 F.floor(uniform(F.col("sample_id"), seed) * F.lit(n_min)).cast("long").alias("_i"),
                 (F.floor(uniform(F.col("sample_id"), seed + 1) * F.lit(kk)) + 1).cast("int").alias("rank"),
                 uniform(F.col("sample_id"), seed + 2).alias("gap"))
    base = ranked.select("_i", F.col(id_col).alias("base_id"), F.col(vec_col).cast("array<double>").alias("_x"))
    s = s.join(base, "_i").join(nn.select(F.col(id_col).alias("base_id"), "rank", "nn_id"), ["base_id", "rank"])
    s = s.join(minority.select(F.col(id_col).alias("nn_id"), F.col(vec_col).cast("array<double>").alias("_z")),
               "nn_id")
    new = F.zip_with("_x", "_z", lambda a, b: a + F.col("gap") * (b - a))
    return s.select("sample_id", "base_id", "nn_id", "gap", new.alias(vec_col))


def smote_count(n_min: int, n_maj: int, ratio: float) -> int:
    """Rows to synthesise so that minority / majority reaches ``ratio``."""
    return max(0, int(math.floor(ratio * n_maj)) - n_min)
