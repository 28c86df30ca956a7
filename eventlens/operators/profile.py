"""Column profiles: describe, value counts, histograms, distinct counts.

Moments come from one aggregate over all columns. Quartiles are exact and
distributed (``quantile_frame``); the most frequent value is a
``min(struct(-count, value))`` over per-value counts, so no column's values
are ever gathered into one task (Spark's ``mode``/``percentile`` would hold
every distinct value of a column in one aggregation buffer).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import quantile_frame


def _number(c: str):
    """As double; NaN is a missing value."""
    return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))


def _long(df: DataFrame, cols: Sequence[str], cast: str | None) -> DataFrame:
    def v(c):
        return F.col(c).cast(cast) if cast else F.col(c)
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), v(c).alias("v")) for c in cols]))
                     .alias("kv")).select("kv.column", "kv.v")


def describe_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, count, mean, std, min, p25, p50, p75, max); std is the
    sample std, quartiles interpolate linearly (pandas ``describe``). One
    lazy plan: the moments aggregate joined to the quartile frame."""
    wide = df.agg(*[e for i, c in enumerate(cols) for e in (
        F.count(_number(c)).alias(f"n{i}"), F.avg(_number(c)).alias(f"m{i}"), F.stddev_samp(_number(c)).alias(f"s{i}"),
        F.min(_number(c)).alias(f"lo{i}"), F.max(_number(c)).alias(f"hi{i}"))])
    long = wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("count"), F.col(f"m{i}").alias("mean"),
                 F.col(f"s{i}").alias("std"), F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"))
        for i, c in enumerate(cols)])).alias("s")).select("s.*")
    q = quantile_frame(df, cols, [0.25, 0.5, 0.75]).groupBy(F.col("name").alias("column")).agg(
        *[F.max(F.when(F.col("qi") == i, F.col("value"))).alias(p) for i, p in enumerate(("p25", "p50", "p75"))])
    # both sides hold one row per described column
    return long.join(q, "column", "left").select("column", "count", "mean", "std", "min", "p25", "p50", "p75",
                                                 "max")


def describe_string(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, count, unique, top, freq); ties for top -> smallest value."""
    vc = _long(df, cols, "string").where(F.col("v").isNotNull()).groupBy("column", "v").agg(
        F.count(F.lit(1)).alias("c"))
    return vc.groupBy("column").agg(
        F.sum("c").alias("count"), F.count(F.lit(1)).alias("unique"),
        F.min(F.struct((-F.col("c")).alias("negc"), F.col("v").alias("v"))).alias("top")).select(
        "column", "count", "unique", F.col("top.v").alias("top"), (-F.col("top.negc")).alias("freq"))


def distinct_counts(df: DataFrame, cols: Sequence[str], approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """(column, n_distinct). ``approx`` uses HyperLogLog++ (one pass, fixed
    memory) for very large columns; exact otherwise."""
    fn = (lambda c: F.approx_count_distinct(c, rsd)) if approx else F.count_distinct
    wide = df.agg(*[fn(F.col(c)).alias(f"d{i}") for i, c in enumerate(cols)])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"d{i}").alias("n_distinct"))
                                           for i, c in enumerate(cols)])).alias("s")).select("s.*")


def value_counts_topn(df: DataFrame, col: str, top_n: int = 15, cardinality_threshold: int = 20) -> DataFrame:
    """Counts per value; with more than ``cardinality_threshold`` values only
    the ``top_n`` most frequent (ties by value). Null values are skipped."""
    vc = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    n_values = vc.count()
    if n_values > cardinality_threshold:
        vc = vc.orderBy(F.col("count").desc(), F.col(col)).limit(top_n)  # a top-k report: distributed TakeOrdered
    return vc


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Equal-width histogram over [min, max], last bin closed, plus a row
    with a null bucket counting null and NaN values. Columns: bucket, lo, hi, n."""
    x = _number(col)
    mm = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    lo, hi = mm["lo"], mm["hi"]
    if lo is None:
        b = F.lit(None).cast("int")
        width = 0.0
    elif hi == lo:
        b = F.when(x.isNotNull(), F.lit(1))
        width = 0.0
    else:
        width = (hi - lo) / bins
        b = F.when(x.isNotNull(), F.least(F.floor((x - F.lit(lo)) / F.lit(width)) + 1, F.lit(bins)).cast("int"))
    counted = df.select(b.alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    lo_l = F.lit(lo if lo is not None else None).cast("double")
    return counted.select(
        "bucket",
        F.when(F.col("bucket").isNotNull(), lo_l + (F.col("bucket") - 1) * F.lit(width)).alias("lo"),
        F.when(F.col("bucket").isNotNull(), lo_l + F.col("bucket") * F.lit(width)).alias("hi"), "n")
