"""Grouped outcome summaries (rates by year, by bins, by flags...).

All are ``groupBy().agg()`` with decomposable aggregates (count/sum), so a
hot group costs one partial aggregate per task, never one big task. Null
group keys are dropped first, matching pandas ``groupby``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _y(target: str) -> Column:
    return F.col(target).cast("bigint")


def child_rollup(child: DataFrame, key: str, sums: Mapping[str, str], count_col: str,
                 count_name: str) -> DataFrame:
    """Aggregate the many side of a one-to-many relation per key.

    ``sums`` maps output name -> input column; a group whose values are all
    null sums to 0 (pandas semantics; Spark's ``sum`` would give NULL).
    ``count_name`` counts non-null ``count_col`` values. Null keys are dropped.
    """
    aggs = [F.coalesce(F.sum(src), F.lit(0)).alias(name) for name, src in sums.items()]
    aggs.append(F.count(count_col).alias(count_name))
    return child.where(F.col(key).isNotNull()).groupBy(key).agg(*aggs)


def outcome_by(df: DataFrame, keys: Sequence[str | Column], target: str,
               min_count: int = 0) -> DataFrame:
    """successes, total, failures, rate per group (null keys dropped)."""
    kcols = [F.col(k) if isinstance(k, str) else k for k in keys]
    g = df
    for k in kcols:
        g = g.where(k.isNotNull())
    out = g.groupBy(*kcols).agg(
        F.sum(_y(target)).alias("successes"),
        F.count(F.lit(1)).alias("total"),
    ).withColumns({
        "failures": F.col("total") - F.col("successes"),
        "success_rate": F.col("successes") / F.col("total"),
    })
    if min_count:
        out = out.where(F.col("total") >= min_count)
    return out


def right_closed_bin(c: str | Column, edges: Sequence[float], labels: Sequence[str] | None = None) -> Column:
    """``pd.cut`` bins (a, b]: index (or label) of the bin, null outside.

    Edges must increase; values <= edges[0] or > edges[-1] fall outside.
    """
    col = F.col(c) if isinstance(c, str) else c
    if labels is None:
        labels = [f"({edges[i]}, {edges[i + 1]}]" for i in range(len(edges) - 1)]
    expr = None
    for i in range(len(edges) - 1):
        cond = (col > F.lit(edges[i])) & (col <= F.lit(edges[i + 1]))
        expr = F.when(cond, F.lit(labels[i])) if expr is None else expr.when(cond, F.lit(labels[i]))
    return expr


def rate_by_bins(df: DataFrame, value: str, edges: Sequence[float], labels: Sequence[str],
                 target: str, bin_name: str = "bin") -> DataFrame:
    """Mean outcome and count per right-closed bin; empty bins are absent
    (``observed=True``), out-of-range rows are dropped. ``bin_order`` keeps
    the label order sortable."""
    b = right_closed_bin(value, edges, labels)
    o = right_closed_bin(value, edges, [str(i) for i in range(len(labels))]).cast("int")
    staged = df.select(b.alias(bin_name), o.alias("bin_order"), F.col(target))
    return (staged.where(F.col(bin_name).isNotNull()).groupBy(bin_name, "bin_order")
            .agg(F.avg(_y(target)).alias("success_rate"), F.count(F.lit(1)).alias("n")))


def rate_by_flags(df: DataFrame, flags: Mapping[str, str], target: str) -> DataFrame:
    """For each flag column and value 1/0: rate and count.

    Wide -> long with ``unpivot`` then one aggregate; a (flag, value) cell
    with no rows is kept with count 0 and a null rate.
    """
    long = df.select(F.col(target), *[F.col(c).cast("int").alias(c) for c in flags.values()]).unpivot(
        [target], list(flags.values()), "column", "value")
    agg = long.where(F.col("value").isin(0, 1)).groupBy("column", "value").agg(
        F.avg(_y(target)).alias("success_rate"), F.count(F.lit(1)).alias("n"))
    spark = df.sparkSession
    cells = spark.createDataFrame(
        [(label, col, v) for label, col in flags.items() for v in (1, 0)],
        "feature string, column string, value int")
    return (cells.join(F.broadcast(agg), ["column", "value"], "left")  # both sides bounded by 2 x len(flags)
            .select("feature", F.when(F.col("value") == 1, "Yes").otherwise("No").alias("value"),
                    "success_rate", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def rate_by_onehot(df: DataFrame, onehot_cols: Sequence[str], target: str, prefix: str = "",
                   suffix: str = "", min_count: int = 10) -> DataFrame:
    """Recover the category from one-hot columns and summarise each one
    with at least ``min_count`` rows: total, rate, failures."""
    long = df.select(F.col(target), *onehot_cols).unpivot([target], list(onehot_cols), "column", "v")
    cat = F.col("column")
    if prefix:
        cat = F.regexp_replace(cat, "^" + _re_escape(prefix), "")
    if suffix:
        cat = F.regexp_replace(cat, _re_escape(suffix) + "$", "")
    return (long.where(F.col("v") == 1).groupBy(cat.alias("category"))
            .agg(F.count(F.lit(1)).alias("total"), F.avg(_y(target)).alias("success_rate"),
                 F.sum(1 - _y(target)).alias("failures"))
            .where(F.col("total") >= min_count))


def _re_escape(s: str) -> str:
    import re
    return re.escape(s)


def rolling_centered_mean(df: DataFrame, order: str, value: str, width: int = 5,
                          name: str = "rolling") -> DataFrame:
    """Centred rolling mean over ``width`` rows (in ``order``, which should be
    a total order), null unless all ``width`` values are present.

    Rows are ranked with the blocked prefix sum, each row is sent to the
    ``width`` window positions it belongs to, and every position aggregates
    its (at most ``width``) rows: a distributed shuffle, no single task.
    """
    from .prefix import global_rank
    half = width // 2
    ranked = global_rank(df, [F.col(order)], "_el_r")
    spread = ranked.select("_el_r", F.col(value).alias("_el_v"),
                           F.explode(F.sequence(F.lit(-half), F.lit(half))).alias("_el_o")).select(
        (F.col("_el_r") + F.col("_el_o")).alias("_el_t"), "_el_v")
    agg = spread.groupBy("_el_t").agg(F.count("_el_v").alias("_el_c"), F.avg("_el_v").alias("_el_m"))
    out = ranked.join(agg, ranked["_el_r"] == agg["_el_t"], "left")
    return out.withColumn(name, F.when(F.col("_el_c") == width, F.col("_el_m"))).drop(
        "_el_r", "_el_t", "_el_c", "_el_m")


def reindex(labels: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """Align a stats table to a fixed label list; missing labels get nulls."""
    return labels.join(stats, key, "left")


def imbalance_ratio(df: DataFrame, target: str) -> DataFrame:
    """n0, n1 and n0 / max(n1, 1)."""
    y = _y(target)
    return df.agg(F.sum(F.when(y == 0, 1).otherwise(0)).alias("n0"),
                  F.sum(F.when(y == 1, 1).otherwise(0)).alias("n1")).withColumn(
        "imbalance_ratio", F.col("n0") / F.greatest(F.col("n1"), F.lit(1)))


def split_summary(df: DataFrame, split_col: str, target: str, group_col: str | None = None) -> DataFrame:
    """Per split side: rows, class counts and shares, distinct groups."""
    y = _y(target)
    aggs = [F.count(F.lit(1)).alias("rows"), F.sum(y).alias("n_pos"), F.sum(1 - y).alias("n_neg"),
            F.avg(y.cast("double")).alias("pos_share")]
    if group_col:
        aggs.append(F.count_distinct(group_col).alias("groups"))
    return df.groupBy(split_col).agg(*aggs).withColumn("neg_share", 1 - F.col("pos_share"))
