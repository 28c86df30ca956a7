"""Best-row selection, de-duplication, top-k, unions and pivots.

"Best row per group" is an aggregate, not a window: ``min_by`` over a sort
struct is decomposable, so Spark combines partial results map-side and a
group holding a third of all rows costs no more than any other group (a
``row_number`` window would sort that whole group in one task).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sort_key(desc: Sequence[str], asc: Sequence[str]) -> Column:
    # descending numeric columns are negated so one ascending struct order works;
    # nulls sort last in either direction (pandas sort_values default)
    parts = []
    for i, c in enumerate(desc):
        parts += [F.col(c).isNull().alias(f"_dn{i}"), (-F.col(c)).alias(f"_d{i}")]
    for i, c in enumerate(asc):
        parts += [F.col(c).isNull().alias(f"_an{i}"), F.col(c).alias(f"_a{i}")]
    return F.struct(*parts)


def best_per_group(df: DataFrame, group_cols: Sequence[str], desc: Sequence[str] = (),
                   asc: Sequence[str] = ()) -> DataFrame:
    """The first row of each group under ORDER BY desc... DESC, asc... ASC
    (a true row - never a mix of columns from different rows). ``desc``
    columns must be numeric; ``asc`` should end with a unique tie-break."""
    cols = [c for c in df.columns]
    best = df.groupBy(*group_cols).agg(
        F.min_by(F.struct(*[F.col(c) for c in cols]), _sort_key(desc, asc)).alias("_best"))
    return best.select("_best.*")


def dedup_keep_best(df: DataFrame, subset: Sequence[str], desc: Sequence[str] = (),
                    asc: Sequence[str] = ()) -> DataFrame:
    """``sort_values(...).drop_duplicates(subset)``: one row per subset key."""
    return best_per_group(df, subset, desc, asc)


def topk(df: DataFrame, n: int, desc: Sequence[str] = (), asc: Sequence[str] = ()) -> DataFrame:
    """Top-n rows (a report): Spark plans ``orderBy().limit(n)`` as a
    per-partition top-n followed by a merge of n rows per partition."""
    order = [F.col(c).desc_nulls_last() for c in desc] + [F.col(c).asc_nulls_last() for c in asc]
    return df.orderBy(*order).limit(n)


def sort_by_abs(df: DataFrame, col: str, name: str, rank: str = "rank", digits: int = 9) -> DataFrame:
    """Rank rows by |col| descending, ties by name - for per-feature tables
    (one row per feature, so a no-partition window is bounded). Values that
    agree in ``digits`` decimals are ties: the last bits of a computed value
    are no order."""
    from pyspark.sql import Window
    w = Window.orderBy(F.round(F.abs(F.col(col)), digits).desc_nulls_last(), F.col(name))
    return df.withColumn(rank, F.row_number().over(w).cast("int"))


def union_results(frames: Sequence[DataFrame]) -> DataFrame:
    """Append result frames with different columns (missing -> null)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def importance_pivot(long: DataFrame, feature: str, model: str, value: str,
                     models: Sequence[str]) -> DataFrame:
    """(feature, model, value) -> one column per model plus their row mean
    (nulls skipped), as in a side-by-side importance report. ``models``
    fixes the pivot values so no extra pass discovers them."""
    wide = long.groupBy(feature).pivot(model, list(models)).agg(F.avg(value))
    vals = [F.col(f"`{m}`") for m in models]
    n = sum((F.when(v.isNotNull(), 1).otherwise(0) for v in vals), F.lit(0))
    s = sum((F.coalesce(v, F.lit(0.0)) for v in vals), F.lit(0.0))
    return wide.withColumn("mean", F.when(n > 0, s / n))


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "column",
            value: str = "value", cast: str | None = "double") -> DataFrame:
    src = df.select(*ids, *[(F.col(c).cast(cast) if cast else F.col(c)).alias(c) for c in values])
    return src.unpivot(list(ids), list(values), name, value)
