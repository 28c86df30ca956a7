"""Cleaning operators whose output schema depends on the data.

Each needs a small statistic first (categories, null counts, medians).
The statistics for many columns are taken in ONE aggregate pass and the
result (bounded by the number of columns / categories) is applied as
literals in one ``select``.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import flag, slug
from .prefix import exact_quantiles

#: Default of ``max_categories``, the most that ``one_hot`` accepts: the
#: categories become columns, so they must stay few.
MAX_CATEGORIES = 1000


def drop_if_present(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drop listed columns; absent names are ignored."""
    present = [n for n in names if n in df.columns]
    return df.drop(*present)


def rename_map(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping))


@dataclass(frozen=True)
class OneHot:
    """Fitted one-hot encoder: the sorted category list of one column."""
    column: str
    prefix: str
    categories: tuple
    suffix: str = ""

    def names(self) -> list[str]:
        return [f"{self.prefix}_{v}{self.suffix}" for v in self.categories]

    def apply(self, df: DataFrame, drop: bool = False) -> DataFrame:
        """One int column per category; a null value gives all zeros. The
        source column is kept unless ``drop``."""
        c = F.col(self.column)
        cols = {n: flag(c == F.lit(v)) for n, v in zip(self.names(), self.categories)}
        out = df.withColumns(cols)
        return out.drop(self.column) if drop else out


def fit_one_hot(df: DataFrame, column: str, prefix: str | None = None, suffix: str = "",
                max_categories: int = MAX_CATEGORIES) -> OneHot:
    cats = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct()
            .orderBy(column).limit(max_categories + 1).collect()]
    if len(cats) > max_categories:
        raise ValueError(f"{column} has more than {max_categories} categories; one-hot would be too wide")
    return OneHot(column, prefix or column, tuple(cats), suffix)


def one_hot(df: DataFrame, column: str, prefix: str | None = None, suffix: str = "", drop: bool = False,
            max_categories: int = MAX_CATEGORIES) -> DataFrame:
    return fit_one_hot(df, column, prefix, suffix, max_categories).apply(df, drop)


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, int]:
    """Null count per column, one aggregate pass."""
    columns = list(columns or df.columns)
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"_n{i}") for i, c in enumerate(columns)]).first()
    return {c: int(row[f"_n{i}"]) for i, c in enumerate(columns)}


def null_census(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Long table (column, dtype, rows, non_null, nulls), computed in one pass."""
    columns = list(columns or df.columns)
    types = dict(df.dtypes)
    wide = df.agg(F.count(F.lit(1)).alias("_rows"),
                  *[F.count_if(F.col(c).isNull()).alias(f"_n{i}") for i, c in enumerate(columns)])
    stack = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("dtype"), F.col(f"_n{i}").alias("nulls"))
        for i, c in enumerate(columns)]))
    return wide.select(F.col("_rows").alias("rows"), stack.alias("s")).select(
        "s.column", "s.dtype", "rows", (F.col("rows") - F.col("s.nulls")).alias("non_null"), "s.nulls")


def constant_table(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, dropped): ``dropped`` = at most one distinct non-null value,
    that is no minimum or the same maximum; one aggregate of constant size."""
    columns = list(columns or df.columns)
    wide = df.agg(*[F.min(F.col(c)).eqNullSafe(F.max(F.col(c))).alias(f"_d{i}") for i, c in enumerate(columns)])
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_d{i}").cast("int").alias("dropped"))
                                for i, c in enumerate(columns)]))
    return wide.select(stack.alias("s")).select("s.*")


def drop_constant(df: DataFrame, columns: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Drop columns with at most one distinct non-null value (one pass)."""
    dropped = [r["column"] for r in constant_table(df, columns).where("dropped = 1").collect()]
    return df.drop(*dropped), dropped


def join_miss_flag_fill(df: DataFrame, probe: str, flag_name: str, fill_cols: Sequence[str]) -> DataFrame:
    """After a left join: flag rows whose ``probe`` is null, fill ``fill_cols`` with 0."""
    out = df.withColumn(flag_name, F.isnull(probe).cast("int"))
    return out.fillna(0, subset=list(fill_cols))


def median_impute(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, dict[str, float | None]]:
    """Fill nulls with the exact median of each column (distributed quantile)."""
    med = {c: v[0] for c, v in exact_quantiles(df, list(columns), [0.5]).items()}
    fills = {c: v for c, v in med.items() if v is not None}
    return (df.fillna(fills) if fills else df), med


@dataclass(frozen=True)
class SentinelFill:
    """Columns that had nulls at fit time, each with its ``<slug>_missing`` flag."""
    flagged: tuple
    sentinel: float = -1.0

    def apply(self, df: DataFrame) -> DataFrame:
        cols = {}
        for c in self.flagged:
            cols[slug(c) + "_missing"] = F.isnull(c).cast("int")
        out = df.withColumns(cols) if cols else df
        return out.fillna(self.sentinel, subset=list(self.flagged)) if self.flagged else out


def fit_sentinel_fill(df: DataFrame, columns: Sequence[str], sentinel: float = -1.0) -> SentinelFill:
    present = [c for c in columns if c in df.columns]
    counts = null_counts(df, present) if present else {}
    return SentinelFill(tuple(c for c in present if counts[c] > 0), sentinel)


def sentinel_flag_fill(df: DataFrame, columns: Sequence[str], sentinel: float = -1.0) -> DataFrame:
    """For each listed column that has nulls: add ``<slug>_missing`` and fill with ``sentinel``."""
    return fit_sentinel_fill(df, columns, sentinel).apply(df)


def constant_fill(df: DataFrame, columns: Sequence[str], value: str = "Unknown") -> DataFrame:
    return df.fillna(value, subset=[c for c in columns if c in df.columns])
