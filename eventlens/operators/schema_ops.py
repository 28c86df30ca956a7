"""Data-dependent column selection: classify, drop rare binaries, pick
varied features, numeric feature list.

Each takes one aggregate pass over all candidate columns (a handful of
``count_if`` / ``min`` / ``count_distinct`` per column) and returns a small
per-column table; the driver only reads that table (one row per column).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

# The two cyclical features and their periods.
CYCLICAL_PERIODS = {"launch_hour": 24, "launch_month": 12}


def feature_cols(df: DataFrame, target: str, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns except the target and listed reference columns."""
    ex = set(exclude) | {target}
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in ex]


def column_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Long table: column, non01 (values outside {0,1}), n0, n1, nulls,
    minus_one (count of -1), min, max - one pass over ``df``."""
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [
            F.count_if(x.isNotNull() & ~x.isin(0.0, 1.0)).alias(f"a{i}"),
            F.count_if(x == 0.0).alias(f"b{i}"),
            F.count_if(x == 1.0).alias(f"c{i}"),
            F.count_if(x.isNull()).alias(f"d{i}"),
            F.count_if(x == -1.0).alias(f"e{i}"),
            F.min(x).alias(f"f{i}"),
            F.max(x).alias(f"g{i}"),
        ]
    wide = df.agg(*aggs)
    stack = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"a{i}").alias("non01"), F.col(f"b{i}").alias("n0"),
                 F.col(f"c{i}").alias("n1"), F.col(f"d{i}").alias("nulls"), F.col(f"e{i}").alias("minus_one"),
                 F.col(f"f{i}").alias("min"), F.col(f"g{i}").alias("max"))
        for i, c in enumerate(cols)]))
    return wide.select(stack.alias("s")).select("s.*")


def classify_columns(df: DataFrame, cols: Sequence[str],
                     cyclical: Mapping[str, float] = CYCLICAL_PERIODS) -> DataFrame:
    """(column, kind, sentinel): kind is binary (all non-null values in
    {0,1}), cyclical (listed name) or continuous; a continuous column is a
    sentinel column when it contains -1, its minimum is -1 and it has no
    nulls (a null fails the ``>= -1`` test, as in pandas)."""
    st = column_stats(df, cols)
    cyc = list(cyclical)
    kind = (F.when(F.col("non01") == 0, "binary")
            .when(F.col("column").isin(cyc) if cyc else F.lit(False), "cyclical").otherwise("continuous"))
    sentinel = ((kind == "continuous") & (F.col("minus_one") > 0) & (F.col("min") >= -1.0)
                & (F.col("nulls") == 0)).cast("int")
    return st.select("column", kind.alias("kind"), sentinel.alias("sentinel"))


def classes_dict(classified: DataFrame) -> dict[str, list[str]]:
    out = {"continuous": [], "binary": [], "cyclical": [], "sentinel": []}
    for r in classified.collect():
        out[r["kind"]].append(r["column"])
        if r["sentinel"]:
            out["sentinel"].append(r["column"])
    return out


def rare_binary_table(df: DataFrame, binary_cols: Sequence[str], min_count: int = 10) -> DataFrame:
    """(column, minority, keep): binary columns whose smaller class has
    fewer than ``min_count`` rows are dropped."""
    st = column_stats(df, binary_cols)
    minority = F.least("n0", "n1")
    return st.select("column", minority.alias("minority"), (minority >= min_count).cast("int").alias("keep"))


def drop_rare_binary(df: DataFrame, binary_cols: Sequence[str], min_count: int = 10) -> list[str]:
    """Columns of ``df`` kept after dropping rare binaries (order preserved)."""
    drop = {r["column"] for r in rare_binary_table(df, binary_cols, min_count).where("keep = 0").collect()}
    return [c for c in df.columns if c not in drop]


def varied_columns(df: DataFrame, cols: Sequence[str], at_least: int) -> list[str]:
    """Columns with ``at_least`` distinct values. Two of them are the extremes;
    each further one is the least value above the last, one pass each."""
    top = {r["column"]: r for r in column_stats(df, cols).collect()}  # one row per column
    low = {c: r["min"] for c, r in top.items()}
    left = [c for c in cols if low[c] is not None] if at_least > 0 else list(cols)
    for _ in range(1, at_least):
        left = [c for c in left if low[c] < top[c]["max"]]
        if not left:
            break
        row = df.agg(*[F.min(F.when(F.col(c).cast("double") > low[c], F.col(c).cast("double"))).alias(f"m{i}") for i, c in enumerate(left)]).first()
        low = {c: row[f"m{i}"] for i, c in enumerate(left)}
    return left


def select_by_variance(df: DataFrame, importance: DataFrame, requested: Sequence[str], n: int,
                       min_unique: int = 3) -> DataFrame:
    """Pick up to ``n`` features with >= ``min_unique`` distinct values:
    requested ones first (in the given order), then by importance
    descending (ties by name). ``importance`` is (feature, importance).
    Returns (feature, position)."""
    feats = [r["feature"] for r in importance.select("feature").collect()]
    varied = varied_columns(df, feats, min_unique)
    req = {f: i for i, f in enumerate(requested)}
    req_expr = F.lit(None).cast("int")
    for f, i in req.items():
        req_expr = F.when(F.col("feature") == f, F.lit(i)).otherwise(req_expr)
    j = importance.where(F.col("feature").isin(varied) if varied else F.lit(False)).withColumn("_req", req_expr)
    from pyspark.sql import Window
    w = Window.orderBy(F.col("_req").asc_nulls_last(), F.col("importance").desc(), F.col("feature"))
    # one row per feature: a no-partition window over a table bounded by the column count
    return j.withColumn("position", F.row_number().over(w) - 1).where(F.col("position") < n).select(
        "feature", F.col("position").cast("int"))
