"""Registry of named queries: a Spark callable ``(spark, sf_dir) -> DataFrame``
and, where the result is expressible in SQL, an independent DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column (results are compared after rounding)."""
    cols = {f.name: F.round(F.col(f.name), digits) for f in df.schema.fields
            if isinstance(f.dataType, (DoubleType, FloatType))}
    return df.withColumns(cols) if cols else df
