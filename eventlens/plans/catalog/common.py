"""Shared inputs for the catalogue queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ...functions.columns import binary_target
from ...sources.tables import table

# SQL fragments repeated by the oracles.
Y_SQL = "CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS INTEGER)"


def nul(key: str, c: str | Column, mod: int = 7) -> Column:
    """Deterministic null injection: null where ``key % mod == 0``."""
    col = F.col(c) if isinstance(c, str) else c
    return F.when(F.col(key) % mod != 0, col)


def nul_sql(key: str, c: str, mod: int = 7) -> str:
    return f"CASE WHEN {key} % {mod} = 0 THEN NULL ELSE {c} END"


def with_null_keys(df: DataFrame, id_col: str, key: str, mod: int = 7) -> DataFrame:
    """``df`` and, as further rows with negative ids, every ``mod``-th row
    without its ``key``: the real keys stay joined."""
    extra = df.where(F.col(id_col) % mod == 0)
    return df.unionByName(extra.withColumns({key: F.lit(None).cast(df.schema[key].dataType), id_col: -F.col(id_col)}))


def with_null_keys_sql(table_name: str, id_col: str, key: str, mod: int = 7) -> str:
    return (f"(SELECT * FROM {table_name} UNION ALL SELECT * REPLACE (-{id_col} AS {id_col}, NULL AS {key}) "
            f"FROM {table_name} WHERE {id_col} % {mod} = 0)")


def orders_y(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").withColumn("y", binary_target("o_orderstatus", "F"))


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem")


# Score table for the evaluation queries: y = document quality, score from
# the document length (a plain arithmetic score shared with the oracle).
