"""Distributed ranks and running sums for the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def number_rows(df: DataFrame, order: Sequence[Column], name: str, parts: int) -> DataFrame:
    """Add ``name``: the 0-based position of each row in ``order``.

    Rows are range-partitioned into ``parts`` and written once, numbered
    inside each part, and shifted by the rows of the earlier parts, so no task
    sees more than one part.
    """
    part = "_nr_part"
    tagged = materialize(df.repartitionByRange(parts, *order).withColumn(part, F.spark_partition_id()), "ranked")
    counts = tagged.groupBy(F.col(part).alias("_nr_p")).agg(F.count(F.lit(1)).alias("_nr_n"))
    before = Window.orderBy("_nr_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    shifts = counts.select("_nr_p", F.coalesce(F.sum("_nr_n").over(before), F.lit(0)).alias("_nr_s"))
    inside = F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1
    return (tagged.withColumn(name, inside).join(shifts, F.col(part) == F.col("_nr_p"))
            .withColumn(name, (F.col(name) + F.col("_nr_s")).cast("bigint")).drop(part, "_nr_p", "_nr_s"))
