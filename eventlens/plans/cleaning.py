"""Raw tables -> one wide fact table (star / snowflake of left joins).

``star_join`` takes the fact table and an ordered list of dimension specs;
each spec left-joins one dimension (optionally suffixing its columns, or
pre-aggregating a one-to-many child first). Dimensions may key on columns
that an earlier join brought in (snowflake). The fact row count is
preserved when every dimension key is unique (null keys never match);
``check_rows=True`` verifies that with one aggregate per dimension - a pass
over each dimension, none over the (much larger) fact table - and raises
on a duplicated key. Pre-aggregated children are unique by construction.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import left_join, preagg_left_join


@dataclass(frozen=True)
class Dim:
    table: DataFrame
    left_key: str
    right_key: str
    suffix: str | None = None
    bounded: bool = False          # fixed, small size: broadcast hint
    rollup: Mapping[str, str] | None = None   # child table: sums to take per key
    count_col: str | None = None
    count_name: str | None = None


def star_join(fact: DataFrame, dims: Sequence[Dim], check_rows: bool = True) -> DataFrame:
    out = fact
    for d in dims:
        if d.rollup is not None:
            out = preagg_left_join(out, d.table, d.left_key, d.right_key, d.rollup, d.count_col, d.count_name)
        else:
            out = left_join(out, d.table, d.left_key, d.right_key, suffix=d.suffix, bounded=d.bounded)
    if check_rows:
        for d in dims:
            if d.rollup is not None:
                continue
            dup = (d.table.where(F.col(d.right_key).isNotNull()).groupBy(d.right_key).count()
                   .where(F.col("count") > 1).limit(1).collect())
            if dup:
                raise ValueError(f"dimension key {d.right_key!r} is not unique (e.g. {dup[0][0]!r}): "
                                 "the left join would duplicate fact rows")
    return out
