"""Left-outer equi joins of a fact table to its dimensions.

Strategy is left to AQE: a dimension that is measured under
``spark.sql.autoBroadcastJoinThreshold`` at run time is broadcast, a larger
one is shuffled (sort-merge, with skew-split of hot partitions). Tables that
should be small (nation, region, lookup lists) get an explicit ``broadcast``
hint via ``bounded=True``, after a check that they are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggs import child_rollup


#: Most rows of a table that is broadcast by hint.
BROADCAST_ROWS = 10_000


def broadcast_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows (counted
    no further than that), else as it is: AQE then plans the join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def suffixed(df: DataFrame, suffix: str, exclude: Sequence[str] = ()) -> DataFrame:
    """Append ``suffix`` to every column name except ``exclude``."""
    ex = set(exclude)
    return df.select(*[F.col(c).alias(c if c in ex else c + suffix) for c in df.columns])


def left_join(fact: DataFrame, dim: DataFrame, left_key: str | Sequence[str], right_key: str | Sequence[str],
              suffix: str | None = None, drop_right_key: bool = False, null_safe: bool = False,
              bounded: bool = False) -> DataFrame:
    """``fact`` left-outer-join ``dim`` on ``left_key = right_key``.

    ``suffix`` renames all right columns first (keys included, so a right
    key that is named like a left column cannot collide). ``null_safe`` uses
    ``<=>`` (pandas merges null keys with null keys; plain SQL does not).
    """
    lk = [left_key] if isinstance(left_key, str) else list(left_key)
    rk = [right_key] if isinstance(right_key, str) else list(right_key)
    if suffix:
        dim = suffixed(dim, suffix)
        rk = [k + suffix for k in rk]
    if bounded:
        dim = broadcast_small(dim)
    cond: Column | None = None
    for a, b in zip(lk, rk):
        c = fact[a].eqNullSafe(dim[b]) if null_safe else fact[a] == dim[b]
        cond = c if cond is None else cond & c
    out = fact.join(dim, cond, "left")
    if drop_right_key:
        out = out.drop(*[dim[b] for b in rk])
    return out


def preagg_left_join(fact: DataFrame, child: DataFrame, fact_key: str, child_key: str,
                     sums: Mapping[str, str], count_col: str, count_name: str) -> DataFrame:
    """Aggregate the one-to-many side per key first, then left-join.

    Pre-aggregating turns a many-row child into one row per key before the
    shuffle (Catalyst does not push an aggregate below a join by itself).
    Facts without children get nulls here; see ``join_miss_flag_fill``.
    """
    roll = child_rollup(child, child_key, sums, count_col, count_name)
    roll = roll.withColumnRenamed(child_key, "_el_ck")
    return fact.join(roll, fact[fact_key] == roll["_el_ck"], "left").drop("_el_ck")
