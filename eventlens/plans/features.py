"""Feature engineering: the wide fact table -> model table.

Point-in-time experience per entity (three entities, three window
partitionings), temporal parts, guarded ratios and flags, then forced and
correlation-driven drops. Every step is a column expression or a window;
the only actions are the global base rate (one scalar) and the correlation
aggregate of the pruning step.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import decade, flag, safe_ratio, utilisation_ratio
from ..operators.corr import corr_prune
from ..operators.pit import global_rate, prior_experience


def add_temporal(df: DataFrame, time: str, year: str, early_before: int, late_from: int) -> DataFrame:
    return df.withColumns({
        "launch_hour": F.hour(time), "launch_month": F.month(time), "launch_decade": decade(F.col(year)),
        "era_early": flag(F.col(year) < early_before), "era_late": flag(F.col(year) >= late_from)})


def add_experience(df: DataFrame, entities: Mapping[str, str], time: str, tie: str, target: str,
                   base_rate: float | None = None, first_flag: Sequence[str] = ()) -> DataFrame:
    """``entities`` maps prefix -> entity column. The base rate is shared."""
    rate = global_rate(df, target) if base_rate is None else base_rate
    out = df
    for prefix, col in entities.items():
        out = prior_experience(out, col, time, tie, target, prefix, base_rate=rate, first_flag=prefix in first_flag)
    return out


def add_ratios(df: DataFrame, ratios: Mapping[str, tuple], utilisation: Mapping[str, tuple] = {}) -> DataFrame:
    cols = {name: safe_ratio(n, d) for name, (n, d) in ratios.items()}
    cols.update({name: utilisation_ratio(n, d) for name, (n, d) in utilisation.items()})
    return df.withColumns(cols)


def prune(df: DataFrame, numeric: Sequence[str], target: str, forced: Sequence[str] = (),
          threshold: float = 0.85) -> tuple[DataFrame, list[str]]:
    return corr_prune(df, numeric, threshold, forced, target=target)


# --- the orders instance used by the learning queries ------------------------------

ORDER_FEATURES = ["o_totalprice", "total_qty", "line_count", "lines_missing", "cust_prior_launches",
                  "cust_prior_success_rate", "cust_is_first", "prio_prior_success_rate", "launch_month",
                  "is_urgent", "price_per_line"]


def order_model_table(spark, sf: str) -> DataFrame:
    """orders + lineitem rollup + experience features; y = status 'F'. The
    experience of an order needs no lines, so the narrow orders move for it."""
    from .catalog.common import orders_y
    from .catalog.core import order_facts
    o = add_experience(orders_y(spark, sf), {"prio": "o_orderpriority", "cust": "o_custkey"}, "o_orderdate", "o_orderkey", "y",
                       first_flag=["cust"])
    f = order_facts(spark, sf, o)
    f = f.withColumns({"year": F.year("o_orderdate"), "launch_month": F.month("o_orderdate"),
                       "is_urgent": flag(F.col("o_orderpriority") == "1-URGENT"),
                       "price_per_line": safe_ratio("total_price", "line_count")})
    cols = ["o_orderkey", "year", "y", *ORDER_FEATURES]
    return f.select(*[F.col(c).cast("double").alias(c) if c in ORDER_FEATURES else F.col(c) for c in cols])
