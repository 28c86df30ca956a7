"""Flagship slice: child rollup, left join, missing flag, point-in-time
experience per entity, and outcome rate by experience bins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...operators.aggs import rate_by_bins
from ...operators.clean import join_miss_flag_fill
from ...operators.joins import left_join, preagg_left_join
from ...operators.pit import prior_experience
from ...sources.tables import table
from ..registry import query, rounded
from .common import lines, orders_y, with_null_keys, with_null_keys_sql, Y_SQL

# Experience bin edges (right-closed) of the two summaries; the last bin has no end.
ROCKET_EDGES = [-1, 0, 4, 9, 24, float("inf")]
ROCKET_LABELS = ["1st", "2-5", "6-10", "11-25", "25+"]
ORG_EDGES = [-1, 0, 9, 24, 49, 99, float("inf")]
ORG_LABELS = ["1st", "2-10", "11-25", "26-50", "51-100", "100+"]

ROLLUP = {"total_qty": "l_quantity", "total_price": "l_extendedprice"}


def order_facts(spark: SparkSession, sf: str, orders: DataFrame | None = None) -> DataFrame:
    """orders (or ``orders``, with more columns) + per-order lineitem rollup +
    no-lines flag (fills 0)."""
    f = preagg_left_join(orders_y(spark, sf) if orders is None else orders, lines(spark, sf), "o_orderkey", "l_orderkey",
                         ROLLUP, "l_linenumber", "line_count")
    return join_miss_flag_fill(f, "line_count", "lines_missing", ["total_qty", "total_price", "line_count"])


def customer_experience(spark: SparkSession, sf: str, **kw) -> DataFrame:
    return prior_experience(order_facts(spark, sf), "o_custkey", "o_orderdate", "o_orderkey", "y", "cust", **kw)


def _upto(col: str, edge) -> str:
    return "" if edge == float("inf") else f" AND {col} <= {edge}"


def _case_bins(col: str, edges, labels) -> str:
    parts = [f"WHEN {col} > {edges[i]}{_upto(col, edges[i + 1])} THEN '{labels[i]}'" for i in range(len(labels))]
    return "CASE " + " ".join(parts) + " END"


def _case_order(col: str, edges) -> str:
    parts = [f"WHEN {col} > {edges[i]}{_upto(col, edges[i + 1])} THEN {i}" for i in range(len(edges) - 1)]
    return "CAST(CASE " + " ".join(parts) + " END AS INTEGER)"


_FACTS_SQL = f"""
  li AS (SELECT l_orderkey, coalesce(sum(l_quantity), 0) AS total_qty,
                coalesce(sum(l_extendedprice), 0) AS total_price, count(l_linenumber) AS line_count
         FROM lineitem WHERE l_orderkey IS NOT NULL GROUP BY l_orderkey),
  f AS (SELECT o.*, {Y_SQL} AS y,
               coalesce(li.total_qty, 0) AS total_qty, coalesce(li.total_price, 0) AS total_price,
               coalesce(li.line_count, 0) AS line_count,
               CAST(CASE WHEN li.line_count IS NULL THEN 1 ELSE 0 END AS INTEGER) AS lines_missing
        FROM orders o LEFT JOIN li ON o.o_orderkey = li.l_orderkey)"""


def _prior_sql(entity: str) -> str:
    w = (f"PARTITION BY {entity} ORDER BY o_orderdate ASC NULLS LAST, o_orderkey "
         "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING")
    return f"count(*) OVER ({w}) AS n, coalesce(sum(y) OVER ({w}), 0) AS s"


EXPERIENCE_SQL = f"""
WITH {_FACTS_SQL},
  p AS (SELECT *, {_prior_sql('o_custkey')} FROM f)
SELECT {_case_bins('n', ROCKET_EDGES, ROCKET_LABELS)} AS experience,
       {_case_order('n', ROCKET_EDGES)} AS bin_order,
       count(*) AS n,
       round(avg(y), 6) AS success_rate,
       CAST(sum(lines_missing) AS BIGINT) AS orders_without_lines,
       round(avg(line_count), 6) AS avg_lines
FROM p WHERE n > {ROCKET_EDGES[0]}{_upto('n', ROCKET_EDGES[-1])}
GROUP BY ALL
"""


@query("experience_outcome", EXPERIENCE_SQL)
def experience_outcome(spark: SparkSession, sf: str) -> DataFrame:
    """Does prior experience predict the outcome? Rate by customer experience."""
    p = customer_experience(spark, sf)
    from ...operators.aggs import right_closed_bin
    staged = p.select(
        right_closed_bin("cust_prior_launches", ROCKET_EDGES, ROCKET_LABELS).alias("experience"),
        right_closed_bin("cust_prior_launches", ROCKET_EDGES,
                         [str(i) for i in range(len(ROCKET_LABELS))]).cast("int").alias("bin_order"),
        "y", "lines_missing", "line_count")
    out = staged.where(F.col("experience").isNotNull()).groupBy("experience", "bin_order").agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("success_rate"),
        F.sum("lines_missing").cast("bigint").alias("orders_without_lines"),
        F.avg("line_count").alias("avg_lines"))
    return rounded(out)


# --- child rollup / pre-aggregated join / missing flag ---------------------

@query("child_rollup", """
SELECT l_orderkey, round(coalesce(sum(CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity END), 0), 6) AS total_qty,
       round(coalesce(sum(CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_extendedprice END), 0), 6) AS total_price,
       count(CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_linenumber END) AS line_count
FROM lineitem WHERE l_orderkey IS NOT NULL GROUP BY l_orderkey""")
def q_child_rollup(spark, sf):
    from ...operators.aggs import child_rollup
    li = lines(spark, sf).select(
        "l_orderkey",
        F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity")).alias("q"),
        F.when(F.col("l_orderkey") % 5 != 0, F.col("l_extendedprice")).alias("p"),
        F.when(F.col("l_linenumber") % 3 != 0, F.col("l_linenumber")).alias("ln"))
    return rounded(child_rollup(li, "l_orderkey", {"total_qty": "q", "total_price": "p"}, "ln", "line_count"))


@query("preagg_left_join", """
WITH li AS (SELECT l_orderkey, coalesce(sum(l_quantity), 0) AS total_qty,
                   coalesce(sum(l_extendedprice), 0) AS total_price, count(l_linenumber) AS line_count
            FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, o_custkey, round(li.total_qty, 6) AS total_qty, round(li.total_price, 6) AS total_price, li.line_count
FROM orders o LEFT JOIN li ON o.o_orderkey = li.l_orderkey""")
def q_preagg_left_join(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return rounded(preagg_left_join(o, lines(spark, sf), "o_orderkey", "l_orderkey", ROLLUP, "l_linenumber",
                                    "line_count"))


@query("join_miss_flag_fill", f"""
WITH {_FACTS_SQL}
SELECT o_orderkey, lines_missing, round(total_qty, 6) AS total_qty, round(total_price, 6) AS total_price, line_count
FROM f""")
def q_join_miss_flag_fill(spark, sf):
    return rounded(order_facts(spark, sf).select("o_orderkey", "lines_missing", "total_qty", "total_price",
                                                 "line_count"))


# --- point-in-time features -------------------------------------------------

@query("pit_prior_count", f"""
WITH f AS (SELECT *, {Y_SQL} AS y FROM orders)
SELECT o_orderkey, o_custkey, n AS cust_prior_launches
FROM (SELECT *, {_prior_sql('o_custkey')} FROM f)""")
def q_pit_prior_count(spark, sf):
    p = prior_experience(orders_y(spark, sf), "o_custkey", "o_orderdate", "o_orderkey", "y", "cust")
    return p.select("o_orderkey", "o_custkey", "cust_prior_launches")


@query("pit_prior_success", f"""
WITH f AS (SELECT *, {Y_SQL} AS y FROM orders)
SELECT o_orderkey, o_orderpriority, n AS prio_prior_launches, CAST(s AS BIGINT) AS prio_prior_successes
FROM (SELECT *, {_prior_sql('o_orderpriority')} FROM f)""")
def q_pit_prior_success(spark, sf):
    """Per priority: five entities, each a fifth of all rows (a hot-key case)."""
    p = prior_experience(orders_y(spark, sf), "o_orderpriority", "o_orderdate", "o_orderkey", "y", "prio")
    return p.select("o_orderkey", "o_orderpriority", "prio_prior_launches", "prio_prior_successes")


@query("pit_prior_rate", f"""
WITH f AS (SELECT o.*, c.c_nationkey, {Y_SQL} AS y FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey),
  g AS (SELECT avg(y) AS m FROM f),
  p AS (SELECT *, {_prior_sql('c_nationkey')} FROM f)
SELECT o_orderkey, c_nationkey,
       round(CASE WHEN c_nationkey IS NULL THEN NULL WHEN n = 0 THEN (SELECT m FROM g)
                  ELSE CAST(s AS DOUBLE) / n END, 6) AS nation_prior_success_rate
FROM p""")
def q_pit_prior_rate(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    f = orders_y(spark, sf).join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    p = prior_experience(f, "c_nationkey", "o_orderdate", "o_orderkey", "y", "nation")
    return rounded(p.select("o_orderkey", "c_nationkey", "nation_prior_success_rate"))


@query("pit_first_flag", f"""
WITH f AS (SELECT *, {Y_SQL} AS y FROM orders)
SELECT o_orderkey, CAST(CASE WHEN n = 0 THEN 1 ELSE 0 END AS INTEGER) AS cust_is_first
FROM (SELECT *, {_prior_sql('o_custkey')} FROM f)""")
def q_pit_first_flag(spark, sf):
    p = prior_experience(orders_y(spark, sf), "o_custkey", "o_orderdate", "o_orderkey", "y", "cust")
    return p.select("o_orderkey", "cust_is_first")


# --- outcome rate by experience bins ---------------------------------------

def _bins_sql(entity_sql_from: str, entity: str, edges, labels) -> str:
    return f"""
WITH f AS ({entity_sql_from}),
  p AS (SELECT *, {_prior_sql(entity)} FROM f)
SELECT {_case_bins('n', edges, labels)} AS bin, {_case_order('n', edges)} AS bin_order,
       round(avg(y), 6) AS success_rate, count(*) AS n
FROM p WHERE n > {edges[0]}{_upto("n", edges[-1])} AND {entity} IS NOT NULL GROUP BY ALL"""


@query("rate_by_bins", _bins_sql(f"SELECT *, {Y_SQL} AS y FROM orders", "o_custkey", ROCKET_EDGES, ROCKET_LABELS))
def q_rate_by_bins(spark, sf):
    p = prior_experience(orders_y(spark, sf), "o_custkey", "o_orderdate", "o_orderkey", "y", "cust")
    return rounded(rate_by_bins(p, "cust_prior_launches", ROCKET_EDGES, ROCKET_LABELS, "y").withColumnRenamed(
        "bin", "bin"))


@query("learning_curve", _bins_sql(
    f"SELECT o.*, c.c_nationkey, {Y_SQL} AS y FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey",
    "c_nationkey", ORG_EDGES, ORG_LABELS))
def q_learning_curve(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    f = orders_y(spark, sf).join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    p = prior_experience(f, "c_nationkey", "o_orderdate", "o_orderkey", "y", "nation")
    return rounded(rate_by_bins(p, "nation_prior_launches", ORG_EDGES, ORG_LABELS, "y"))


# --- joins ------------------------------------------------------------------

@query("left_join_renamed_key", f"""
SELECT o.o_orderkey, o.o_custkey, c.c_custkey AS c_custkey_cu, c.c_mktsegment AS c_mktsegment_cu,
       round(c.c_acctbal, 6) AS c_acctbal_cu
FROM {with_null_keys_sql('orders', 'o_orderkey', 'o_custkey')} o
LEFT JOIN customer c ON o.o_custkey = c.c_custkey""")
def q_left_join_renamed_key(spark, sf):
    """Fact left-join a dimension whose columns get a suffix; the added rows
    with a null key find no match."""
    o = with_null_keys(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", "o_custkey")
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return rounded(left_join(o, c, "o_custkey", "c_custkey", suffix="_cu"))


@query("snowflake_join", f"""
SELECT c.c_custkey, n.n_name AS n_name_na, n.n_regionkey AS n_regionkey_na, r.r_name AS r_name_re
FROM {with_null_keys_sql('customer', 'c_custkey', 'c_nationkey', 5)} c
LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN region r ON n.n_regionkey = r.r_regionkey""")
def q_snowflake_join(spark, sf):
    """customer -> nation -> region; the second key comes from the first join."""
    c = with_null_keys(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_custkey", "c_nationkey", 5)
    n = table(spark, sf, "nation")
    r = table(spark, sf, "region")
    j = left_join(c, n, "c_nationkey", "n_nationkey", suffix="_na", bounded=True)  # nation: 25 rows
    j = left_join(j, r, "n_regionkey_na", "r_regionkey", suffix="_re", bounded=True)  # region: 5 rows
    return j.select("c_custkey", "n_name_na", "n_regionkey_na", "r_name_re")
