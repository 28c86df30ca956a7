"""Profiles, outcome summaries, correlations, splits and the star join."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.columns import flag
from ...functions.rng import uniform, uniform_sql
from ...operators import aggs as A
from ...operators import corr as CR
from ...operators import profile as PR
from ...operators.clean import one_hot
from ...operators.pit import prior_experience
from ...operators.sampling import temporal_split
from ...sources.tables import table
from ..cleaning import Dim, star_join
from ..registry import query, rounded
from .common import nul, nul_sql, orders_y, with_null_keys, with_null_keys_sql, Y_SQL
from .core import order_facts

# --- describe -----------------------------------------------------------------

_NUM_COLS = ["o_totalprice", "o_custkey", "price_nul"]


def _orders_num(spark, sf):
    return table(spark, sf, "orders").select("o_totalprice", "o_custkey",
                                             nul("o_orderkey", "o_totalprice").alias("price_nul"))


_ORD_NUM_SQL = f"(SELECT o_totalprice, o_custkey, {nul_sql('o_orderkey', 'o_totalprice')} AS price_nul FROM orders)"


@query("describe_numeric", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
       round(CAST(min({c}) AS DOUBLE), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS p25,
       round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75,
       round(CAST(max({c}) AS DOUBLE), 6) AS max FROM {_ORD_NUM_SQL}""" for c in _NUM_COLS))
def q_describe_numeric(spark, sf):
    return rounded(PR.describe_numeric(_orders_num(spark, sf), _NUM_COLS))


_STR_COLS = ["c_mktsegment", "c_nationkey", "seg_nul"]
_CUST_STR_SQL = f"(SELECT c_mktsegment, CAST(c_nationkey AS VARCHAR) AS c_nationkey, " \
                f"{nul_sql('c_custkey', 'c_mktsegment', 3)} AS seg_nul FROM customer)"


@query("describe_string", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", sum(n) AS count, count(*) AS "unique",
       arg_min(v, (-n, v)) AS top, max(n) AS freq
    FROM (SELECT {c} AS v, count(*) AS n FROM {_CUST_STR_SQL} WHERE {c} IS NOT NULL GROUP BY 1)""" for c in _STR_COLS)
    .replace("sum(n) AS count", "CAST(sum(n) AS BIGINT) AS count"))
def q_describe_string(spark, sf):
    c = table(spark, sf, "customer").select("c_mktsegment", F.col("c_nationkey").cast("string"),
                                            nul("c_custkey", "c_mktsegment", 3).alias("seg_nul"))
    return PR.describe_string(c, _STR_COLS)


@query("distinct_counts", """SELECT 'o_custkey' AS "column", count(DISTINCT o_custkey) AS n_distinct FROM orders
UNION ALL SELECT 'o_orderdate', count(DISTINCT o_orderdate) FROM orders
UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority) FROM orders""")
def q_distinct_counts(spark, sf):
    return PR.distinct_counts(table(spark, sf, "orders"), ["o_custkey", "o_orderdate", "o_orderpriority"])


@query("value_counts_topn", """SELECT p_brand, count(*) AS count FROM part WHERE p_brand IS NOT NULL
GROUP BY 1 ORDER BY count DESC, p_brand LIMIT 15""")
def q_value_counts_topn(spark, sf):
    return PR.value_counts_topn(table(spark, sf, "part"), "p_brand", 15, 20)


_HIST_SRC = f"(SELECT {nul_sql('event_id', 'value', 13)} AS v FROM events)"


@query("histogram30", f"""WITH s AS (SELECT min(v) AS lo, max(v) AS hi FROM {_HIST_SRC}),
  b AS (SELECT CASE WHEN v IS NOT NULL THEN CAST(least(floor((v - lo) / ((hi - lo) / 30)) + 1, 30) AS INTEGER) END AS bucket, lo, hi
        FROM {_HIST_SRC}, s)
SELECT bucket, round(CASE WHEN bucket IS NULL THEN NULL ELSE any_value(lo) + (bucket - 1) * ((any_value(hi) - any_value(lo)) / 30) END, 6) AS lo,
       round(CASE WHEN bucket IS NULL THEN NULL ELSE any_value(lo) + bucket * ((any_value(hi) - any_value(lo)) / 30) END, 6) AS hi,
       count(*) AS n
FROM b GROUP BY bucket""")
def q_histogram30(spark, sf):
    e = table(spark, sf, "events").select(nul("event_id", "value", 13).alias("v"))
    return rounded(PR.histogram(e, "v", 30))


# --- outcome summaries --------------------------------------------------------

_YEARLY_SQL = f"""SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(sum(y) AS BIGINT) AS successes,
       count(*) AS total, CAST(count(*) - sum(y) AS BIGINT) AS failures, avg(y) AS success_rate
FROM (SELECT *, {Y_SQL} AS y FROM orders) GROUP BY 1"""


@query("yearly_outcomes", f"SELECT year, successes, total, failures, round(success_rate, 6) AS success_rate "
                          f"FROM ({_YEARLY_SQL})")
def q_yearly_outcomes(spark, sf):
    o = orders_y(spark, sf).withColumn("year", F.year("o_orderdate"))
    return rounded(A.outcome_by(o, ["year"], "y").withColumn("successes", F.col("successes").cast("bigint")))


@query("rolling_centered", f"""SELECT year, round(success_rate, 6) AS success_rate,
       round(CASE WHEN count(success_rate) OVER w = 5 THEN avg(success_rate) OVER w END, 6) AS rolling
FROM ({_YEARLY_SQL}) WINDOW w AS (ORDER BY year ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def q_rolling_centered(spark, sf):
    o = orders_y(spark, sf).withColumn("year", F.year("o_orderdate"))
    yearly = A.outcome_by(o, ["year"], "y").select("year", "success_rate")  # one row per year
    return rounded(A.rolling_centered_mean(yearly, "year", "success_rate", 5, "rolling"))


_SEGS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("rate_by_onehot", f"""SELECT c.c_mktsegment AS category, count(*) AS total, round(avg(y), 6) AS success_rate,
       CAST(sum(1 - y) AS BIGINT) AS failures
FROM (SELECT *, {Y_SQL} AS y FROM orders) o JOIN customer c ON o.o_custkey = c.c_custkey
WHERE c.c_mktsegment IS NOT NULL
GROUP BY 1 HAVING count(*) >= 10""")
def q_rate_by_onehot(spark, sf):
    """Category recovered from one-hot columns (support >= 10)."""
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("seg"))
    c = one_hot(c, "seg", "Segment", "_co", drop=True)
    f = orders_y(spark, sf).join(c, F.col("o_custkey") == F.col("c_custkey"))
    cols = [x for x in c.columns if x.startswith("Segment_")]
    out = A.rate_by_onehot(f, cols, "y", prefix="Segment_", suffix="_co", min_count=10)
    return rounded(out.withColumn("failures", F.col("failures").cast("bigint")))


@query("rate_by_binary", f"""SELECT CASE o_custkey % 2 WHEN 1 THEN 'Odd' ELSE 'Even' END AS parity,
       round(avg(y), 6) AS success_rate, count(*) AS count
FROM (SELECT *, {Y_SQL} AS y FROM orders) GROUP BY 1""")
def q_rate_by_binary(spark, sf):
    o = orders_y(spark, sf).withColumn("parity", F.when(F.col("o_custkey") % 2 == 1, "Odd")
                                       .when(F.col("o_custkey") % 2 == 0, "Even"))
    out = A.outcome_by(o, ["parity"], "y").select("parity", "success_rate", F.col("total").alias("count"))
    return rounded(out)


_FLAGS = {"No line items": "lines_missing", "First customer order": "cust_is_first", "Late era": "era_late"}


@query("rate_by_flags", f"""WITH li AS (SELECT DISTINCT l_orderkey FROM lineitem),
  f AS (SELECT o.*, {Y_SQL} AS y, CAST(CASE WHEN li.l_orderkey IS NULL THEN 1 ELSE 0 END AS INTEGER) AS lines_missing,
               CAST(CASE WHEN count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 0 THEN 1 ELSE 0 END AS INTEGER) AS cust_is_first,
               CAST(year(o_orderdate) >= 2000 AS INTEGER) AS era_late
        FROM orders o LEFT JOIN li ON o.o_orderkey = li.l_orderkey),
  cells AS (SELECT * FROM (VALUES ('No line items', 'lines_missing'), ('First customer order', 'cust_is_first'),
                                  ('Late era', 'era_late')) t(feature, col), (VALUES (1), (0)) v(value)),
  long AS (UNPIVOT (SELECT y, lines_missing, cust_is_first, era_late FROM f)
           ON lines_missing, cust_is_first, era_late INTO NAME col VALUE value)
SELECT cells.feature, CASE WHEN cells.value = 1 THEN 'Yes' ELSE 'No' END AS value,
       round(avg(long.y), 6) AS success_rate, count(long.y) AS n
FROM cells LEFT JOIN long ON cells.col = long.col AND cells.value = long.value
GROUP BY cells.feature, cells.value""")
def q_rate_by_flags(spark, sf):
    f = order_facts(spark, sf)
    f = prior_experience(f, "o_custkey", "o_orderdate", "o_orderkey", "y", "cust")
    f = f.withColumn("era_late", flag(F.year("o_orderdate") >= 2000))
    return rounded(A.rate_by_flags(f, _FLAGS, "y"))


@query("reindex_join", """WITH labels AS (SELECT * FROM (VALUES ('AUTOMOBILE'), ('BUILDING'), ('FURNITURE'),
      ('HOUSEHOLD'), ('MACHINERY'), ('UNKNOWN')) t(c_mktsegment)),
  stats AS (SELECT c_mktsegment, count(*) AS customers, round(avg(c_acctbal), 6) AS avg_acctbal FROM customer GROUP BY 1)
SELECT labels.c_mktsegment, stats.customers, stats.avg_acctbal FROM labels LEFT JOIN stats USING (c_mktsegment)""")
def q_reindex_join(spark, sf):
    """Stats aligned to a fixed label list: a label without rows gets nulls."""
    c = table(spark, sf, "customer")
    stats = c.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("customers"),
                                          F.avg("c_acctbal").alias("avg_acctbal"))
    labels = spark.createDataFrame([(s,) for s in _SEGS + ["UNKNOWN"]], "c_mktsegment string")
    return rounded(A.reindex(labels, stats, "c_mktsegment"))


# --- correlation ------------------------------------------------------------

_CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "qty_noisy", "price_k", "inv_disc", "const"]


def _corr_frame(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        nul("l_orderkey", "l_quantity", 7).alias("l_quantity"), "l_extendedprice",
        nul("l_linenumber", "l_discount", 3).alias("l_discount"), "l_tax",
        (F.col("l_quantity") + uniform(F.col("l_orderkey") * 8 + F.col("l_linenumber"), 5) * 4).alias("qty_noisy"),
        (F.col("l_extendedprice") / 1000).alias("price_k"), (1 - F.col("l_discount")).alias("inv_disc"),
        F.lit(1.0).alias("const"), (F.col("l_returnflag") == "R").cast("int").alias("y"))


_CORR_SRC = f"""(SELECT {nul_sql('l_orderkey', 'l_quantity', 7)} AS l_quantity, l_extendedprice,
    {nul_sql('l_linenumber', 'l_discount', 3)} AS l_discount, l_tax,
    l_quantity + {uniform_sql('l_orderkey * 8 + l_linenumber', 5)} * 4 AS qty_noisy,
    l_extendedprice / 1000 AS price_k, 1 - l_discount AS inv_disc, 1.0 AS const,
    CAST(l_returnflag = 'R' AS INTEGER) AS y FROM lineitem)"""


def _corr_expr(a, b):
    return f"CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE corr({a}, {b}) END"


_CORR_PAIRS = [(a, b) for i, a in enumerate(_CORR_COLS) for b in _CORR_COLS[i + 1:]]


@query("corr_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round({_corr_expr(a, b)}, 6) AS r FROM {_CORR_SRC}"
    for a, b in _CORR_PAIRS))
def q_corr_matrix(spark, sf):
    return rounded(CR.corr_long(_corr_frame(spark, sf), _CORR_COLS))


@query("target_corr", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round({_corr_expr(c, 'y')}, 6) AS r, round(abs({_corr_expr(c, 'y')}), 6) AS abs_r "
    f"FROM {_CORR_SRC}" for c in _CORR_COLS))
def q_target_corr(spark, sf):
    return rounded(CR.target_corr(_corr_frame(spark, sf), _CORR_COLS, "y"))


_PAIRS_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, {_corr_expr(a, b)} AS r FROM {_CORR_SRC}" for a, b in _CORR_PAIRS)


@query("corr_kept")
def q_corr_kept(spark, sf):
    """Every column and whether the greedy pruning at 0.85 keeps it."""
    kept, _ = CR.corr_prune(_corr_frame(spark, sf), _CORR_COLS, 0.85)
    return spark.createDataFrame([(c, int(c in kept.columns)) for c in _CORR_COLS], "feature string, kept int")


@query("corr_prune", f"""WITH p AS ({_PAIRS_SQL}),
  sym AS (SELECT col_a AS c, abs(r) AS ar FROM p UNION ALL SELECT col_b, abs(r) FROM p),
  cent AS (SELECT c, CASE WHEN count(ar) = 0 THEN NULL ELSE (sum(ar) + 1) / (count(ar) + 1) END AS m
           FROM sym GROUP BY c)
SELECT col_a, col_b, round(abs(r), 6) AS abs_r, round(ca.m, 6) AS centrality_a, round(cb.m, 6) AS centrality_b
FROM p JOIN cent ca ON p.col_a = ca.c JOIN cent cb ON p.col_b = cb.c WHERE abs(r) > 0.85""")
def q_corr_prune(spark, sf):
    """Pairs above the threshold with each column's centrality (mean |r|,
    self included) - the input of the greedy drop; the kept list is
    asserted in the unit tests."""
    df = _corr_frame(spark, sf)
    pairs = CR.pair_correlations(df, _CORR_COLS)
    cent = CR.centrality(_CORR_COLS, pairs)
    rows = CR.corr_long(df, _CORR_COLS).where(F.abs("r") > 0.85)
    cexpr = lambda col: _by_name(col, cent)
    return rounded(rows.select("col_a", "col_b", F.abs("r").alias("abs_r"), cexpr("col_a").alias("centrality_a"),
                               cexpr("col_b").alias("centrality_b")))


def _by_name(col, values: dict):
    expr = F.lit(None).cast("double")
    for k, v in values.items():
        expr = F.when(F.col(col) == k, F.lit(v).cast("double")).otherwise(expr)
    return expr


# --- split / class balance ----------------------------------------------------

@query("temporal_split", """SELECT o_orderkey, CASE WHEN year(o_orderdate) < 2000 THEN 'train' ELSE 'test' END AS split
FROM orders WHERE o_orderdate IS NOT NULL""")
def q_temporal_split(spark, sf):
    o = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    train, test = temporal_split(o, "year", 2000)
    return (train.select("o_orderkey", F.lit("train").alias("split"))
            .unionByName(test.select("o_orderkey", F.lit("test").alias("split"))))


@query("split_summary", f"""SELECT CASE WHEN year(o_orderdate) < 2000 THEN 'train' ELSE 'test' END AS split,
       count(*) AS rows, CAST(sum(y) AS BIGINT) AS n_pos, CAST(sum(1 - y) AS BIGINT) AS n_neg,
       round(avg(y), 6) AS pos_share, round(1 - avg(y), 6) AS neg_share, count(DISTINCT o_custkey) AS groups
FROM (SELECT *, {Y_SQL} AS y FROM orders) GROUP BY 1""")
def q_split_summary(spark, sf):
    o = orders_y(spark, sf).withColumn("split", F.when(F.year("o_orderdate") < 2000, "train").otherwise("test"))
    return rounded(A.split_summary(o, "split", "y", "o_custkey"))


@query("imbalance_ratio", """SELECT CAST(sum(CASE WHEN toxic = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n0,
       CAST(sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n1,
       round(sum(CASE WHEN toxic = 0 THEN 1 ELSE 0 END) / greatest(sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END), 1), 6)
         AS imbalance_ratio FROM labels""")
def q_imbalance_ratio(spark, sf):
    return rounded(A.imbalance_ratio(table(spark, sf, "labels"), "toxic"))


# --- star join ------------------------------------------------------------------

def _orders_some_anonymous(spark, sf):
    return with_null_keys(table(spark, sf, "orders"), "o_orderkey", "o_custkey")


@query("star_join", f"""WITH li AS (SELECT l_orderkey, count(l_linenumber) AS line_count,
                    coalesce(sum(l_extendedprice), 0) AS total_price FROM lineitem GROUP BY 1),
  pr AS (SELECT o_orderpriority AS prio, count(*) AS prio_orders FROM orders GROUP BY 1)
SELECT o.o_orderkey, c.c_mktsegment AS c_mktsegment_cu, n.n_name AS n_name_na, r.r_name AS r_name_re,
       li.line_count, round(li.total_price, 6) AS total_price, pr.prio_orders
FROM {with_null_keys_sql('orders', 'o_orderkey', 'o_custkey')} o
LEFT JOIN customer c ON o.o_custkey = c.c_custkey
LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
LEFT JOIN li ON o.o_orderkey = li.l_orderkey
LEFT JOIN pr ON o.o_orderpriority = pr.prio""")
def q_star_join(spark, sf):
    """orders (some without a customer) -> customer -> nation -> region, + lineitem
    rollup + a per-priority table derived from orders; fact row count preserved."""
    o = _orders_some_anonymous(spark, sf)
    cust = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    prio = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("prio")).agg(F.count(F.lit(1)).alias("prio_orders"))
    dims = [
        Dim(cust, "o_custkey", "c_custkey", suffix="_cu"),
        Dim(table(spark, sf, "nation"), "c_nationkey_cu", "n_nationkey", suffix="_na", bounded=True),
        Dim(table(spark, sf, "region"), "n_regionkey_na", "r_regionkey", suffix="_re", bounded=True),
        Dim(table(spark, sf, "lineitem"), "o_orderkey", "l_orderkey",
            rollup={"total_price": "l_extendedprice"}, count_col="l_linenumber", count_name="line_count"),
        Dim(prio, "o_orderpriority", "prio"),
    ]
    out = star_join(o, dims, check_rows=False)
    return rounded(out.select("o_orderkey", "c_mktsegment_cu", "n_name_na", "r_name_re", "line_count", "total_price",
                              "prio_orders"))


_PIPE_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority",
              "c_name_cu", "c_mktsegment_cu", "c_acctbal_cu", "n_name_na", "r_name_re", "total_qty", "total_price",
              "line_count", "lines_missing", "prio_orders"]


@query("star_join_pipeline", f"""WITH li AS (SELECT l_orderkey, coalesce(sum(l_quantity), 0) AS total_qty,
                    coalesce(sum(l_extendedprice), 0) AS total_price, count(l_linenumber) AS line_count
             FROM lineitem WHERE l_orderkey IS NOT NULL GROUP BY 1),
  pr AS (SELECT o_orderpriority AS prio, count(*) AS prio_orders FROM orders GROUP BY 1)
SELECT o.o_orderkey, o.o_custkey, o.o_orderstatus, round(o.o_totalprice, 6) AS o_totalprice, o.o_orderdate,
       o.o_orderpriority, c.c_name AS c_name_cu, c.c_mktsegment AS c_mktsegment_cu,
       round(c.c_acctbal, 6) AS c_acctbal_cu, n.n_name AS n_name_na, r.r_name AS r_name_re,
       round(coalesce(li.total_qty, 0), 6) AS total_qty, round(coalesce(li.total_price, 0), 6) AS total_price,
       coalesce(li.line_count, 0) AS line_count,
       CAST(CASE WHEN li.line_count IS NULL THEN 1 ELSE 0 END AS INTEGER) AS lines_missing, pr.prio_orders
FROM {with_null_keys_sql('orders', 'o_orderkey', 'o_custkey')} o
LEFT JOIN customer c ON o.o_custkey = c.c_custkey
LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
LEFT JOIN li ON o.o_orderkey = li.l_orderkey
LEFT JOIN pr ON o.o_orderpriority = pr.prio""")
def q_star_join_pipeline(spark, sf):
    """The whole wide-table build: customer (null for some orders) -> nation ->
    region, the pre-aggregated lineitem child with its no-lines flag and
    zero fills, and a per-priority table; the fact row count is verified
    (a duplicated dimension key raises instead of silently fanning out)."""
    from ...operators.clean import join_miss_flag_fill
    o = _orders_some_anonymous(spark, sf)
    cust = table(spark, sf, "customer").select(
        "c_custkey", "c_name", "c_mktsegment", "c_acctbal", "c_nationkey")
    prio = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("prio")).agg(F.count(F.lit(1)).alias("prio_orders"))
    dims = [
        Dim(cust, "o_custkey", "c_custkey", suffix="_cu"),
        Dim(table(spark, sf, "nation"), "c_nationkey_cu", "n_nationkey", suffix="_na", bounded=True),
        Dim(table(spark, sf, "region"), "n_regionkey_na", "r_regionkey", suffix="_re", bounded=True),
        Dim(table(spark, sf, "lineitem"), "o_orderkey", "l_orderkey",
            rollup={"total_qty": "l_quantity", "total_price": "l_extendedprice"}, count_col="l_linenumber",
            count_name="line_count"),
        Dim(prio, "o_orderpriority", "prio"),
    ]
    out = join_miss_flag_fill(star_join(o, dims, check_rows=True), "line_count", "lines_missing",
                              ["total_qty", "total_price", "line_count"])
    return rounded(out.select(*_PIPE_COLS))
