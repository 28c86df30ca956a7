"""Scans/sinks, scalar cleaning and data-dependent schema operators."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ...functions import columns as C
from ...functions import parse as P
from ...operators import clean as CL
from ...operators import schema_ops as S
from ...operators.prepare import fit_prepare
from ...session import scratch_path
from ...sources import files
from ...sources.tables import table
from ..registry import query, rounded
from .common import Y_SQL, nul, nul_sql

ORDERS_SCHEMA = ("o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
                 "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING")

# --- sources and sinks ------------------------------------------------------

_ORDERS_SQL = ("SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice, "
               "o_orderdate, o_orderpriority FROM orders")


@query("scan_csv_typed", _ORDERS_SQL)
def q_scan_csv_typed(spark: SparkSession, sf: str):
    """Write orders as CSV under the shared folder, scan back with a declared schema."""
    path = files.write_csv(table(spark, sf, "orders"), scratch_path(spark, "csv"))
    return rounded(files.read_csv_typed(spark, path, ORDERS_SCHEMA))


@query("sink_roundtrip", "SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 6) AS c_acctbal, c_mktsegment "
                         "FROM customer")
def q_sink_roundtrip(spark, sf):
    path = files.write_parquet(table(spark, sf, "customer"), scratch_path(spark, "parquet"))
    return rounded(files.read_parquet(spark, path))


@query("versioned_sink", _ORDERS_SQL.replace("FROM orders", ", 'v2' AS run_ts FROM orders"))
def q_versioned_sink(spark, sf):
    """Two versions appended under run_ts partitions (v1: finished orders
    only, v2: all orders); the latest is read back."""
    path = scratch_path(spark, "versions")
    o = table(spark, sf, "orders")
    files.write_versioned(o.where(F.col("o_orderstatus") == "F"), path, "v1")
    files.write_versioned(o, path, "v2")
    return rounded(files.read_versioned(spark, path, schema=ORDERS_SCHEMA + ", run_ts STRING"))


@query("key_uniqueness", """
SELECT count(*) AS dup_groups, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS extra_rows
FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1)""")
def q_key_uniqueness(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").count().where("count > 1")
    return g.agg(F.count(F.lit(1)).alias("dup_groups"),
                 F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("bigint").alias("extra_rows"))


# --- profile / census -------------------------------------------------------

def _part_nulls(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", nul("p_partkey", "p_name", 5).alias("p_name"), "p_brand",
                    nul("p_partkey", "p_size", 7).alias("p_size"),
                    nul("p_partkey", "p_retailprice", 11).alias("p_retailprice"))


_PART_NULLS_SQL = f"""(SELECT p_partkey, {nul_sql('p_partkey', 'p_name', 5)} AS p_name, p_brand,
   {nul_sql('p_partkey', 'p_size', 7)} AS p_size, {nul_sql('p_partkey', 'p_retailprice', 11)} AS p_retailprice
   FROM part)"""


def _census_sql(cols_types):
    parts = []
    for c, t in cols_types:
        parts.append(f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count(*) AS rows, count({c}) AS non_null, "
                     f"count(*) - count({c}) AS nulls FROM {_PART_NULLS_SQL}")
    return " UNION ALL ".join(parts)


_PART_COLS = [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_size", "int"),
              ("p_retailprice", "double")]


@query("profile_table", _census_sql(_PART_COLS))
def q_profile_table(spark, sf):
    return CL.null_census(_part_nulls(spark, sf))


@query("null_census", f"""SELECT "column", nulls FROM ({_census_sql(_PART_COLS)}) WHERE nulls > 0""")
def q_null_census(spark, sf):
    return CL.null_census(_part_nulls(spark, sf)).where("nulls > 0").select("column", "nulls")


# --- unit-bearing text ------------------------------------------------------

@query("parse_currency", "SELECT o_orderkey, round(o_totalprice, 6) AS price_musd FROM orders")
def q_parse_currency(spark, sf):
    o = table(spark, sf, "orders")
    text = F.concat(F.lit("$"), F.format_number("o_totalprice", 2), F.lit(" million"))
    return rounded(o.select("o_orderkey", P.parse_currency(text).alias("price_musd")))


@query("parse_unit", """SELECT l_orderkey, l_linenumber, round(l_extendedprice, 6) AS thrust_kn,
       round(l_quantity, 6) AS height_m FROM lineitem""")
def q_parse_unit(spark, sf):
    li = table(spark, sf, "lineitem")
    kn = F.concat(F.format_number("l_extendedprice", 2), F.lit(" kN"))
    m = F.concat(F.col("l_quantity").cast("string"), F.lit(" m"))
    return rounded(li.select("l_orderkey", "l_linenumber", P.parse_unit(kn, "kN").alias("thrust_kn"),
                             P.parse_unit(m, "m").alias("height_m")))


@query("parse_percent", """SELECT l_orderkey, l_linenumber, round(round(l_discount * 100, 1) / 100, 6) AS share,
       round(CASE WHEN l_linenumber = 1 THEN NULL ELSE round(l_tax * 100, 1) / 100 END, 6) AS tax_share
FROM lineitem""")
def q_parse_percent(spark, sf):
    li = table(spark, sf, "lineitem")
    pct = F.concat(F.format_number(F.col("l_discount") * 100, 1), F.lit("%"))
    tax = F.when(F.col("l_linenumber") != 1, F.concat(F.format_number(F.col("l_tax") * 100, 1), F.lit(" %"))) \
        .otherwise(F.lit("nan"))
    return rounded(li.select("l_orderkey", "l_linenumber", P.parse_percent(pct).alias("share"),
                             P.parse_percent(tax).alias("tax_share")))


@query("try_numeric", """SELECT o_orderkey,
       round(CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END, 6) AS price,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_custkey END AS cust
FROM orders""")
def q_try_numeric(spark, sf):
    o = table(spark, sf, "orders")
    txt = F.when(F.col("o_orderkey") % 11 == 0, F.lit("bad")).otherwise(F.col("o_totalprice").cast("string"))
    ctxt = F.when(F.col("o_orderkey") % 13 == 0, F.lit("n/a")).otherwise(
        F.concat(F.col("o_custkey").cast("string"), F.lit(".0")))
    return rounded(o.select("o_orderkey", P.try_numeric(txt).alias("price"), P.try_long(ctxt).alias("cust")))


@query("try_timestamp", """SELECT event_id,
       CASE WHEN event_id % 11 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS ts_text,
       CAST(CASE WHEN event_id % 11 = 0 THEN NULL ELSE hour(ts) END AS INTEGER) AS hour
FROM events""")
def q_try_timestamp(spark, sf):
    e = table(spark, sf, "events")
    txt = F.when(F.col("event_id") % 11 == 0, F.lit("bad")).otherwise(
        F.date_format(F.col("ts"), "yyyy-MM-dd HH:mm:ss"))
    parsed = P.try_timestamp(txt)
    return e.select("event_id", F.date_format(parsed, "yyyy-MM-dd HH:mm:ss").alias("ts_text"),
                    F.hour(parsed).alias("hour"))


# --- null handling ----------------------------------------------------------

@query("structural_zero", f"""SELECT c_custkey,
       CAST(coalesce({nul_sql('c_custkey', 'c_nationkey')}, 0) AS INTEGER) AS nationkey_or_zero
FROM customer""")
def q_structural_zero(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", C.structural_zero(nul("c_custkey", "c_nationkey")).alias("nationkey_or_zero"))


@query("constant_fill", f"""SELECT c_custkey, coalesce({nul_sql('c_custkey', 'c_mktsegment')}, 'Unknown') AS segment,
       coalesce({nul_sql('c_custkey', 'c_name', 3)}, 'Unknown') AS name FROM customer""")
def q_constant_fill(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", nul("c_custkey", "c_mktsegment").alias("segment"),
                                            nul("c_custkey", "c_name", 3).alias("name"))
    return CL.constant_fill(c, ["segment", "name", "absent_column"])


@query("sentinel_to_null", """SELECT c_custkey,
       round(CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END, 6) AS acctbal FROM customer""")
def q_sentinel_to_null(spark, sf):
    c = table(spark, sf, "customer")
    coded = F.when(F.col("c_custkey") % 7 == 0, F.lit(-1.0)).otherwise(F.col("c_acctbal"))
    return rounded(c.select("c_custkey", C.sentinel_to_null(coded).alias("acctbal")))


@query("median_impute", f"""WITH c AS (SELECT c_custkey, {nul_sql('c_custkey', 'c_acctbal')} AS x FROM customer)
SELECT c_custkey, round(coalesce(x, (SELECT quantile_cont(x, 0.5) FROM c)), 6) AS acctbal FROM c""")
def q_median_impute(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", nul("c_custkey", "c_acctbal").alias("acctbal"))
    out, _ = CL.median_impute(c, ["acctbal"])
    return rounded(out)


@query("sentinel_flag_fill", f"""SELECT p_partkey,
       round(coalesce({nul_sql('p_partkey', 'p_retailprice', 11)}, -1), 6) AS "Retail Price (USD)",
       CAST(CASE WHEN p_partkey % 11 = 0 THEN 1 ELSE 0 END AS INTEGER) AS "Retail_Price_USD_missing",
       CAST(coalesce({nul_sql('p_partkey', 'p_size', 7)}, -1) AS INTEGER) AS "Size/Count",
       CAST(CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS INTEGER) AS "Size_Count_missing",
       p_size AS "Brand Size"
FROM part""")
def q_sentinel_flag_fill(spark, sf):
    """Flags only for listed columns that actually have nulls; absent names ignored."""
    p = table(spark, sf, "part").select(
        "p_partkey", nul("p_partkey", "p_retailprice", 11).alias("Retail Price (USD)"),
        nul("p_partkey", "p_size", 7).alias("Size/Count"), F.col("p_size").alias("Brand Size"))
    return rounded(CL.sentinel_flag_fill(p, ["Retail Price (USD)", "Size/Count", "Brand Size", "Absent (x)"]))


@query("join_miss_flag_fill_customers", """
SELECT c.c_custkey, CAST(CASE WHEN o.n IS NULL THEN 1 ELSE 0 END AS INTEGER) AS orders_missing,
       coalesce(o.n, 0) AS order_count
FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o
ON c.c_custkey = o.o_custkey""")
def q_join_miss_customers(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey")
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("order_count"))
    j = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").drop("o_custkey")
    return CL.join_miss_flag_fill(j, "order_count", "orders_missing", ["order_count"])


# --- keys, flags, dates -----------------------------------------------------

@query("composite_key", """SELECT CAST(l_orderkey AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR) AS line_id,
       l_partkey FROM lineitem""")
def q_composite_key(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(C.composite_key(["l_orderkey", "l_linenumber"]).alias("line_id"), "l_partkey")


@query("rename_map", """SELECT p_partkey, p_size AS "Size (units)", round(p_retailprice, 6) AS "Retail Price (USD)"
FROM part""")
def q_rename_map(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    return rounded(CL.rename_map(p, {"p_size": "Size (units)", "p_retailprice": "Retail Price (USD)"}))


@query("drop_if_present", "SELECT p_partkey, p_brand, p_size FROM part")
def q_drop_if_present(spark, sf):
    p = table(spark, sf, "part")
    return CL.drop_if_present(p, ["p_name", "p_type", "p_retailprice", "not_a_column"])


@query("binary_target", f"SELECT o_orderkey, {Y_SQL} AS y FROM orders")
def q_binary_target(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", C.binary_target("o_orderstatus", "F").alias("y"))


@query("threshold_flags", f"""WITH o AS (SELECT o_orderkey, {nul_sql('o_orderkey', 'year(o_orderdate)')} AS yr FROM orders)
SELECT o_orderkey, CAST(coalesce(yr < 1998, false) AS INTEGER) AS era_early,
       CAST(coalesce(yr >= 2000, false) AS INTEGER) AS era_late FROM o""")
def q_threshold_flags(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", nul("o_orderkey", F.year("o_orderdate")).alias("yr"))
    return o.select("o_orderkey", C.flag(F.col("yr") < 1998).alias("era_early"),
                    C.flag(F.col("yr") >= 2000).alias("era_late"))


@query("count_flags", """SELECT l_orderkey, l_linenumber,
       CAST(coalesce(l_quantity > 1, false) AS INTEGER) AS is_multistage,
       CAST(coalesce(l_discount > 0, false) AS INTEGER) AS has_strap_ons,
       CAST(coalesce(CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE l_tax END > 0.02, false) AS INTEGER) AS is_multi_payload
FROM lineitem""")
def q_count_flags(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", C.flag(F.col("l_quantity") > 1).alias("is_multistage"),
                     C.flag(F.col("l_discount") > 0).alias("has_strap_ons"),
                     C.flag(nul("l_linenumber", "l_tax", 4) > 0.02).alias("is_multi_payload"))


@query("date_parts", """SELECT event_id, CAST(hour(ts) AS INTEGER) AS launch_hour,
       CAST(month(ts) AS INTEGER) AS launch_month FROM events""")
def q_date_parts(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.hour("ts").alias("launch_hour"), F.month("ts").alias("launch_month"))


@query("decade_bucket", "SELECT o_orderkey, CAST(floor(year(o_orderdate) / 10) * 10 AS BIGINT) AS decade FROM orders")
def q_decade_bucket(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", C.decade(F.year("o_orderdate")).alias("decade"))


@query("orphan_flag", f"""SELECT CAST(CASE WHEN k IS NULL THEN 1 ELSE 0 END AS INTEGER) AS orphan_row, count(*) AS n
FROM (SELECT {nul_sql('l_partkey', 'l_orderkey')} AS k FROM lineitem) GROUP BY ALL""")
def q_orphan_flag(spark, sf):
    li = table(spark, sf, "lineitem").select(nul("l_partkey", "l_orderkey").alias("k"))
    return li.select(C.null_flag("k").alias("orphan_row")).groupBy("orphan_row").agg(F.count(F.lit(1)).alias("n"))


@query("safe_ratio", """WITH x AS (SELECT l_orderkey, l_linenumber,
       CASE WHEN l_orderkey % 7 = 0 THEN -1 ELSE l_extendedprice END AS num,
       CASE WHEN l_linenumber = 1 THEN -1 ELSE l_quantity END AS den FROM lineitem)
SELECT l_orderkey, l_linenumber, round(CASE WHEN num >= 0 AND den > 0 THEN num / den ELSE -1 END, 6) AS price_per_qty
FROM x""")
def q_safe_ratio(spark, sf):
    li = table(spark, sf, "lineitem")
    num = F.when(F.col("l_orderkey") % 7 == 0, F.lit(-1.0)).otherwise(F.col("l_extendedprice"))
    den = F.when(F.col("l_linenumber") == 1, F.lit(-1.0)).otherwise(F.col("l_quantity"))
    return rounded(li.select("l_orderkey", "l_linenumber", C.safe_ratio(num, den).alias("price_per_qty")))


@query("utilisation_ratio", """SELECT l_orderkey, l_linenumber,
       round(CASE WHEN l_discount > 0 AND l_tax > 0 THEN l_discount / l_tax ELSE -1 END, 6) AS utilisation
FROM lineitem""")
def q_utilisation_ratio(spark, sf):
    li = table(spark, sf, "lineitem")
    return rounded(li.select("l_orderkey", "l_linenumber", C.utilisation_ratio("l_discount", "l_tax")
                             .alias("utilisation")))


@query("cyclical_encode", """SELECT event_id,
       round(sin(2 * pi() * month(ts) / 12), 6) AS month_sin, round(cos(2 * pi() * month(ts) / 12), 6) AS month_cos,
       round(sin(2 * pi() * hour(ts) / 24), 6) AS hour_sin, round(cos(2 * pi() * hour(ts) / 24), 6) AS hour_cos
FROM events""")
def q_cyclical_encode(spark, sf):
    e = table(spark, sf, "events")
    ms, mc = C.cyclical(F.month("ts"), 12)
    hs, hc = C.cyclical(F.hour("ts"), 24)
    return rounded(e.select("event_id", ms.alias("month_sin"), mc.alias("month_cos"), hs.alias("hour_sin"),
                            hc.alias("hour_cos")))


_STD_SQL = f"""WITH o AS (SELECT o_orderkey, year(o_orderdate) < 2000 AS is_train,
          {nul_sql('o_orderkey', 'o_totalprice')} AS price,
          CAST(CASE WHEN o_custkey % 9 = 0 THEN -1 ELSE o_custkey % 50 END AS DOUBLE) AS cust_bucket FROM orders),
  m AS (SELECT quantile_cont(price, 0.5) AS mp, quantile_cont(nullif(cust_bucket, -1), 0.5) AS mc
        FROM o WHERE is_train),
  i AS (SELECT o.*, coalesce(price, m.mp) AS pi, coalesce(nullif(cust_bucket, -1), m.mc) AS ci FROM o, m),
  s AS (SELECT avg(pi) AS ap, stddev_pop(pi) AS sp, avg(ci) AS ac, stddev_pop(ci) AS sc FROM i WHERE is_train)
SELECT o_orderkey, round((pi - ap) / CASE WHEN sp = 0 THEN 1 ELSE sp END, 6) AS price,
       round((ci - ac) / CASE WHEN sc = 0 THEN 1 ELSE sc END, 6) AS cust_bucket FROM i, s"""


@query("fit_standardise", _STD_SQL)
def q_fit_standardise(spark, sf):
    """Fit median/mean/population-std on the pre-2000 side, apply to all rows."""
    o = table(spark, sf, "orders").select(
        "o_orderkey", (F.year("o_orderdate") < 2000).alias("is_train"),
        nul("o_orderkey", "o_totalprice").alias("price"),
        F.when(F.col("o_custkey") % 9 == 0, F.lit(-1.0)).otherwise((F.col("o_custkey") % 50).cast("double"))
        .alias("cust_bucket"))
    prep = fit_prepare(o.where("is_train"), ["price", "cust_bucket"], sentinel=["cust_bucket"])
    return rounded(prep.apply(o, keep=["o_orderkey"]))


# --- data-dependent schema --------------------------------------------------

_SEGS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("one_hot", "SELECT c_custkey, " + ", ".join(
    f"CAST(coalesce({nul_sql('c_custkey', 'c_mktsegment')} = '{s}', false) AS INTEGER) AS seg_{s}" for s in _SEGS)
    + " FROM customer")
def q_one_hot(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", nul("c_custkey", "c_mktsegment").alias("segment"))
    return CL.one_hot(c, "segment", "seg", drop=True)


_CONST_COLS = ("c_nationkey", "c_acctbal", "c_mktsegment", "one", "none_col", "flag01")


def _customer_extra(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment", F.lit(1).alias("one"),
                    F.lit(None).cast("double").alias("none_col"), (F.col("c_custkey") % 2).alias("flag01"))


@query("drop_constant", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(count(DISTINCT {c}) <= 1 AS INTEGER) AS dropped FROM "
    "(SELECT *, 1 AS one, CAST(NULL AS DOUBLE) AS none_col, c_custkey % 2 AS flag01 FROM customer)"
    for c in _CONST_COLS))
def q_drop_constant(spark, sf):
    return CL.constant_table(_customer_extra(spark, sf), list(_CONST_COLS)).select("column", "dropped")


_CLS_SRC = """(SELECT o_orderkey, CAST(o_orderkey % 2 AS DOUBLE) AS parity,
   CAST(CASE WHEN o_orderkey % 17 = 0 THEN -1 ELSE o_custkey % 40 END AS DOUBLE) AS cust_mod,
   CAST(CASE WHEN o_orderkey % 17 = 0 THEN -1 ELSE o_totalprice END AS DOUBLE) AS price_s,
   CAST(CASE WHEN o_orderkey % 19 = 0 THEN -2 ELSE o_custkey % 40 END AS DOUBLE) AS below_minus_one,
   CAST(CASE WHEN o_orderkey % 23 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN -1 ELSE 3 END AS DOUBLE) AS with_null,
   CAST(month(o_orderdate) AS DOUBLE) AS launch_month,
   CAST(CASE WHEN o_orderkey % 1000 = 1 THEN 1 ELSE 0 END AS DOUBLE) AS rare01
   FROM orders)"""
_CLS_COLS = ["parity", "cust_mod", "price_s", "below_minus_one", "with_null", "launch_month", "rare01"]


def _cls_frame(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(
        (k % 2).cast("double").alias("parity"),
        F.when(k % 17 == 0, -1).otherwise(F.col("o_custkey") % 40).cast("double").alias("cust_mod"),
        F.when(k % 17 == 0, -1.0).otherwise(F.col("o_totalprice")).alias("price_s"),
        F.when(k % 19 == 0, -2).otherwise(F.col("o_custkey") % 40).cast("double").alias("below_minus_one"),
        F.when(k % 23 == 0, None).when(k % 17 == 0, -1).otherwise(3).cast("double").alias("with_null"),
        F.month("o_orderdate").cast("double").alias("launch_month"),
        F.when(k % 1000 == 1, 1).otherwise(0).cast("double").alias("rare01"))


@query("classify_columns", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column",
       CASE WHEN count(*) FILTER (WHERE {c} IS NOT NULL AND {c} NOT IN (0, 1)) = 0 THEN 'binary'
            WHEN '{c}' IN ('launch_hour', 'launch_month') THEN 'cyclical' ELSE 'continuous' END AS kind,
       CAST(count(*) FILTER (WHERE {c} IS NOT NULL AND {c} NOT IN (0, 1)) > 0 AND '{c}' NOT IN ('launch_hour', 'launch_month')
            AND count(*) FILTER (WHERE {c} = -1) > 0 AND min({c}) >= -1 AND count(*) = count({c}) AS INTEGER) AS sentinel
    FROM {_CLS_SRC}""" for c in _CLS_COLS))
def q_classify_columns(spark, sf):
    return S.classify_columns(_cls_frame(spark, sf), _CLS_COLS)


@query("drop_rare_binary", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", least(count(*) FILTER (WHERE {c} = 0), count(*) FILTER (WHERE {c} = 1)) AS minority,
       CAST(least(count(*) FILTER (WHERE {c} = 0), count(*) FILTER (WHERE {c} = 1)) >= 10 AS INTEGER) AS keep
    FROM {_CLS_SRC}""" for c in ("parity", "rare01")))
def q_drop_rare_binary(spark, sf):
    return S.rare_binary_table(_cls_frame(spark, sf), ["parity", "rare01"], 10)


_IMP_SQL = " UNION ALL ".join(f"SELECT '{c}' AS feature, avg(abs({c})) AS importance, "
                              f"count(DISTINCT {c}) AS nd FROM {_CLS_SRC}" for c in _CLS_COLS)


@query("select_by_variance", f"""WITH imp AS ({_IMP_SQL}),
  ok AS (SELECT *, CASE feature WHEN 'rare01' THEN 0 WHEN 'launch_month' THEN 1 END AS req FROM imp WHERE nd >= 3)
SELECT feature, CAST(row_number() OVER (ORDER BY req ASC NULLS LAST, importance DESC, feature) - 1 AS INTEGER) AS position
FROM ok QUALIFY position < 4""")
def q_select_by_variance(spark, sf):
    """Requested features first when varied enough (rare01 is not), then by mean |value|."""
    df = _cls_frame(spark, sf)
    imp = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.abs(F.col(c)).alias("a")) for c in _CLS_COLS])).alias("s")) \
        .groupBy("s.feature").agg(F.avg("s.a").alias("importance"))
    return S.select_by_variance(df, imp, ["rare01", "launch_month"], 4)
