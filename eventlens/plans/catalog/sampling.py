"""Resampling, neighbours and baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.rng import uniform_sql
from ...operators import sampling as S
from ...operators.knn import knn_join
from ...sources.tables import table
from ..registry import query, rounded
from ..training import balanced_weight, fit_majority, fit_prior
from .common import Y_SQL, orders_y

_EMB_MIN_SQL = "(SELECT vec_id, embedding FROM embeddings WHERE label = 0)"

_DIST_SQL = """e AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS i
            FROM embeddings WHERE label = 0),
  d AS (SELECT a.vec_id, b.vec_id AS nn_id, round(sum((a.v - b.v) * (a.v - b.v)), 6) AS dist2
        FROM e a JOIN e b ON a.i = b.i AND a.vec_id <> b.vec_id GROUP BY 1, 2),
  nn AS (SELECT vec_id, nn_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY dist2, nn_id) AS INTEGER) AS rank,
                dist2 FROM d QUALIFY rank <= 5)"""


@query("knn_join", f"WITH {_DIST_SQL.replace(' WHERE label = 0', '')} SELECT * FROM nn")
def q_knn_join(spark, sf):
    """5 nearest neighbours of every embedding (exact, pruned blocks)."""
    e = table(spark, sf, "embeddings")
    return knn_join(e, e, "vec_id", "embedding", 5)


def _smote_n_sql(ratio=0.3):
    return (f"(SELECT CAST(floor({ratio} * count(*) FILTER (WHERE label <> 0)) AS BIGINT) "
            f"- count(*) FILTER (WHERE label = 0) FROM embeddings)")


@query("smote", f"""WITH {_DIST_SQL},
  mn AS (SELECT vec_id, embedding, row_number() OVER (ORDER BY vec_id) - 1 AS idx, count(*) OVER () AS n FROM {_EMB_MIN_SQL}),
  s AS (SELECT unnest(range(cnt)) AS sample_id FROM (SELECT {_smote_n_sql()} AS cnt)),
  draw AS (SELECT sample_id, CAST(floor({uniform_sql('sample_id', 42)} * (SELECT max(n) FROM mn)) AS BIGINT) AS idx,
                  CAST(floor({uniform_sql('sample_id', 43)} * 5) + 1 AS INTEGER) AS rank, {uniform_sql('sample_id', 44)} AS gap FROM s),
  j AS (SELECT draw.*, mn.vec_id AS base_id, nn.nn_id FROM draw JOIN mn USING (idx) JOIN nn ON nn.vec_id = mn.vec_id AND nn.rank = draw.rank),
  v AS (SELECT j.sample_id, j.base_id, j.nn_id, j.gap, x.i,
               x.v + j.gap * (z.v - x.v) AS nv
        FROM j JOIN e x ON x.vec_id = j.base_id JOIN e z ON z.vec_id = j.nn_id AND z.i = x.i)
SELECT sample_id, base_id, nn_id, round(gap, 6) AS gap, round(sum(nv), 6) AS v_sum,
       round(max(nv) FILTER (WHERE i = 1), 6) AS v_first
FROM v GROUP BY sample_id, base_id, nn_id, gap""")
def q_smote(spark, sf):
    """Synthetic minority embeddings to a 0.3 minority/majority ratio."""
    e = table(spark, sf, "embeddings")
    counts = {r["m"]: r["n"] for r in e.groupBy((F.col("label") == 0).alias("m")).count()
              .withColumnRenamed("count", "n").collect()}
    n_new = S.smote_count(counts.get(True, 0), counts.get(False, 0), 0.3)
    out = S.smote(e.where("label = 0"), "vec_id", "embedding", n_new, k=5, seed=42)
    return rounded(out.select("sample_id", "base_id", "nn_id", "gap",
                              F.aggregate("embedding", F.lit(0.0), lambda a, b: a + b).alias("v_sum"),
                              F.element_at("embedding", 1).alias("v_first")))


@query("undersample", f"""WITH o AS (SELECT o_orderkey, {Y_SQL} AS y FROM orders),
  c AS (SELECT count(*) FILTER (WHERE y = 1) AS n1, count(*) FILTER (WHERE y = 0) AS n0 FROM o),
  maj AS (SELECT o_orderkey, y, row_number() OVER (ORDER BY {uniform_sql('o_orderkey', 42)}, o_orderkey) - 1 AS r
          FROM o WHERE y = CASE WHEN (SELECT n1 FROM c) <= (SELECT n0 FROM c) THEN 0 ELSE 1 END)
SELECT o_orderkey, y FROM o WHERE y = CASE WHEN (SELECT n1 FROM c) <= (SELECT n0 FROM c) THEN 1 ELSE 0 END
UNION ALL SELECT o_orderkey, y FROM maj WHERE r < (SELECT least(n1, n0) FROM c)""")
def q_undersample(spark, sf):
    o = orders_y(spark, sf).select("o_orderkey", "y")
    return S.undersample(o, "y", "o_orderkey", seed=42)


@query("permute_column", f"""WITH o AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS ri,
                  row_number() OVER (ORDER BY {uniform_sql('o_orderkey', 42)}, o_orderkey) - 1 AS h FROM orders)
SELECT a.o_orderkey, round(b.o_totalprice, 6) AS o_totalprice FROM o a JOIN o b ON a.h = b.ri""")
def q_permute_column(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return rounded(S.permute_column(o, "o_totalprice", "o_orderkey", seed=42).select("o_orderkey", "o_totalprice"))


@query("background_sample", f"""SELECT o_orderkey, CAST(row_number() OVER (ORDER BY {uniform_sql('o_orderkey', 42)}, o_orderkey) - 1
  AS INTEGER) AS bg_idx FROM orders QUALIFY bg_idx < 500""")
def q_background_sample(spark, sf):
    """The 500-row background for Shapley values (the limit is the operator)."""
    from ..explain import background_sample
    from ...functions.rng import uniform
    o = table(spark, sf, "orders").select("o_orderkey")
    return background_sample(o, "o_orderkey", 500, 42, uniform=uniform).select(
        "o_orderkey", "bg_idx")


@query("balanced_weights", """WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE toxic = 1) AS n1 FROM labels)
SELECT doc_id, toxic, round(CASE WHEN toxic = 1 THEN n / (2.0 * n1) ELSE n / (2.0 * (n - n1)) END, 6) AS w
FROM labels, c""")
def q_balanced_weights(spark, sf):
    return rounded(balanced_weight(table(spark, sf, "labels"), "toxic").select("doc_id", "toxic", "w"))


# --- naive baselines (labels split by doc_id parity: even = train) --------------

@query("baseline_majority", """WITH tr AS (SELECT avg(quality) AS p FROM labels WHERE doc_id % 2 = 0)
SELECT doc_id, round(p, 6) AS p, CAST(p >= 0.5 AS INTEGER) AS native_pred FROM labels, tr WHERE doc_id % 2 = 1""")
def q_baseline_majority(spark, sf):
    lab = table(spark, sf, "labels")
    m = fit_majority(lab.where("doc_id % 2 = 0"), "quality")
    return rounded(m.score(lab.where("doc_id % 2 = 1").select("doc_id")))


@query("baseline_prior", f"""WITH tr AS (SELECT avg(quality) AS p FROM labels WHERE doc_id % 2 = 0)
SELECT doc_id, round(p, 6) AS p, CAST({uniform_sql('doc_id', 42)} < p AS INTEGER) AS native_pred
FROM labels, tr WHERE doc_id % 2 = 1""")
def q_baseline_prior(spark, sf):
    from ...functions.rng import uniform
    lab = table(spark, sf, "labels")
    m = fit_prior(lab.where("doc_id % 2 = 0"), "quality", id_col="doc_id", seed=42)
    m.uniform = uniform
    return rounded(m.score(lab.where("doc_id % 2 = 1").select("doc_id")))
