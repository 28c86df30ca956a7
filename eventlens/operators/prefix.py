"""Skew-safe running totals, ranks and exact quantiles.

A window ``PARTITION BY entity ORDER BY t`` sends every row of one entity to
one task; a window with no partition sends the whole table to one task. If
one entity holds a third of the rows, that task holds a third of the data.

``running_totals`` avoids this with a two-level prefix sum:

1. range-partition all rows on the ordering into ``B`` blocks (Spark samples
   the full multi-column key, so blocks stay balanced even under heavy ties
   on the first column) and record the block id. The tagged rows are written
   once to the shared checkpoint folder so the block ids are fixed for every
   later branch of the plan (a recomputed range exchange could re-sample);
2. per (entity, block) totals - an ordinary aggregate with map-side combine;
3. per entity, the prefix of those totals over blocks - at most ``B`` rows per
   entity;
4. join the offsets back on (entity, block) and finish with a local window
   ``PARTITION BY entity, block`` whose groups are at most one block.

The plan is the same at every size. There are as many blocks as
``spark.sql.shuffle.partitions``, the setting that follows the size of the
data, so no pass counts rows first. ``running_totals_by_key`` does all this
for the heavy keys alone, those with more rows than a block; for the others a
window per key costs a third of the exchanges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

_BLK = "_el_blk"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def n_blocks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def running_totals(
    df: DataFrame,
    order: Sequence[str | Column],
    values: Sequence[str] = (),
    partition_by: Sequence[str] = (),
    inclusive: bool = False,
    count_name: str = "prior_n",
    prefix: str = "prior_",
    blocks: int | None = None,
    few_keys: bool = False,
) -> DataFrame:
    """Add the count of earlier rows and the sums of ``values`` over them.

    ``order`` must be a total order inside each partition (end it with a
    unique tie-break column); rows are "earlier" in that order. With
    ``inclusive=True`` the current row is counted too. Sums of nothing are 0.
    Output columns: ``count_name`` (long) and ``prefix + v`` per value.
    ``few_keys`` says that there are at most as many entities as blocks: then
    the offsets are broadcast, and rows move once after the blocks are written.
    """
    order = [_col(o) for o in order]
    part = list(partition_by)
    end = Window.currentRow if inclusive else -1
    blocks = blocks or n_blocks(df)

    def local(frame_df: DataFrame, keys: list, offsets: dict[str, Column]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
        cols = {count_name: (F.count(F.lit(1)).over(w) + offsets.get(count_name, F.lit(0))).cast("bigint")}
        for v in values:
            s = F.coalesce(F.sum(v).over(w), F.lit(0))
            cols[prefix + v] = s + offsets.get(prefix + v, F.lit(0))
        return frame_df.withColumns(cols)

    tagged = materialize(
        df.repartitionByRange(blocks, *order).withColumn(_BLK, F.spark_partition_id()), "blocks"
    )
    tot = tagged.groupBy(*part, _BLK).agg(
        F.count(F.lit(1)).alias("_el_n"), *[F.sum(v).alias(f"_el_s_{i}") for i, v in enumerate(values)]
    )
    wb = Window.partitionBy(*part).orderBy(_BLK).rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(
        *[F.col(p).alias(f"_el_k_{i}") for i, p in enumerate(part)],
        F.col(_BLK).alias("_el_kb"),
        F.coalesce(F.sum("_el_n").over(wb), F.lit(0)).alias("_el_on"),
        *[F.coalesce(F.sum(f"_el_s_{i}").over(wb), F.lit(0)).alias(f"_el_os_{i}") for i in range(len(values))],
    )
    cond = F.col(_BLK) == F.col("_el_kb")
    for i, p in enumerate(part):
        cond = cond & F.col(p).eqNullSafe(F.col(f"_el_k_{i}"))
    offsets = {count_name: F.col("_el_on")}
    for i, v in enumerate(values):
        offsets[prefix + v] = F.col(f"_el_os_{i}")
    if few_keys:
        # at most blocks x blocks offsets
        joined = local(tagged, part + [_BLK], {}).join(F.broadcast(offs), cond, "inner")
        out = joined.withColumns({c: F.col(c) + offset for c, offset in offsets.items()})
    else:
        out = local(tagged.join(offs, cond, "inner"), part + [_BLK], offsets)
    drop = [_BLK, "_el_kb", "_el_on"] + [f"_el_k_{i}" for i in range(len(part))]
    drop += [f"_el_os_{i}" for i in range(len(values))]
    return out.drop(*drop)


def running_totals_by_key(
    df: DataFrame,
    order: Sequence[str | Column],
    values: Sequence[str],
    key: str,
    count_name: str = "prior_n",
    prefix: str = "prior_",
    blocks: int | None = None,
) -> DataFrame:
    """:func:`running_totals` (earlier rows only) for a key of many values.

    A key value with more rows than a block has on average is split over the
    blocks; there are fewer such values than blocks. The rows of any other value
    are at most a block, so they meet in one task, in one exchange and without
    being written. Where there are both, the rows are written once and each side
    takes its own.
    """
    blocks = blocks or n_blocks(df)
    n = df.count()
    sizes = df.groupBy(F.col(key).alias("_el_key")).agg(F.count(F.lit(1)).alias("_el_size"))
    heavy = materialize(sizes.where(F.col("_el_size") > F.lit(n / blocks)), "heavy")
    at = heavy.agg(F.coalesce(F.sum("_el_size"), F.lit(0)).alias("rows")).first()["rows"]

    def split(rows: DataFrame) -> DataFrame:
        return running_totals(rows, order, values, [key], False, count_name, prefix, blocks, few_keys=True)

    def whole(rows: DataFrame) -> DataFrame:
        w = Window.partitionBy(key).orderBy(*[_col(o) for o in order]).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumns({count_name: F.count(F.lit(1)).over(w),
                                 **{prefix + v: F.coalesce(F.sum(v).over(w), F.lit(0)) for v in values}})

    if not at:
        return whole(df)
    if at == n:
        return split(df)
    rows = materialize(df, "rows")
    keys, same = F.broadcast(heavy.select("_el_key")), F.col(key).eqNullSafe(F.col("_el_key"))  # fewer rows than blocks
    return split(rows.join(keys, same, "left_semi")).unionByName(whole(rows.join(keys, same, "left_anti")))


def global_rank(df: DataFrame, order: Sequence[str | Column], name: str = "rank",
                partition_by: Sequence[str] = (), blocks: int | None = None) -> DataFrame:
    """0-based row number in ``order`` (a total order), without a one-task window."""
    out = running_totals(df, order, (), partition_by, inclusive=False, count_name=name,
                         blocks=blocks)
    return out


def quantile_frame(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                   blocks: int | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles (pandas / ``quantile_cont``) as a
    lazy DataFrame ``(name, qi, q, value)``; ``qi`` indexes ``probs``.

    No group of values is gathered in one place: values are counted per
    distinct value (map-side combine), cumulative positions come from
    :func:`running_totals`, and each row is matched against the target
    positions ``floor/ceil(q * (n - 1))`` of its column - a broadcast table
    of ``len(cols) * len(probs)`` rows. Only the <= 2 rows around each
    target survive; the interpolation runs in Spark.
    """
    long = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in cols]))
        .alias("kv")
    ).select("kv.name", "kv.v").where(F.col("v").isNotNull() & ~F.isnan("v"))
    vc = materialize(long.groupBy("name", "v").agg(F.count(F.lit(1)).alias("c")), "values")  # read three times below
    cum = running_totals(vc, [F.col("v").asc()], ["c"], ["name"], count_name="_k",
                         blocks=blocks)
    pos = F.col("_q") * (F.col("_n") - 1)
    targets = vc.groupBy(F.col("name").alias("_name")).agg(F.sum("c").alias("_n")).select(
        "_name", "_n", F.explode(F.array(*[F.struct(F.lit(i).alias("qi"), F.lit(float(q)).alias("_q"))
                                           for i, q in enumerate(probs)])).alias("t")).select(
        "_name", "_n", "t.qi", "t._q", pos.alias("_pos"), F.floor(pos).alias("_lo"), F.ceil(pos).alias("_hi"))

    def covers(t):
        return (F.col("prior_c") <= F.col(t)) & (F.col(t) < F.col("prior_c") + F.col("c"))

    # bounded by len(cols) * len(probs) rows: broadcast
    hit = cum.join(F.broadcast(targets), (F.col("name") == F.col("_name")) & (covers("_lo") | covers("_hi")))
    g = hit.groupBy("name", "qi", "_q", "_pos", "_lo").agg(
        F.max(F.when(covers("_lo"), F.col("v"))).alias("_a"), F.max(F.when(covers("_hi"), F.col("v"))).alias("_b"))
    return g.select("name", "qi", F.col("_q").alias("q"),
                    (F.col("_a") + (F.col("_pos") - F.col("_lo")) * (F.col("_b") - F.col("_a"))).alias("value"))


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                    blocks: int | None = None) -> dict[str, list[float | None]]:
    """:func:`quantile_frame` collected: ``{column: [value per prob]}``
    (``None`` for a column without values); at most len(cols) * len(probs)
    numbers reach the driver."""
    out: dict[str, list[float | None]] = {c: [None] * len(probs) for c in cols}
    for r in quantile_frame(df, cols, probs, blocks).collect():
        out[r["name"]][r["qi"]] = r["value"]
    return out


def exact_median(df: DataFrame, col: str) -> float | None:
    return exact_quantiles(df, [col], [0.5])[col][0]
