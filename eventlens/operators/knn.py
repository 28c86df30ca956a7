"""Exact k-nearest-neighbour join with pruned blocks.

1. Rows of equal vectors are pairwise at distance 0, so of each distinct
   vector the reference side keeps its ``k + 1`` smallest ids (no other can be
   among the nearest) and the query side is asked once.
2. Pivots are a bounded sample of the reference vectors. Each reference row is
   in the cell of its nearest pivot; a cell is ordered by distance to the
   pivot and cut into blocks of ``block_rows``, so a block is a ring around
   its pivot.
3. First round: every query searches one block, the ring of its own cell that
   is nearest to it. Its k-th distance there is an upper bound.
4. Second round: a query goes to those blocks only that can hold a nearer row.
   By the triangle inequality a row of a ring is at least ``d - outer`` and
   ``inner - d`` away, and a row of another cell lies beyond the plane between
   the two pivots.

Each (block, chunk of queries) is one cogroup task that computes distances with
numpy, ``AT_ONCE`` at a time, and keeps each query's ``k`` best candidates (ties
by rounded distance, then id): pairs are computed, never emitted as rows, and a
task holds ``block_rows`` rows of both sides. Nothing is broadcast but the
pivots, rings and visits of blocks: routes and neighbours are small as files, but
not in the memory of the driver that would build their broadcast, so tables that
grow with the queries meet by sort and merge. On data without clusters no block can be ruled out, and the work is
that of all pairs of blocks.

Rows with a null vector have no neighbours and are none.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rng import hash_uniform
from ..session import materialize
from .prefix import global_rank

BLOCK_ROWS = 4096
#: Most pivots (they are the bounded sample), and how many there are for a block's rows.
MAX_PIVOTS, PIVOTS_A_BLOCK = 1024, 4
#: Distances (8 bytes each, a few times over) that a task holds at a time.
AT_ONCE = 1 << 20
#: Pairs of a query and a pivot in one batch of routes.
ROUTES_AT_ONCE = 1 << 17


def _nearest(q: np.ndarray, r: np.ndarray, qid: np.ndarray, rid: np.ndarray, k: int, digits: int) -> pd.DataFrame:
    """The ``k`` best of ``r`` for every row of ``q``, by (rounded exact
    squared distance, id). ``AT_ONCE`` distances are held at a time."""
    if not len(q) or not len(r):
        return pd.DataFrame({"qid": np.zeros(0, np.int64), "nn_id": np.zeros(0, np.int64), "dist2": np.zeros(0)})
    # distances do not change when both sides move; around the block's mean the products cancel least
    middle = r.mean(axis=0)
    b = r - middle
    bb, step = (b * b).sum(1), max(1, AT_ONCE // len(r))
    return pd.concat([_nearest_of(q[i : i + step], q[i : i + step] - middle, r, b, bb, qid[i : i + step], rid, k, digits) for i in range(0, len(q), step)], ignore_index=True)


def _nearest_of(q: np.ndarray, a: np.ndarray, r: np.ndarray, b: np.ndarray, bb: np.ndarray, qid: np.ndarray, rid: np.ndarray, k: int, digits: int) -> pd.DataFrame:
    """``_nearest`` of some queries; ``a`` and ``b`` are both sides around the
    block's mean."""
    aa = (a * a).sum(1)
    d = aa[:, None] + bb[None, :] - 2.0 * a @ b.T
    kk = min(k, len(r))
    # candidates within the rounding error of the k-th distance, and half a
    # unit of the rounded key; their distances are then recomputed exactly
    error = 8 * np.finfo(float).eps * (q.shape[1] + 2) * (aa + bb.max()) + 10.0 ** -digits
    kth = np.partition(d, kk - 1, axis=1)[:, kk - 1]
    rows_q, cols_r = np.nonzero(d <= (kth + 2 * error)[:, None])
    key = np.round(((q[rows_q] - r[cols_r]) ** 2).sum(1), digits)
    order = np.lexsort((rid[cols_r], key, rows_q))
    rows_q, cols_r, key = rows_q[order], cols_r[order], key[order]
    pos = np.arange(rows_q.size)
    first = np.r_[True, rows_q[1:] != rows_q[:-1]]
    sel = pos - np.maximum.accumulate(np.where(first, pos, 0)) < k
    return pd.DataFrame({"qid": qid[rows_q][sel], "nn_id": rid[cols_r][sel], "dist2": key[sel]})


def _search(routed: DataFrame, blocks: DataFrame, k: int, block_rows: int, digits: int) -> DataFrame:
    """Candidates (qid, nn_id, dist2) of queries (qid, qv, cell, sub) in their
    blocks. A block that very many queries visit is searched in chunks."""
    visits = routed.groupBy(F.col("cell").alias("_c"), F.col("sub").alias("_s")).agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias("chunks"))
    visits = materialize(visits, "knn-visits")
    here = (F.col("cell") == F.col("_c")) & (F.col("sub") == F.col("_s"))
    left = routed.join(visits, here).select("qid", "qv", "cell", "sub", F.pmod(F.xxhash64("qid"), F.col("chunks")).cast("int").alias("chunk"))
    right = blocks.join(visits, here).select("rid", "rv", "cell", "sub", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    key = ("cell", "sub", "chunk")

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        found = _nearest(_rows(a.column("qv")), _rows(b.column("rv")), a.column("qid").to_numpy(), b.column("rid").to_numpy(), k, digits)
        return pa.Table.from_pandas(found, preserve_index=False)

    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, "qid long, nn_id long, dist2 double")


def _rows(vectors: pa.ChunkedArray) -> np.ndarray:
    """A list column as a matrix, without an object for each row."""
    sizes = pc.unique(pc.list_value_length(vectors)).to_pylist()
    if len(sizes) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(sizes)[:2]}")
    values = pc.list_flatten(vectors).to_numpy().astype(float, copy=False)
    return values.reshape(len(vectors), sizes[0] if sizes else 0)


def _to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows to all pivots (exact differences, in slices)."""
    out = np.empty((len(x), len(pivots)))
    for j, p in enumerate(pivots):
        out[:, j] = np.sqrt(((x - p) ** 2).sum(1))
    return out


def index_blocks(ref: DataFrame, n_pivots: int, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(rid, rv) rows with their block (``cell``, ``sub``); the ring of each
    block (``inner``, ``outer``); the pivots."""
    sample = ref.orderBy(hash_uniform("rid"), "rid").limit(n_pivots).select("rv").collect()  # the sampling operator; at most MAX_PIVOTS rows
    pivots = np.unique(np.array([r["rv"] for r in sample], float), axis=0)

    def assign(frames):
        for f in frames:
            d = _to_pivots(np.vstack(f["rv"].to_numpy()), pivots) if len(f) else np.zeros((0, len(pivots)))
            cell = d.argmin(axis=1)
            yield f.assign(cell=cell.astype("int32"), dist=d[np.arange(len(f)), cell])

    cells = ref.mapInPandas(assign, "rid long, rv array<double>, cell int, dist double")
    ranked = global_rank(cells, [F.col("cell"), F.col("dist"), F.col("rid")], "_rk", partition_by=["cell"])
    blocks = materialize(ranked.select("rid", "rv", "cell", F.expr(f"_rk div {block_rows}").alias("sub"), "dist"), "knn-blocks")
    rings = materialize(blocks.groupBy("cell", "sub").agg(F.min("dist").alias("inner"), F.max("dist").alias("outer")), "knn-rings")
    return blocks.drop("dist"), rings, pivots


def first_blocks(query: DataFrame, rings: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Each query with the nearest ring of its own cell."""
    def own(frames):
        for f in frames:
            d = _to_pivots(np.vstack(f["qv"].to_numpy()), pivots) if len(f) else np.zeros((0, len(pivots)))
            cell = d.argmin(axis=1)
            yield f.assign(qc=cell.astype("int32"), qd=d[np.arange(len(f)), cell])

    q = query.mapInPandas(own, "qid long, qv array<double>, qc int, qd double")
    off = F.greatest(F.col("qd") - F.col("outer"), F.col("inner") - F.col("qd"), F.lit(0.0))
    return q.join(rings, F.col("qc") == F.col("cell")).groupBy("qid").agg(
        F.first("qv").alias("qv"), F.first("cell").alias("cell"), F.min_by("sub", F.struct(off, "sub")).alias("sub"))


def further_blocks(query: DataFrame, rings: DataFrame, pivots: np.ndarray, digits: int = 6) -> DataFrame:
    """Queries (qid, qv, ``reach``: upper bound of the k-th distance, and the
    block they have searched): the other blocks (qid, cell, sub) that may hold
    a row within reach. Where little can be ruled out these are many rows for
    each query, so they come without its vector and a slice of queries at a
    time."""
    outer = {r["cell"]: r["o"] for r in rings.groupBy("cell").agg(F.max("outer").alias("o")).collect()}  # a row a pivot
    edge = np.array([outer.get(c, -np.inf) for c in range(len(pivots))])
    apart = _to_pivots(pivots, pivots)

    def route(frames):
        step = max(1, ROUTES_AT_ONCE // max(1, len(pivots)))
        for whole in frames:
            for f in (whole.iloc[at : at + step] for at in range(0, len(whole), step)):
                d = _to_pivots(np.vstack(f["qv"].to_numpy()), pivots)
                own = d.argmin(axis=1)
                nearest = d[np.arange(len(f)), own]
                gap = apart[own]  # rows lie on their pivot's side of the plane between two pivots
                with np.errstate(divide="ignore", invalid="ignore"):
                    plane = np.where(gap > 0, (d**2 - (nearest**2)[:, None]) / (2 * gap), 0.0)
                least = np.maximum(d - edge[None, :], plane)
                slack = f["reach"].to_numpy()[:, None] * (1 + 1e-9) + 1e-9 * (1 + d)  # of the rounded bounds
                i, c = np.nonzero((least <= slack) & np.isfinite(edge)[None, :])
                yield pd.DataFrame({"qid": f["qid"].to_numpy()[i], "qc": c.astype("int32"), "qd": d[i, c], "far": slack[i, c],
                                    "done_cell": f["cell"].to_numpy()[i], "done_sub": f["sub"].to_numpy()[i]})

    q = query.select("qid", "qv", "cell", "sub", "reach").mapInPandas(route, "qid long, qc int, qd double, far double, done_cell int, done_sub long")
    may = (F.col("qd") - F.col("outer") <= F.col("far")) & (F.col("inner") - F.col("qd") <= F.col("far"))
    done = (F.col("cell") == F.col("done_cell")) & (F.col("sub") == F.col("done_sub"))
    return q.join(rings, F.col("qc") == F.col("cell")).where(may & ~done).select("qid", "cell", "sub")


def knn_join(query: DataFrame, ref: DataFrame, id_col: str, vec_col: str, k: int = 5, exclude_self: bool = True,
             block_rows: int = BLOCK_ROWS, digits: int = 6, sizes: tuple[int, int] | None = None) -> DataFrame:
    """(id, nn_id, rank, dist2): the ``k`` nearest reference rows of every
    query row by squared Euclidean distance; ties by (rounded distance, id).
    ``sizes`` = (query rows, reference rows) when already known."""
    need = k + int(exclude_self)
    vec = F.col(vec_col).cast("array<double>")
    asked = query.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("qid"), vec.alias("qv"))
    ids = Window.partitionBy("rv").orderBy("rid")
    refs = ref.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("rid"), vec.alias("rv"))
    refs = materialize(refs.withColumn("_n", F.row_number().over(ids)).where(F.col("_n") <= need).drop("_n"), "knn-refs")
    n = sizes[1] if sizes is not None else refs.count()
    texts = materialize(asked.groupBy("qv").agg(F.min("qid").alias("vid")), "knn-queries")
    distinct = texts.select(F.col("vid").alias("qid"), "qv")
    if n <= block_rows:  # one block: the first round has seen every row
        only = [F.lit(0).alias("cell"), F.lit(0).cast("bigint").alias("sub")]
        found = _search(distinct.select("qid", "qv", *only), refs.select("rid", "rv", *only), need, block_rows, digits)
    else:
        blocks, rings, at = index_blocks(refs, min(MAX_PIVOTS, PIVOTS_A_BLOCK * math.ceil(n / block_rows)), block_rows)
        first = materialize(first_blocks(distinct, rings, at), "knn-first")
        near = materialize(_search(first, blocks, need, block_rows, digits), "knn-near")
        # the key is rounded: rows up to one unit of it further away may tie
        reach = F.sqrt(F.max("dist2") + F.lit(2 * 10.0**-digits))
        bound = near.groupBy(F.col("qid").alias("_q")).agg(F.when(F.count(F.lit(1)) >= need, reach).otherwise(F.lit(float("inf"))).alias("reach"))
        more = materialize(further_blocks(first.join(bound.hint("merge"), F.col("qid") == F.col("_q")), rings, at, digits), "knn-routes")
        found = near.unionByName(_search(more.hint("merge").join(distinct, "qid"), blocks, need, block_rows, digits))
    best = Window.partitionBy("qid").orderBy("dist2", "nn_id")  # need rows a visited block
    found = materialize(found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= need).select(F.col("qid").alias("vid"), "nn_id", "dist2"), "knn-found")
    every = asked.join(texts.hint("merge"), "qv").select("qid", "vid").join(found.hint("merge"), "vid")
    if exclude_self:
        every = every.where("nn_id <> qid")
    w = Window.partitionBy("qid").orderBy("dist2", "nn_id")  # need rows
    return (every.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k)
            .select(F.col("qid").alias(id_col), "nn_id", "rank", "dist2"))
