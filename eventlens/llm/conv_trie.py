"""Prefix trie of conversations by ROLLUP (operator 12).

A node of depth d is a distinct sequence of first d turns. The turns of a
conversation are laid out in positional columns, ``SLOTS`` to a row; one
``GROUP BY block, key, ROLLUP (t1, ..., t4)`` makes the groups of all prefixes
of all blocks at once, and ``grouping_id`` tells their depth. A row's key is
the node at which the conversation's earlier blocks end: the XOR of 128-bit
hashes of (position, turn), a running aggregate, so the blocks of a long
conversation do not wait for each other and depth costs no rounds.

What a node needs from its whole subtree comes from a second ROLLUP. A node is
known by its smallest member, its representative, and its depth. A node below
v has its representative among v's members, so sums over v's subtree are sums
over v's members of what each represents; only v's own representative also
represents ancestors of v, and those are taken off by a running sum along it.

Hot prefixes are combined before each shuffle. A conversation that holds a
third of all rows is numbered in ranges of (conversation, turn), and its
running aggregates go over strides of blocks, then inside each stride.

The digest of the ids that end at a node is sequential by its definition: the
ids arrive sorted and are hashed as they go by, so a task holds one batch.

Defined cases: null role or text is empty; null turns come first; rows of equal
turn are ordered by the md5 of role and text, repeated rows stay; a null id is
a conversation of its own, which represents a node only alone and is left out
of the digests; an empty table has no node, not even a root; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.prefix import running_totals
from ..session import materialize

#: Positional columns of a block.
SLOTS = 4
#: Blocks, or depths, of one conversation in one window.
STRIDE = 4096
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_id(role: Column, text: Column) -> Column:
    """md5 of role and text; the role's length keeps them apart."""
    return F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))


def number_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One narrow row per turn: ``conv_id``, ``ord`` (from 1), ``id`` (16
    bytes) and ``chars`` (code points of the text)."""
    r, x = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), turn_id(r, x).alias("id"), F.char_length(x).cast("bigint").alias("chars"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("id")]
    numbered = running_totals(rows, order, partition_by=["conv_id"], inclusive=True, count_name="ord")
    return numbered.select("conv_id", "ord", F.unhex("id").alias("id"), "chars")


def _before(df: DataFrame, keys: Sequence[str], position: str, values: dict[str, str]) -> DataFrame:
    """Add for each ``name: aggregate`` of ``values`` the aggregate over all
    rows of the same keys at smaller positions (null: none). Strides first,
    then inside a stride."""
    stride = F.expr(f"{position} div {STRIDE}L")
    rows = df.withColumn("_s", stride)
    far = rows.groupBy(*keys, "_s").agg(*[F.expr(a).alias(f"_v_{n}") for n, a in values.items()])
    upto = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys, "_s").orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    over = {n: a.split("(")[0] for n, a in values.items()}
    far = far.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_s").alias("_fs"),
                     *[F.expr(f"{f}(_v_{n})").over(upto).alias(f"_f_{n}") for n, f in over.items()])
    on = F.col("_s") == F.col("_fs")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out = rows.join(far, on)
    plus = {"sum": lambda a, b: a + b, "bit_xor": lambda a, b: a.bitwiseXOR(b)}
    new = [plus[over[n]](F.coalesce(F.expr(a).over(inside), F.lit(0)), F.coalesce(F.col(f"_f_{n}"), F.lit(0))).alias(n) for n, a in values.items()]
    return out.select(*df.columns, *new)


def _marks(position: Column, turn: Column) -> tuple[Column, Column]:
    """128 bits for a turn at a position."""
    return F.xxhash64(position, turn), F.xxhash64(turn, position)


def layout(turns: DataFrame, convs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """One row per conversation and block: ``t1`` to ``t<slots>`` (struct of
    id and chars), ``xa``, ``xb`` (the block's own marks) and ``ka``, ``kb``
    (the node before the block). A conversation without turns has an empty
    block 0."""
    a, b = _marks(F.col("ord"), F.col("id"))
    at = F.col("ord") - 1
    rows = turns.select("conv_id", F.expr(f"(ord - 1) div {slots}").alias("block"), (at % slots).alias("slot"), F.struct("id", "chars").alias("t"), a.alias("a"), b.alias("b"))
    none = convs.select("conv_id").distinct().select("conv_id", F.lit(0).cast("bigint").alias("block"), *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("slot", "t", "a", "b")])
    columns = [F.max(F.when(F.col("slot") == j, F.col("t"))).alias(f"t{j + 1}") for j in range(slots)]
    xors = [F.coalesce(F.expr(f"bit_xor({x})"), F.lit(0)).alias(f"x{x}") for x in "ab"]
    g = materialize(rows.unionByName(none).groupBy("conv_id", "block").agg(*columns, *xors, F.count("t").alias("filled")), "trie-blocks")
    return materialize(_before(g, ["conv_id"], "block", {"ka": "bit_xor(xa)", "kb": "bit_xor(xb)"}), "trie-layout")


def _rollup(rows: DataFrame, slots: int, values: dict[str, str]) -> DataFrame:
    """Groups of all prefixes with ``depth``, ``na``, ``nb`` (the node),
    ``pa``, ``pb`` (its parent), ``chars`` (of its last text) and ``values``."""
    t = ", ".join(f"t{j}" for j in range(1, slots + 1))
    aggregates = ", ".join(f"{a} AS {n}" for n, a in values.items())
    g = rows.sparkSession.sql(
        f"SELECT block, ka, kb, {t}, {slots} - bit_count(grouping_id()) AS level, {aggregates} FROM {{rows}} GROUP BY block, ka, kb, ROLLUP ({t})", rows=rows)
    filled = sum(F.col(f"t{j}").isNotNull().cast("int") for j in range(1, slots + 1))
    # a conversation that ends inside a block has no node at the levels beyond; level 0 of a later block is the last one of the block before
    g = g.where((filled == F.col("level")) & ((F.col("level") > 0) | (F.col("block") == 0)))
    last = F.coalesce(*[F.col(f"t{j}") for j in range(slots, 0, -1)])
    node, parent = [F.col("ka"), F.col("kb")], [F.col("ka"), F.col("kb")]
    for j in range(1, slots + 1):
        mark = _marks(F.col("block") * slots + j, F.col(f"t{j}.id"))
        for i in (0, 1):
            node[i] = node[i].bitwiseXOR(F.when(F.col(f"t{j}").isNotNull(), mark[i]).otherwise(F.lit(0)))
            parent[i] = parent[i].bitwiseXOR(F.when(F.col("level") > j, mark[i]).otherwise(F.lit(0)))
    return g.select((F.col("block") * slots + F.col("level")).alias("depth"), node[0].alias("na"), node[1].alias("nb"), parent[0].alias("pa"), parent[1].alias("pb"),
                    F.coalesce(last["chars"], F.lit(0)).alias("chars"), *values)


def _end_digests(rows: DataFrame) -> DataFrame:
    """Per node (``depth``, ``na``, ``nb``) the SHA-256 of the ids that end
    there, ascending and comma-joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None

        def done(nodes: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*nodes)) if nodes else [[]] * 4
            return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())], names=["depth", "na", "nb", "ends"])

        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1)
            ids = b.column(3).to_pylist()
            cut = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(ids)]
            ended = []
            for s, e in zip(cut[:-1], cut[1:]):
                text = ",".join(map(str, ids[s:e])).encode()
                k = tuple(key[s].tolist())
                if k == node:
                    digest.update(b"," + text)
                    continue
                if node is not None:
                    ended.append((*node, digest.hexdigest()))
                node, digest = k, hashlib.sha256(text)
            yield done(ended)
        yield done([] if node is None else [(*node, digest.hexdigest())])

    ordered = rows.repartition("depth", "na", "nb").sortWithinPartitions("depth", "na", "nb", "conv_id")
    return ordered.select("depth", "na", "nb", "conv_id").mapInArrow(run, "depth bigint, na bigint, nb bigint, ends string")


def prefix_trie(turns: DataFrame, convs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """The nodes of all conversations in ``convs`` (``conv_id``; those without
    turns count too), whose turns are ``number_turns`` rows: ``conv_id``
    (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``."""
    rows = layout(turns, convs, slots)
    nodes = materialize(_rollup(rows, slots, {"n_convs": "count(*)", "conv_id": "min(conv_id)"}), "trie-nodes")
    nodes = nodes.withColumn("own", (F.col("n_convs") - 1) * F.col("chars"))
    here = ["depth", "na", "nb"]

    def at_node(df: DataFrame, tag: str) -> tuple[DataFrame, Column]:
        """Columns of ``df`` renamed, and the condition that joins it."""
        named = df.select(*[F.col(c).alias(f"_{tag}_{c}") if c in here else F.col(c) for c in df.columns])
        return named, (F.col("depth") == F.col(f"_{tag}_depth")) & (F.col("na") == F.col(f"_{tag}_na")) & (F.col("nb") == F.col(f"_{tag}_nb"))

    children, is_parent = at_node(nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("na"), F.col("pb").alias("nb")).agg(F.count(F.lit(1)).alias("n_children")), "c")
    nodes = nodes.join(children, is_parent, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    # what each node's representative represents above it
    nodes = materialize(_before(nodes.select(*here, "pa", "pb", "conv_id", "n_convs", "n_children", "own"), ["conv_id"], "depth", {"above": "sum(own)"}), "trie-own")

    held = nodes.groupBy(F.col("conv_id").alias("_rep")).agg(F.sum("own").alias("own"), F.max((F.col("n_children") == 0).cast("bigint")).alias("leaf"))
    held = rows.join(held, F.col("conv_id").eqNullSafe(F.col("_rep"))).drop("_rep")
    below, in_subtree = at_node(_rollup(held, slots, {"all_own": "sum(own)", "n_leaves": "sum(leaf)"}).select(*here, "all_own", "n_leaves"), "b")

    last = rows.groupBy("conv_id").agg(F.sum("filled").alias("depth"), F.expr("bit_xor(xa)").alias("na"), F.expr("bit_xor(xb)").alias("nb"))
    ends, ends_here = at_node(_end_digests(last.where("conv_id IS NOT NULL")), "e")
    parents = nodes.select((F.col("depth") + 1).alias("_p_depth"), F.col("na").alias("_p_na"), F.col("nb").alias("_p_nb"), F.col("conv_id").alias("parent_conv_id"))
    of_parent = (F.col("depth") == F.col("_p_depth")) & (F.col("pa") == F.col("_p_na")) & (F.col("pb") == F.col("_p_nb"))
    out = nodes.join(below, in_subtree, "left").join(ends, ends_here, "left").join(parents, of_parent, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.col("n_children").cast("bigint").alias("n_children"), F.col("n_leaves").cast("bigint").alias("n_leaves"),
                      (F.col("all_own") - F.col("above")).cast("bigint").alias("saved_tokens"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"))
