"""Sharding by histogram sort (operator 2). DataFrame functions only.

Rows are ordered by a key: the hash of the text, then the hash of the id, so
equal texts lie together and a hot text can still be cut. The splitters
between the shards are found by counting: each round counts the exact bytes
below ``PROBES`` candidate boundaries inside the interval that holds each
splitter, and goes on in the part that contains it, until the bytes below a
boundary are within the tolerance or the part holds one row and cannot be
cut. Only then do the rows move, once: to chunks of a shard (by the id's hash,
so that a chunk is bounded also inside a hot text), sorted by key in each.

The rounds read a narrow table (two hashes, a size) that is written once; the
driver sees at most ``PROBES`` counts per splitter and round.

Defined cases: null text is empty, null ids hash alike; rows that agree in
text and id cannot be told apart and stay together; shards of an empty table
or more shards than rows are empty; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

PROBES = 256
#: Bytes a splitter may be off, as a share of a shard's bytes.
TOLERANCE = 0.001
CHUNK_BYTES = 32 << 20
_BITS = 62
_SPAN = 1 << _BITS


def row_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1


def _hash(col: Column, seed: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(col.cast("string"), F.lit("")), F.lit(seed)), 64 - _BITS)


def _inside(lo: int, hi: int) -> tuple[Column, Column, int]:
    """Whether a key is in [lo, hi) and its part there, and a part's width.
    Keys are h * 2^62 + t; an interval spans whole h values or lies in one."""
    h, t = F.col("_h"), F.col("_t")
    if hi - lo > _SPAN:
        first, last = lo // _SPAN, hi // _SPAN
        step = -(-(last - first) // PROBES)
        return (h >= first) & (h < last), F.expr(f"(_h - {first}L) div {step}L"), step * _SPAN
    first, last = lo % _SPAN, (hi - 1) % _SPAN
    step = -(-(last - first + 1) // PROBES)
    return (h == lo // _SPAN) & (t >= first) & (t <= last), F.expr(f"(_t - {first}L) div {step}L"), step


def splitters(keyed: DataFrame, n_shards: int, tolerance: float = TOLERANCE) -> tuple[list[int], int]:
    """The keys (``_h``, ``_t`` as one number) at which shards 1 and on
    begin, and the bytes in all."""
    total = keyed.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
    slack = tolerance * total / n_shards
    found: dict[int, int] = {}
    todo = {i: (0, _SPAN * _SPAN, 0) for i in range(1, n_shards)}  # interval and the bytes below it
    if not total:
        return [_SPAN * _SPAN] * (n_shards - 1), 0
    while todo:
        spans = sorted({(lo, hi) for lo, hi, _ in todo.values()})
        which, part = F.lit(None).cast("int"), F.lit(None).cast("bigint")
        widths = {}
        for k, (lo, hi) in enumerate(spans):
            inside, at, widths[lo, hi] = _inside(lo, hi)
            which, part = F.when(inside, k).otherwise(which), F.when(inside, at).otherwise(part)
        counted: dict[tuple[int, int], list[tuple[int, int, int]]] = {s: [] for s in spans}
        rows = keyed.select(which.alias("k"), part.alias("p"), "_size").where("k IS NOT NULL").groupBy("k", "p").agg(F.sum("_size").alias("b"), F.count(F.lit(1)).alias("n"))
        for r in rows.collect():  # at most PROBES for each interval
            counted[spans[r["k"]]].append((r["p"], r["b"], r["n"]))
        for i, (lo, hi, below) in list(todo.items()):
            target, width = i * total / n_shards, widths[lo, hi]
            for p, size, n in sorted(counted[lo, hi]):
                if below + size < target:
                    below += size
                    continue
                start, end = lo + p * width, min(hi, lo + (p + 1) * width)
                if min(target - below, below + size - target) <= slack or n == 1 or end - start == 1:
                    found[i] = start if target - below <= below + size - target else end
                    del todo[i]
                else:
                    todo[i] = (start, end, below)
                break
    return [found[i] for i in range(1, n_shards)], total


def shard_documents(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text",
                    tolerance: float = TOLERANCE, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``docs`` with ``shard`` (0 to n_shards - 1, bytes near equal) and
    ``slot`` (the row's place in its shard, gapless from 0)."""
    h, t = _hash(F.col(text_col), "text"), _hash(F.col(id_col), "id")
    keyed = materialize(docs.select(h.alias("_h"), t.alias("_t"), row_size(F.col(text_col)).alias("_size")), "shard-keys")
    cuts, total = splitters(keyed, n_shards, tolerance)
    chunks = max(1, -(-total // (n_shards * chunk_bytes)))

    def place(df: DataFrame) -> DataFrame:
        shard = F.lit(0)
        for c in cuts:
            first, second = divmod(c, _SPAN)
            at_or_after = (F.col("_h") > first) | ((F.col("_h") == first) & (F.col("_t") >= second))
            shard = shard + F.when(at_or_after, 1).otherwise(0)
        return df.withColumn("_shard", shard).withColumn("_chunk", F.pmod(F.col("_t"), F.lit(chunks)))

    counts = place(keyed).groupBy(F.col("_shard").alias("_s"), F.col("_chunk").alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_s").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)  # one row per chunk
    first_slot = counts.select("_s", "_c", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    rows = place(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), h.alias("_h"), t.alias("_t")))
    order = Window.partitionBy("_shard", "_chunk").orderBy("_h", "_t")
    rows = rows.repartition(n_shards * chunks, "_shard", "_chunk")  # the one exchange, sized by bytes
    out = rows.withColumn("_at", F.row_number().over(order)).join(first_slot, (F.col("_shard") == F.col("_s")) & (F.col("_chunk") == F.col("_c")))
    keep = [c for c in docs.columns if c not in ("shard", "slot")]
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in keep], F.col("_shard").cast("int").alias("shard"),
                      (F.col("_first") + F.col("_at") - 1).cast("bigint").alias("slot"))
