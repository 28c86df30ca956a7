"""Near-duplicates by word shingles: a blocked sparse product of the
document-by-shingle incidence matrix (operator 9).

Links are all pairs of different shingle sets whose Jaccard similarity is at
least ``PERCENT`` / 100. The matrix is never multiplied out:

1. Columns. Each document's distinct shingles (64-bit hashes) are dealt by
   hash into column blocks, packed as arrays; a task sends equal sets once. A
   block drops the copies of a set that several tasks sent, counts each shingle's documents and keeps the shingles of two
   sets or more.
2. Rows. What is left comes back together by set. A set of which less than
   ``PERCENT`` % of the shingles are shared at all can have no partner (the
   overlap with any other set is below its bound) and goes. The rest are
   ordered by document frequency, rarest first.
3. Candidates. Two sets above the threshold share a shingle among the first
   ``n - ceil(t n) + 1`` of both (prefix bound); sizes and the places of the
   shared shingle bound the overlap further. First every set is paired only
   with one leader per shared shingle, verified and united; then the pairs
   that are left *between different components* are verified, each set outside
   a shingle's largest component with that shingle's others. Pairs inside a
   component can't change it, so a large group of near copies costs about its
   size, and none is skipped that could.
4. Verification takes the exact overlap of the two sets.

Sets are known by a 64-bit sum of their shingles' hashes. No step holds more
than one block or one row group; there are as many row groups as
``spark.sql.shuffle.partitions`` and ``BLOCKS`` times as many blocks.

Defined cases: null or blank text has no shingle and is linked with nothing;
fewer words than ``WIDTH`` make one shingle of all of them; a null id has no
component and does not name one; rows of equal id are separate documents; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .components import connected
from .quality import slices
from .words import giving_back, giving_back_batches, mix64, plain, string_hashes, window_hashes, words_of

WIDTH = 5
PERCENT = 75
SLICE_BYTES = 1 << 20
#: Column blocks for each shuffle partition.
BLOCKS = 2


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of every text, sorted inside each, and
    the offsets of each text's."""
    w = words_of(pc.ascii_lower(plain(texts)))
    hashes = string_hashes(w.vocabulary)[w.codes]
    counts = np.diff(w.offsets)
    found, starts = window_hashes(hashes, w.offsets, width)
    n = np.diff(starts)
    short = np.nonzero((counts > 0) & (counts < width))[0]
    if len(short):  # one shingle of all words; its length is part of it
        n = n.copy()
        n[short] = 1
        offsets = np.concatenate([[0], np.cumsum(n)])
        out = np.empty(offsets[-1], np.uint64)
        out[np.repeat(n == np.diff(starts), n)] = found
        for k in range(1, width):
            rows = short[counts[short] == k]
            if len(rows):
                at = (w.offsets[:-1][rows][:, None] + np.arange(k)).ravel()
                whole, _ = window_hashes(hashes[at], np.arange(0, len(at) + 1, k), k)
                out[offsets[:-1][rows]] = mix64(whole + np.uint64(k))
        found, starts = out, offsets
    for a, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
        found[a:e].sort()
    first = np.ones(len(found), bool)
    first[1:] = found[1:] != found[:-1]
    inner = starts[:-1]
    first[inner[inner < len(found)]] = True
    return found[first], np.concatenate([[0], np.cumsum(first)])[starts]


def set_ids(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit number for each set, the same for equal sets."""
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix64(hashes + np.uint64(0x9E37)))])
        return mix64(sums[offsets[1:]] - sums[offsets[:-1]] + np.diff(offsets).astype(np.uint64)).view(np.int64)


_PACKED = [("key", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("texts", pa.binary()), ("sids", pa.binary()), ("sizes", pa.binary()), ("counts", pa.binary()), ("hashes", pa.binary())]
_PACKED_DDL = "key int, doc_ids array<bigint>, texts binary, sids binary, sizes binary, counts binary, hashes binary"
_COLUMN_DDL = "kind int, home int, doc_id bigint, text_hash bigint, n int, sid bigint, sids binary, sizes binary, counts binary, hashes binary, freqs binary"


def _pack(blocks: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, sent = 0, set()
        for b in batches:
            for at, rows in slices(b.column(1), SLICE_BYTES):
                full, offsets = shingle_sets(b.column(1).slice(at, rows), width)
                sids, sizes = set_ids(full, offsets), np.diff(offsets).astype(np.int32)
                _, first = np.unique(sids, return_index=True)
                new = np.zeros(rows, bool)  # a task sends the shingles of equal sets once
                new[[i for i, s in zip(first.tolist(), sids[first].tolist()) if s not in sent]] = True
                sent.update(sids[new].tolist())
                h = full[np.repeat(new, sizes)]
                block = (h % np.uint64(blocks)).astype(np.uint16 if blocks <= 65536 else np.int64)
                order = np.argsort(block, kind="stable")
                owner = np.repeat(np.arange(rows), np.where(new, sizes, 0))[order]
                h, edges = h[order], np.concatenate([[0], np.cumsum(np.bincount(block, minlength=blocks))])
                out = {name: [] for name, _ in _PACKED}

                def add(key, doc_ids, texts, s, z, c, hashes):
                    values = (key, doc_ids, texts, s.tobytes(), z.tobytes(), c.tobytes(), hashes.tobytes())
                    for name, v in zip(out, values):
                        out[name].append(v)

                none = np.zeros(0, np.uint64)
                add(-1 - turn % blocks, b.column(0).slice(at, rows).to_pylist(), b.column(2).slice(at, rows).to_numpy(zero_copy_only=False).tobytes(), sids, sizes, none, none)
                turn += 1
                for k in np.nonzero(np.diff(edges))[0]:
                    own = owner[edges[k] : edges[k + 1]]  # ascending
                    docs, counts = np.unique(own, return_counts=True)
                    add(int(k), None, None, sids[docs], sizes[docs], counts.astype(np.int32), h[edges[k] : edges[k + 1]])
                yield pa.RecordBatch.from_arrays([pa.array(out[name], kind) for name, kind in _PACKED], names=[name for name, _ in _PACKED])

    return run


def _joined(table: pa.Table, name: str, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in table.column(name).to_pylist() if x), dtype)


_COLUMN_NAMES = ["kind", "home", "doc_id", "text_hash", "n", "sid", "sids", "sizes", "counts", "hashes", "freqs"]
_COLUMN_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]


def _column_block(homes: int):
    """One block of columns: shingles that two sets or more have, packed by
    the home of their sets; or document rows, passed on."""

    def run(table: pa.Table) -> pa.Table:
        sids, sizes = _joined(table, "sids", np.int64), _joined(table, "sizes", np.int32)
        out: dict[str, list] = {name: [] for name in _COLUMN_NAMES}
        if table.column("key")[0].as_py() < 0:
            n = len(sids)
            doc_ids = pc.list_flatten(table.column("doc_ids")).to_pylist()
            out = dict.fromkeys(_COLUMN_NAMES, [None] * n) | {"kind": [0] * n, "doc_id": doc_ids, "text_hash": _joined(table, "texts", np.int64), "n": sizes, "sid": sids}
        else:
            counts = _joined(table, "counts", np.int32)
            h = _joined(table, "hashes", np.uint64)
            _, first = np.unique(sids, return_index=True)  # one of the copies of each set
            kept = np.zeros(len(sids), bool)
            kept[first] = True
            of = np.repeat(np.arange(len(sids), dtype=np.int32), counts)
            real = kept[of]
            h, of = h[real], of[real]
            order = np.argsort(h)
            h, of = h[order], of[order]
            del order, real
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            at = np.flatnonzero(new)
            length = np.diff(np.append(at, len(h))).astype(np.uint32)
            freq = np.repeat(length, length)
            shared = freq > 1
            h, of, freq = h[shared], of[shared], freq[shared]
            home = (sids.view(np.uint64) % np.uint64(homes)).astype(np.int64)[of]
            order = np.lexsort((of, home))
            h, of, freq, home = h[order], of[order], freq[order], home[order]
            edges = np.searchsorted(home, np.arange(homes + 1))
            for k in np.nonzero(np.diff(edges))[0]:
                part = slice(edges[k], edges[k + 1])
                own, c = np.unique(of[part], return_counts=True)
                row = (1, int(k), None, None, None, None, sids[own].tobytes(), sizes[own].tobytes(), c.astype(np.int32).tobytes(), h[part].tobytes(), freq[part].astype(np.uint32).tobytes())
                for name, v in zip(_COLUMN_NAMES, row):
                    out[name].append(v)
        return pa.Table.from_arrays([pa.array(out[name], kind) for name, kind in zip(_COLUMN_NAMES, _COLUMN_TYPES)], names=_COLUMN_NAMES)

    return run


def _rows(percent: int):
    """One home: its sets' shared shingles, rarest first, and how many of
    them are in the prefix. Sets that can have no partner go."""

    def run(table: pa.Table) -> pa.Table:
        sids, sizes, counts = _joined(table, "sids", np.int64), _joined(table, "sizes", np.int32), _joined(table, "counts", np.int32)
        h, freq = _joined(table, "hashes", np.uint64), _joined(table, "freqs", np.uint32)
        own, at, index = np.unique(sids, return_index=True, return_inverse=True)
        of = np.repeat(index, counts)
        n, shared = sizes[at].astype(np.int64), np.bincount(of, minlength=len(own))
        live = 100 * shared >= percent * n
        keep = live[of]
        h, freq, of = h[keep], freq[keep], of[keep]
        order = np.lexsort((h, freq, of))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(shared[live])]), pa.int32()), pa.array(h[order].view(np.int64)))
        first = (n - shared)[live]
        prefix = n[live] - -(-percent * n[live] // 100) + 1 - first
        return pa.Table.from_pydict({"sid": pa.array(own[live]), "n": pa.array(n[live], pa.int32()), "first": pa.array(first, pa.int32()),
                                     "prefix": pa.array(prefix, pa.int32()), "hashes": lists})

    return run


def spanning_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_hash, n, sid) and links between different sets
    (a, b): enough of them to span every component, not all."""
    spark = docs.sparkSession
    homes = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = BLOCKS * homes
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    packed = src.mapInArrow(giving_back_batches(_pack(blocks, width)), _PACKED_DDL)
    columns = materialize(packed.groupBy("key").applyInArrow(giving_back(_column_block(homes)), _COLUMN_DDL), "incidence")
    members = columns.where("kind = 0").select("doc_id", "text_hash", F.col("n").cast("bigint").alias("n"), "sid")
    sets = materialize(columns.where("kind = 1").select("home", "sids", "sizes", "counts", "hashes", "freqs").groupBy("home").applyInArrow(
        giving_back(_rows(percent)), "sid bigint, n int, first int, prefix int, hashes array<bigint>"), "sets")

    postings = materialize(sets.select("sid", "n", "first", F.posexplode(F.slice("hashes", F.lit(1), F.col("prefix"))))
                           .select("sid", "n", (F.col("first") + F.col("pos")).alias("at"), F.col("col").alias("h")), "postings")
    need = F.ceil(percent * (F.col("n") + F.col("n2")) / F.lit(100 + percent))
    near = ((100 * F.least("n", "n2") >= percent * F.greatest("n", "n2"))
            & (F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2")) >= need))

    def second(p: DataFrame) -> DataFrame:
        return p.select(*[F.col(c).alias(c + "2") for c in p.columns])

    def verified(pairs: DataFrame) -> DataFrame:
        x = sets.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("hashes").alias("ha"))
        y = sets.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("hashes").alias("hb"))
        both = pairs.join(x, "a").join(y, "b").withColumn("o", F.size(F.array_intersect("ha", "hb")))
        return both.where(100 * F.col("o") >= percent * (F.col("na") + F.col("nb") - F.col("o"))).select("a", "b")

    least, most = F.least("sid", "sid2").alias("a"), F.greatest("sid", "sid2").alias("b")
    apart = (F.col("g") != F.col("g2")) & near

    # the leader of a shingle is the set that has it earliest: few rarer ones before it, so close to what its holders have in common
    lead = postings.groupBy("h").agg(F.min(F.struct(F.col("at").alias("first_at"), "sid", "n", "at")).alias("m"), F.count(F.lit(1)).alias("c")).where("c > 1")
    lead = materialize(lead.select(F.col("h").alias("h2"), *[F.col(f"m.{c}").alias(c + "2") for c in ("sid", "n", "at")]), "leaders")
    tried = postings.join(lead, F.col("h") == F.col("h2")).where(near & (F.col("sid") != F.col("sid2"))).select(least, most).distinct()
    tried = materialize(tried, "leader-pairs")
    links = materialize(verified(tried), "leader-links")

    # pairs still apart: per shingle, those outside its largest component with all others
    tagged = materialize(postings.join(connected(links), F.col("sid") == F.col("node"), "left").select("sid", "n", "at", "h", F.coalesce("component", "sid").alias("g")), "tagged")
    per_group = tagged.groupBy("h", "g").agg(F.count(F.lit(1)).alias("c"))
    mixed = per_group.groupBy(F.col("h").alias("mh")).agg(F.max(F.struct("c", "g")).alias("m"), F.count(F.lit(1)).alias("groups")).where("groups > 1")
    mixed = materialize(mixed.select("mh", F.col("m.g").alias("mg")), "mixed")
    open_ = materialize(tagged.join(mixed, F.col("h") == F.col("mh")).select("sid", "n", "at", "h", "g", (F.col("g") == F.col("mg")).alias("major")), "open")
    once = F.col("major2") | (F.col("sid") < F.col("sid2"))
    rest = open_.where("NOT major").join(second(open_), (F.col("h") == F.col("h2")) & apart & once)
    rest = materialize(rest.select(least, most).distinct().join(tried, ["a", "b"], "left_anti"), "rest-pairs")
    return members, links.unionByName(verified(rest))


def _named(docs: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` (doc_id, text_hash, n, sid), and the sets (sid,
    least id, root: the component's smallest set)."""
    members, links = spanning_links(docs, **options)
    roots = materialize(connected(links), "roots")
    named = members.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("least"))
    named = named.join(roots, F.col("sid") == F.col("node"), "left").select("sid", "least", F.coalesce("component", "sid").alias("root"))
    return members, materialize(named, "named")


def components(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles`` and
    ``component_id``, the smallest id reachable by links."""
    members, named = _named(docs, **options)
    # written, so that the join is between two exchanges and a large component's rows can be split
    smallest = materialize(named.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("smallest")), "smallest")
    by_set = materialize(named.join(smallest, F.col("root") == F.col("r")).select(F.col("sid").alias("s"), "smallest"), "by-set")
    out = members.join(by_set, (F.col("sid") == F.col("s")) & (F.col("n") > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("smallest", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each component: the one of smallest id (a null
    id is the largest), then of smallest text hash. A row is known by its id
    and text, so an id may have several rows. Texts without shingles stay."""
    members, named = _named(docs, id_col=id_col, text_col=text_col, **options)
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = members.where("n > 0").groupBy("sid").agg(F.min(key).alias("first"))
    best = materialize(named.join(first.withColumnRenamed("sid", "s"), F.col("sid") == F.col("s")).groupBy("root").agg(F.min("first").alias("best")), "best")
    by_set = materialize(named.join(best.withColumnRenamed("root", "r"), F.col("root") == F.col("r")).select(F.col("sid").alias("s"), "best"), "best-by-set")
    judged = members.where("n > 0").join(by_set, F.col("sid") == F.col("s")).select("doc_id", "text_hash", (key == F.col("best")).alias("stays"))
    judged = judged.groupBy(F.col("doc_id").alias("_od"), F.col("text_hash").alias("_ot")).agg(F.min("stays").alias("_stays"), F.count(F.lit(1)).alias("_rows"))
    judged = materialize(judged.where("NOT _stays OR _rows > 1"), "copies")
    same = F.col(f"`{id_col}`").cast("bigint").eqNullSafe(F.col("_od")) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col("_ot"))
    alone = docs.join(judged, same, "left_anti")
    repeated = docs.join(judged.where("_stays"), same, "left_semi").dropDuplicates([id_col, text_col])
    return alone.unionByName(repeated)
