r"""Line dedup with keep bitmaps (operator 11).

A line's key is the line without blanks at its ends and with A-Z lower-cased.
Lines whose key is found in ``min_docs`` documents or more go: all of them, or
(``keep="first"``) all but the first occurrence.

1. Every line becomes a narrow row: a 128-bit hash of its key, its document,
   its position. No text moves.
2. The rows are range-partitioned by (hash, document) and sorted by (hash,
   document, position), so the occurrences of one key follow each other, and a
   key that a third of all lines share is cut over many partitions, between
   documents.
3. One streaming pass over each partition counts the documents of each key as
   it goes by. It holds at most the rows of ``min_docs`` - 1 documents, since a
   key that has reached ``min_docs`` is decided. Only a partition's first and
   last key may go on in a neighbour: their counts (two rows a partition) are
   added up over the partitions, and their few undecided rows are joined to
   the sums.
4. The dropped positions come together by document and become its keep bitmap:
   zlib over packed bits, bit i for line i; lines beyond it stay. Documents
   that lose nothing have no bitmap.

``apply_bitmaps`` joins the bitmaps to the documents and cuts the texts.

Defined cases: a null or empty text is one empty line; keys of less than
``min_chars`` code points are never dropped; when all lines go, the text is
empty. A document is known by its id and its text: rows that agree in both are
one document, counted once, and all of them get its bitmap; a null id is an id
like any other. An empty table gives an empty result. Other columns pass
through, except those named as the new ones.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .quality import slices
from .words import plain

MIN_DOCS = 10
MIN_CHARS = 1
SLICE_BYTES = 4 << 20
#: Documents a task remembers, so that it sends the lines of a repeated row once (this saves work only).
REMEMBERED = 100_000
BLANKS = " \t\n\x0b\x0c\r"


def document_key(id_col: str, text_col: str) -> list[Column]:
    """(d, t): the id and a hash of the text, which also tells a null id from 0."""
    i, text = F.col(f"`{id_col}`").cast("bigint"), F.col(f"`{text_col}`")
    return [F.coalesce(i, F.lit(0)).alias("_d"), F.xxhash64(i.isNull(), F.coalesce(text, F.lit(""))).alias("_t")]


def split_lines(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All lines of the texts and the offsets of each text's."""
    lists = pc.split_pattern(plain(texts), "\n")
    offsets = np.asarray(lists.offsets).astype(np.int64)
    return lists.flatten(), offsets - offsets[0]


def line_keys(lines: pa.Array) -> pa.DictionaryArray:
    return pc.ascii_lower(pc.ascii_trim(lines, BLANKS)).dictionary_encode()


def _occurrences(min_chars: int):
    import xxhash

    names = ["h1", "h2", "d", "t", "pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for b in batches:
            d, t = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            new = np.zeros(len(d), bool)
            for i, k in enumerate(zip(d.tolist(), t.tolist())):
                if k not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(k)
                    new[i] = True
            rows = pa.array(np.flatnonzero(new))
            d, t, texts = d[new], t[new], b.column(2).take(rows)
            for at, n in slices(texts, SLICE_BYTES):
                lines, offsets = split_lines(texts.slice(at, n))
                keys = line_keys(lines)
                codes = keys.indices.to_numpy(zero_copy_only=False)
                digests = b"".join(map(xxhash.xxh3_128_digest, keys.dictionary.cast(pa.binary()).to_pylist()))
                hashes = np.frombuffer(digests, "<i8").reshape(-1, 2)[codes]
                counts = np.diff(offsets)
                real = pc.greater_equal(pc.utf8_length(keys.dictionary), min_chars).to_numpy(zero_copy_only=False)[codes]
                pos = (np.arange(len(codes)) - np.repeat(offsets[:-1], counts)).astype(np.int32)
                own = np.repeat(np.arange(at, at + n), counts)[real]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (hashes[real, 0], hashes[real, 1], d[own], t[own], pos[real])], names=names)

    return run


class KeyStream:
    """Sorted occurrences of one partition in, decisions out.

    ``feed`` and ``end`` give rows (kind, h1, h2, d, t, pos, n): kind 0 is a
    dropped line; kind 1 a line of a key that a neighbour may share, not yet
    decided (n: 1 if it is the partition's first of its key); kind 2 the
    number n of documents of such a key here.
    """

    def __init__(self, min_docs: int, keep_first: bool):
        self.min_docs, self.keep_first = min_docs, keep_first
        self.held = np.zeros((0, 5), np.int64)  # undecided rows of the key that goes by
        self.key: tuple[int, int] | None = None
        self.docs, self.last = 0, None  # documents of that key already given out, and the last of them
        self.begins = False  # whether the partition begins with that key
        self.before = np.zeros((0, 5), np.int64)  # the row before

    @staticmethod
    def _out(kind: int, rows: np.ndarray, n: np.ndarray | int = 0) -> np.ndarray:
        out = np.zeros((len(rows), 7), np.int64)
        out[:, 0], out[:, 1:6], out[:, 6] = kind, rows, n
        return out

    def _given(self, rows: np.ndarray, open_: bool) -> list[np.ndarray]:
        """Rows of the current key that go, or (``open_``) may go."""
        fresh = self.docs == 0  # rows[0] is this partition's first of the key
        if open_:
            return [self._out(1, rows, (np.arange(len(rows)) == 0) & fresh)]
        if not (self.keep_first and fresh):
            return [self._out(0, rows)]
        first = [self._out(1, rows[:1], 1)] if self.begins else []
        return [*first, self._out(0, rows[1:])]

    def _n_docs(self, rows: np.ndarray) -> int:
        if not len(rows):
            return 0
        change = (rows[1:, 2] != rows[:-1, 2]) | (rows[1:, 3] != rows[:-1, 3])
        return 1 + int(change.sum()) - (self.last == (rows[0, 2], rows[0, 3]))

    def _close(self, rows: np.ndarray, edge: bool) -> list[np.ndarray]:
        """The current key's last rows. ``edge``: it may go on in a neighbour."""
        docs = self.docs + self._n_docs(rows)
        out = []
        if docs >= self.min_docs:
            out = self._given(rows, False) if len(rows) else []
        elif edge:
            out = self._given(rows, True)
        if edge:
            out.append(np.array([[2, *self.key, 0, 0, 0, docs]], np.int64))
        return out

    def feed(self, rows: np.ndarray) -> list[np.ndarray]:
        """``rows``: (h1, h2, d, t, pos), in order. Rows that several tasks
        sent for one document count once."""
        joined = np.concatenate([self.before, rows])
        new = np.ones(len(rows), bool)
        new[1 - len(self.before) :] = (joined[1:] != joined[:-1]).any(axis=1)
        self.before, rows = joined[-1:], rows[new]
        if not len(rows):
            return []
        out: list[np.ndarray] = []
        rows = np.concatenate([self.held, rows])
        if self.key is None:
            self.key, self.begins = (rows[0, 0], rows[0, 1]), True
        cut = np.flatnonzero((rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])) + 1
        if not len(self.held) and (rows[0, 0], rows[0, 1]) != self.key:
            cut = np.concatenate([[0], cut])
        if len(cut):
            out += self._close(rows[: cut[0]], self.begins)
            first, last = cut[0], cut[-1]
            inner = rows[first:last]  # whole keys
            if len(inner):
                starts = cut[:-1] - first
                new_key = np.zeros(len(inner), bool)
                new_key[starts] = True
                new_doc = new_key.copy()
                new_doc[1:] |= (inner[1:, 2] != inner[:-1, 2]) | (inner[1:, 3] != inner[:-1, 3])
                docs = np.add.reduceat(new_doc.astype(np.int64), starts)
                goes = np.repeat(docs >= self.min_docs, np.diff(np.append(starts, len(inner))))
                if self.keep_first:
                    goes &= ~new_key
                out.append(self._out(0, inner[goes]))
            rows = rows[last:]
            self.key, self.begins, self.docs, self.last = (rows[0, 0], rows[0, 1]), False, 0, None
        docs = self.docs + self._n_docs(rows)
        if docs >= self.min_docs:
            out += self._given(rows, False)
            self.docs, self.last, rows = docs, (rows[-1, 2], rows[-1, 3]), rows[:0]
        self.held = rows
        return out

    def end(self) -> list[np.ndarray]:
        return [] if self.key is None else self._close(self.held, True)


_SCAN = ["kind", "h1", "h2", "d", "t", "pos", "n"]


def _scan(min_docs: int, keep_first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, part = KeyStream(min_docs, keep_first), TaskContext.get().partitionId()

        def batch(parts: list[np.ndarray]) -> pa.RecordBatch:
            rows = np.concatenate(parts) if parts else np.zeros((0, 7), np.int64)
            return pa.RecordBatch.from_arrays([*[pa.array(np.ascontiguousarray(rows[:, i])) for i in range(7)], pa.array(np.full(len(rows), part))], names=[*_SCAN, "part"])

        for b in batches:
            yield batch(stream.feed(np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)], axis=1)))
        yield batch(stream.end())

    return run


def pack_bitmap(dropped: np.ndarray) -> bytes:
    """The keep bitmap of a document whose lines ``dropped`` go."""
    keep = np.ones(-(-(int(dropped.max()) + 1) // 8) * 8, bool)  # whole bytes
    keep[dropped] = False
    return zlib.compress(np.packbits(keep).tobytes(), 1)


def unpack_bitmap(bitmap: bytes, n_lines: int) -> np.ndarray:
    """Whether each of a document's lines stays."""
    keep = np.ones(n_lines, bool)
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[:n_lines]
    keep[: len(bits)] = bits
    return keep


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS,
                 keep: str = "none") -> DataFrame:
    """One row for each document that loses a line: its key (``_d``, ``_t``,
    see ``document_key``), ``n_dropped`` and ``bitmap``."""
    if keep not in ("none", "first"):
        raise ValueError(f"keep must be 'none' or 'first', not {keep!r}")
    src = docs.select(*document_key(id_col, text_col), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    lines = src.mapInArrow(_occurrences(min_chars), "h1 bigint, h2 bigint, d bigint, t bigint, pos int")
    ordered = lines.repartitionByRange("h1", "h2", "d", "t").sortWithinPartitions("h1", "h2", "d", "t", "pos")
    ddl = ", ".join(f"{c} bigint" for c in [*_SCAN, "part"])
    scanned = materialize(ordered.mapInArrow(_scan(min_docs, keep == "first"), ddl), "line-scan")
    # at most two rows a partition
    sums = scanned.where("kind = 2").groupBy(F.col("h1").alias("k1"), F.col("h2").alias("k2")).agg(F.sum("n").alias("docs"), F.min("part").alias("first_part")).where(F.col("docs") >= min_docs)
    undecided = scanned.where("kind = 1").join(sums, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")))
    if keep == "first":
        undecided = undecided.where("NOT (n = 1 AND part = first_part)")
    gone = scanned.where("kind = 0").select("d", "t", "pos").unionByName(undecided.select("d", "t", "pos"))
    by_doc = gone.groupBy("d", "t").agg(F.collect_set("pos").alias("at"))  # lines of one document

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            flat, off = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
            maps = [pack_bitmap(flat[a:e]) for a, e in zip(off[:-1], off[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(off).astype(np.int64)), pa.array(maps, pa.binary())], names=["_d", "_t", "n_dropped", "bitmap"])

    return by_doc.mapInArrow(pack, "_d bigint, _t bigint, n_dropped bigint, bitmap binary")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the kept lines as ``text_col`` (a null text becomes
    empty), ``n_lines`` (before) and ``n_dropped``."""
    passed = [c for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    d, t = document_key(id_col, text_col)
    src = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"), d, t, F.struct(F.lit(0).alias("_none"), *[F.col(f"`{c}`") for c in passed]).alias("_row"))
    marks = bitmaps.select(F.col("_d").alias("_bd"), F.col("_t").alias("_bt"), F.col("bitmap").alias("_bitmap"))
    src = src.join(marks, (F.col("_d") == F.col("_bd")) & (F.col("_t") == F.col("_bt")), "left").select("_text", "_bitmap", "_row")
    names = ["_text", "_row", "n_lines", "n_dropped"]
    schema = src.select("_text", "_row").schema.add("n_lines", "long").add("n_dropped", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, n in slices(b.column(0), SLICE_BYTES):
                texts, maps = b.column(0).slice(at, n), b.column(1).slice(at, n).to_pylist()
                lines, offsets = split_lines(texts)
                counts = np.diff(offsets)
                keep = np.ones(len(lines), bool)
                for i, m in enumerate(maps):
                    if m is not None:
                        keep[offsets[i] : offsets[i + 1]] = unpack_bitmap(m, int(counts[i]))
                upto = np.concatenate([[0], np.cumsum(keep)])[offsets]
                kept = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), lines.filter(pa.array(keep)))
                yield pa.RecordBatch.from_arrays([pc.binary_join(kept, "\n"), b.column(2).slice(at, n), pa.array(counts), pa.array(counts - np.diff(upto))], names=names)

    out = src.mapInArrow(run, schema)
    at = [F.col("_text").alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c in passed or c == text_col]
    return out.select(*at, "n_lines", "n_dropped")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without their repeated lines: bitmaps made, then applied."""
    bitmaps = materialize(keep_bitmaps(docs, id_col, text_col, **options), "line-bitmaps")
    return apply_bitmaps(docs, bitmaps, id_col, text_col)
