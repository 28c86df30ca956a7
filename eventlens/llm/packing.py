"""Bounded-space online packing (operator 5).

Each input partition is one pass: a document's ids are cut into full windows
of ``width`` and a rest; the rest goes into the open window it fits best
(least space left). At most ``open_windows`` windows are open; when none
fits and no more may open, the fullest is emitted. What is open at the end of
a partition is left over; leftovers of ``FAN`` partitions at a time are packed
again in the same way, until one task has finished the last of them. A task
holds ``open_windows`` windows and a slice of its input, whatever its size.

Defined cases: null text is empty (its document is the end id alone); the id
may be null or repeated; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, scratch_path
from .quality import slices
from .tokens import CACHE_WORDS, encoder

WIDTH = 1024
OPEN_WINDOWS = 64
#: Partitions whose leftovers one task packs again.
FAN = 32
SLICE_BYTES = 2 << 20

PIECES = "doc_id bigint, start bigint, length int, ids binary, doc_tokens bigint, sequence_id bigint, offset int, done boolean, part bigint"


class Packer:
    """Open windows of one task. ``add`` places a piece and gives the rows
    of the windows it closes."""

    def __init__(self, part: int, level: int, width: int = WIDTH, open_windows: int = OPEN_WINDOWS):
        self.part, self.width, self.most = part, width, open_windows
        self.next_id = (level << 56) | (part << 32)
        self.open: dict[int, list[tuple]] = {}
        self.free: list[tuple[int, int]] = []  # (space left, window), sorted

    def _new(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def _rows(self, window: int, done: bool) -> list[tuple]:
        return [(*piece, window, offset, done, self.part) for offset, piece in self.open.pop(window)]

    def full(self, piece: tuple) -> list[tuple]:
        return [(*piece, self._new(), 0, True, self.part)]

    def add(self, piece: tuple) -> list[tuple]:
        length = piece[2]
        if length >= self.width:
            return self.full(piece)
        out = []
        at = bisect_left(self.free, (length, -1))
        if at < len(self.free):
            space, window = self.free.pop(at)
        else:
            if len(self.free) >= self.most:
                _, fullest = self.free.pop(0)
                out = self._rows(fullest, True)
            space, window = self.width, self._new()
            self.open[window] = []
        self.open[window].append((self.width - space, piece))
        if space > length:
            insort(self.free, (space - length, window))
        else:
            out = out + self._rows(window, True)
        return out

    def rest(self, done: bool) -> list[tuple]:
        self.free = []
        return [row for window in sorted(self.open) for row in self._rows(window, done)]


_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("ids", pa.binary()), ("doc_tokens", pa.int64()),
                    ("sequence_id", pa.int64()), ("offset", pa.int32()), ("done", pa.bool_()), ("part", pa.int64())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def pack(docs: DataFrame, tokenizer_path: str, kind: str = "byte_level", end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
         width: int = WIDTH, open_windows: int = OPEN_WINDOWS, fan: int = FAN,
         cache_words: int = CACHE_WORDS) -> DataFrame:
    """One row per piece: ``doc_id``, ``start`` and ``length`` in the
    document's ids, ``ids`` (little-endian 32-bit), ``doc_tokens`` (with the
    end id), ``sequence_id`` and ``offset`` in that sequence."""
    spark = docs.sparkSession
    end = np.array([end_id], "<u4").tobytes()

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, enc = Packer(TaskContext.get().partitionId(), 0, width, open_windows), encoder(tokenizer_path, kind, cache_words)
        for b in batches:
            texts = pc.fill_null(b.column(1), "")
            for at, n in slices(texts, SLICE_BYTES):
                rows = []
                values, offsets = enc.encode(texts.slice(at, n))
                for doc, a, e in zip(b.column(0).slice(at, n).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    ids = values[a:e].tobytes() + end
                    tokens = e - a + 1
                    for start in range(0, tokens, width):
                        length = min(width, tokens - start)
                        rows += packer.add((doc, start, length, ids[4 * start : 4 * (start + length)], tokens))
                yield _batch(rows)
        yield _batch(packer.rest(False))

    def again(level: int, last: bool):
        def merge(table: pa.Table) -> pa.Table:
            group = table.column("group")[0].as_py()
            packer, rows = Packer(group, level, width, open_windows), []
            for r in sorted(table.drop_columns("group").to_pylist(), key=lambda r: (-r["length"], r["sequence_id"], r["offset"])):
                rows += packer.add((r["doc_id"], r["start"], r["length"], r["ids"], r["doc_tokens"]))
            return pa.Table.from_batches([_batch(rows + packer.rest(last))])

        return merge

    def stage(df: DataFrame, level: int) -> DataFrame:
        path = scratch_path(spark, f"pack-{level}")
        df.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    parts = src.rdd.getNumPartitions()
    out = made = stage(src.mapInArrow(first_pass, PIECES), 0)
    level, result = 0, out.where("done")
    while parts > 0:
        groups = -(-parts // fan)
        level += 1
        left = made.where("NOT done").withColumn("group", F.expr(f"part div {fan}"))
        made = stage(left.groupBy("group").applyInArrow(again(level, groups == 1), PIECES), level)
        result = result.unionByName(made.where("done"))
        if groups == 1:
            break
        parts = groups
    return result.drop("done", "part")
