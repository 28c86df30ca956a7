"""Token-id files (operator 3).

Documents are range-partitioned by id, sorted, encoded and written as Parquet
by Spark: one row per document with its ids as a list column. Ids are
dictionary-encoded, the integer columns delta-encoded, row groups and pages
have set sizes, and each column chunk has its page index, so a reader of some
documents, or of the counts alone, reads only those pages.

Files are in ascending id order, and each row has its file's number and the
ids before it in that file; ``starts`` turns that into places in the whole
stream by the files' totals.

Defined cases: null text is empty (the end id alone); null ids come first;
rows of equal id are ordered by their text; an empty table gives files
without rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zlib
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .quality import slices
from .tokens import encoder

ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 64 << 10
PAGE_ROWS = 512
SLICE_BYTES = 8 << 20

FORMAT = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",  # delta encodings where no dictionary is kept
    "parquet.block.size": str(ROW_GROUP_BYTES),
    "parquet.page.size": str(PAGE_BYTES),
    "parquet.page.row.count.limit": str(PAGE_ROWS),
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#file_start": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}
SCHEMA = "doc_id bigint, file int, file_start bigint, n_tokens bigint, ids array<int>"


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, kind: str = "word_end", end_id: int = 1, id_col: str = "doc_id",
                 text_col: str = "text", files: int | None = None) -> None:
    """Encode ``docs`` into files under ``path``. ``files``: how many
    (``spark.sql.shuffle.partitions`` unless given)."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    n = files or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_id = F.col("doc_id").asc_nulls_first()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, number, before = encoder(tokenizer_path, kind), TaskContext.get().partitionId(), 0
        for b in batches:
            texts = pc.fill_null(b.column(1), "")
            for at, rows in slices(texts, SLICE_BYTES):
                ids, offsets = enc.encode(texts.slice(at, rows))
                ids = np.insert(ids, offsets[1:], np.uint32(end_id)).view(np.int32)
                upto = offsets + np.arange(rows + 1)
                counts = np.diff(upto)
                lists = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_pydict({"doc_id": b.column(0).slice(at, rows), "file": pa.array(np.full(rows, number, np.int32)), "file_start": pa.array(before + upto[:-1]), "n_tokens": pa.array(counts), "ids": lists})
                before += int(upto[-1])

    ordered = src.repartitionByRange(n, by_id).sortWithinPartitions(by_id, F.col("text").asc_nulls_first())
    ordered.mapInArrow(encode, SCHEMA).write.options(**FORMAT).parquet(path)


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The files' rows, or those with ids from ``first`` to ``last`` (pushed
    down to row groups and pages)."""
    df = spark.read.schema(SCHEMA).parquet(path)
    if first is not None:
        df = df.where(F.col("doc_id") >= first)
    return df if last is None else df.where(F.col("doc_id") <= last)


def starts(spark: SparkSession, path: str) -> DataFrame:
    """``file`` and ``before``: the ids in all earlier files. Reads two
    integer columns; one row per file."""
    totals = spark.read.schema(SCHEMA).parquet(path).groupBy("file").agg(F.sum("n_tokens").alias("n"))
    w = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("file", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))


def digests(tokens: DataFrame) -> DataFrame:
    """Per row of the files: crc32 of its ids as little-endian unsigned
    32-bit integers, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            values = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<u4")
            off = lists.offsets.to_numpy(zero_copy_only=False)
            crc = [zlib.crc32(values[a:e]) for a, e in zip(off[:-1], off[1:], strict=True)]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "file": b.column(1), "file_start": b.column(2), "n_tokens": pa.array(np.diff(off).astype(np.int64)), "ids_crc32": pa.array(crc, pa.int64())})

    return tokens.select("doc_id", "file", "file_start", "ids").mapInArrow(run, "doc_id bigint, file int, file_start bigint, n_tokens bigint, ids_crc32 bigint")
