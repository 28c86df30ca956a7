r"""Fill-in-the-middle transformation (operator 13).

A text is cut between units (``[A-Za-z]+|[^A-Za-z]``) into prefix, middle and
suffix and written in one of three forms:

===== ==================================
plain the text
psm   ``<P>`` prefix ``<S>`` suffix ``<M>`` middle
spm   ``<S>`` suffix ``<P>`` prefix ``<M>`` middle
===== ==================================

Each Arrow batch goes through one pipeline of column kernels: units as list
arrays, flattened with their parent indices, ordinals inside the parent, a
filter for each role, lists rebuilt from what is left, ``binary_join`` of each
list, and the parts joined element by element. Arrow's own splitters throw
away what they split at, so the unit boundaries are found on the bytes and the
list array is laid over the same buffer.

Cuts and form come from SHA-256 of seed and id alone, so they do not depend on
partitions or order. ``restore`` reads a text back from output and form.

Defined cases: null text is empty; an empty text, or one that holds a mark, is
plain; a null id is hashed as an empty one; rows of equal id share their
numbers; an empty table gives an empty result; other columns pass through,
except those named as the new ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import slices
from .words import plain

PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
SEED = 1
#: Percent of the texts that are rewritten, and of those the percent in spm form.
REWRITTEN, SPM = 90, 20
SLICE_BYTES = 2 << 20

_BYTE = np.arange(256)
_LETTER = ((_BYTE >= 65) & (_BYTE <= 90)) | ((_BYTE >= 97) & (_BYTE <= 122))
_FIRST = (_BYTE & 0xC0) != 0x80  # first bytes of code points


def split_units(texts: pa.Array) -> pa.ListArray:
    """The units of each text (no nulls) as a list, over the texts' own bytes."""
    texts = plain(texts)
    n = len(texts)
    _, off, data = texts.buffers()
    ends = np.frombuffer(off, np.int32)[: n + 1] if n else np.zeros(1, np.int32)
    size = int(ends[-1])
    if size == 0:
        return pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array([], pa.string()))
    raw = np.frombuffer(data, np.uint8)[:size]
    letter = _LETTER[raw]
    first = _FIRST[raw]
    first[1:] &= ~(letter[1:] & letter[:-1])
    starts = ends[:-1]
    first[starts[starts < size]] = True  # texts begin with a unit; an empty one's place is the next one's start
    at = np.flatnonzero(first).astype(np.int32)
    offsets = pa.py_buffer(np.append(at, np.int32(size)).tobytes())
    units = pa.StringArray.from_buffers(len(at), offsets, data)
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(at, ends).astype(np.int32)), units)


def draws(ids: list, seed: int) -> np.ndarray:
    """h1 to h4 of each id: the first four 32-bit groups of SHA-256."""
    digests = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(digests, ">u4").reshape(-1, 4).astype(np.int64)


def transform(texts: pa.Array, ids: list, seed: int, rewritten: int, spm: int) -> dict[str, pa.Array]:
    """The new columns for a batch of texts without nulls."""
    lists = split_units(texts)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    n = np.diff(offsets)
    h = draws(ids, seed)
    one, two = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
    cut, end = np.minimum(one, two), np.maximum(one, two)

    parent = pc.list_parent_indices(lists).to_numpy()
    units = lists.flatten()
    ordinal = np.arange(len(units)) - offsets[parent]
    in_prefix, in_suffix = ordinal < cut[parent], ordinal >= end[parent]

    def joined(role: np.ndarray, counts: np.ndarray) -> pa.Array:
        upto = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
        return pc.binary_join(pa.ListArray.from_arrays(upto, pc.filter(units, pa.array(role))), "")

    prefix, suffix = joined(in_prefix, cut), joined(in_suffix, n - end)
    middle = joined(~in_prefix & ~in_suffix, end - cut)
    psm = pc.binary_join_element_wise(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle, "")
    swapped = pc.binary_join_element_wise(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle, "")
    is_plain = pa.array((n == 0) | (h[:, 2] % 100 >= rewritten))
    for m in MARKS:
        is_plain = pc.or_(is_plain, pc.match_substring(texts, m))
    is_spm = pa.array(h[:, 3] % 100 < spm)
    chars = [pc.if_else(is_plain, pa.scalar(None, pa.int64()), pc.utf8_length(p).cast(pa.int64())) for p in (prefix, middle)]
    return {"n": pa.array(n), "form": pc.if_else(is_plain, "plain", pc.if_else(is_spm, "spm", "psm")),
            "prefix_chars": chars[0], "middle_chars": chars[1], "output": pc.if_else(is_plain, texts, pc.if_else(is_spm, swapped, psm))}


NEW = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rewritten: int = REWRITTEN, spm: int = SPM) -> DataFrame:
    """``docs`` with ``n`` (units), ``form``, ``prefix_chars`` and
    ``middle_chars`` (code points, null if plain) and ``output`` instead of
    the text."""
    passed = [c for c in docs.columns if c != text_col and c not in NEW]
    src = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"), F.col(f"`{id_col}`").cast("string").alias("_id"),
                      F.struct(F.lit(0).alias("_none"), *[F.col(f"`{c}`") for c in passed]).alias("_row"))
    schema = src.select("_row").schema
    for name, kind in NEW.items():
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, rows in slices(b.column(0), SLICE_BYTES):
                made = transform(plain(b.column(0).slice(at, rows)), b.column(1).slice(at, rows).to_pylist(), seed, rewritten, spm)
                yield pa.RecordBatch.from_arrays([b.column(2).slice(at, rows), *made.values()], names=["_row", *made])

    return src.mapInArrow(run, schema).select(*[F.col(f"_row.`{c}`").alias(c) for c in passed], *NEW)


def restore(output: Column, form: Column) -> Column:
    """The text, read back from an output and its form."""
    parts = F.split(output, "|".join(MARKS), -1)  # "", then the three parts
    part = lambda i: F.get(parts, F.lit(i))
    return (F.when(form == "psm", F.concat(part(1), part(3), part(2)))
            .when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output))
