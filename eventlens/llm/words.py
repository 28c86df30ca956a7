"""Word kernels on Arrow batches, shared by the text operators.

A word is a maximal run of code points other than space, tab, line feed,
vertical tab, form feed and carriage return. Everything here works on one
Arrow batch inside a task: words become dictionary codes in Arrow's own
string hash table, and the rest is numpy on those codes, so no Python object
is made per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The word pattern in the regular-expression dialects of Spark and DuckDB.
WORD = r"[^\x20\x09-\x0D]+"

_MIX1 = np.uint64(0xBF58476D1CE4E5B9)  # fixed values: the published splitmix64 finaliser
_MIX2 = np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def give_back() -> None:
    """Return freed memory to the system. Python workers outlive their tasks,
    and what they keep is missing in the executor's next stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim is not None:
        trim(0)


def giving_back(kernel: Callable) -> Callable:
    """A group kernel that ends with ``give_back``."""
    @wraps(kernel)
    def run(group):
        out = kernel(group)
        give_back()
        return out

    return run


def giving_back_batches(kernel: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same for a kernel over a task's batches."""
    @wraps(kernel)
    def run(batches):
        yield from kernel(batches)
        give_back()

    return run


@dataclass
class Words:
    """Words of a batch: ``codes[offsets[i]:offsets[i + 1]]`` are document
    ``i``'s words as indices into ``vocabulary`` (distinct words)."""

    codes: np.ndarray
    offsets: np.ndarray
    vocabulary: pa.Array


def plain(texts: pa.Array) -> pa.Array:
    """A copy with empty texts for nulls that starts at offset 0: some Arrow
    kernels misread a slice of large strings. A slice has less than 2 GB."""
    return pc.fill_null(texts.cast(pa.string()), "").take(pa.array(np.arange(len(texts))))


def words_of(texts: pa.Array) -> Words:
    """Split every text (null: no words) and code its words."""
    texts = plain(texts)
    lists = pc.ascii_split_whitespace(texts)
    offsets = np.asarray(lists.offsets).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = offsets - offsets[0]
    vocabulary = coded.dictionary
    empty = pc.index(vocabulary, pa.scalar("", vocabulary.type)).as_py()
    if empty >= 0:  # blank ends of a text come as empty strings
        real = codes != empty
        before = np.concatenate([[0], np.cumsum(real)])
        codes, offsets = codes[real], before[offsets]
    return Words(codes, offsets, vocabulary)


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser, a bijection of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX1
        x = (x ^ (x >> np.uint64(27))) * _MIX2
        return x ^ (x >> np.uint64(31))


def string_hashes(strings: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string's bytes, the same on every machine:
    a polynomial of the bytes (prefix sums over the buffer, powers taken out
    again per string) and the length, finalised."""
    strings = strings.cast(pa.large_string())
    n = len(strings)
    if n == 0:
        return np.zeros(0, np.uint64)
    _, off, data = strings.buffers()
    offsets = np.frombuffer(off, np.int64)[strings.offset : strings.offset + n + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8)[first:last] if last > first else np.zeros(0, np.uint8)
    start, end = offsets[:-1] - first, offsets[1:] - first
    length = end - start
    with np.errstate(over="ignore"):
        within = np.arange(len(raw), dtype=np.int64) - np.repeat(start, length)
        longest = int(length.max())
        powers = np.cumprod(np.full(longest + 1, _GOLD, np.uint64)) if longest else np.ones(1, np.uint64)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[within])])
        return mix64(sums[end] - sums[start] + mix64(length.astype(np.uint64) + _GOLD))


def window_hashes(word_hashes: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word windows that lie inside one document, in
    text order, and the offsets of each document's windows."""
    counts = np.maximum(np.diff(offsets) - width + 1, 0)
    starts = np.concatenate([[0], np.cumsum(counts)])
    total = int(starts[-1])
    if total == 0:
        return np.zeros(0, np.uint64), starts
    first = np.repeat(offsets[:-1] - starts[:-1], counts) + np.arange(total)
    with np.errstate(over="ignore"):
        acc = np.zeros(total, np.uint64)
        for k in range(width):
            acc = (acc ^ word_hashes[first + k]) * _MIX1
            acc ^= acc >> np.uint64(29)
        return mix64(acc), starts
