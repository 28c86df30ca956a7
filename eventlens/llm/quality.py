"""Quality rules as a short-circuit cascade (operator 7).

A rule looks at a few counts of a text and rejects it or not. On a bounded
sample the cost of each rule (seconds a document) and its rejection rate are
measured; the rules then run in the order of rejections per second, each one
only on the documents that all earlier ones let through. The order changes
the work, never the verdict: a document is kept if no rule rejects it.

Defined cases: null or blank text has no words (all counts 0) and falls to
the rule on few words; the id may be null or repeated, rows are judged one by
one; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Words, giving_back_batches, mix64, plain, window_hashes, words_of

#: Rows of the sample on which cost and selectivity are measured (about so many), and the most that one task measures.
SAMPLE_ROWS, TASK_ROWS = 2000, 500
#: Bytes of text that are worked on at a time.
SLICE_BYTES = 1 << 20
WINDOW = 8

_BYTE = np.arange(256)
_BLANK = (_BYTE == 32) | ((_BYTE >= 9) & (_BYTE <= 13))
_CODE_POINT = ~_BLANK & ((_BYTE < 0x80) | (_BYTE >= 0xC0))  # first bytes of code points inside words
_SYMBOL = np.isin(_BYTE, np.frombuffer(b"#*$%&|<>", np.uint8))
_UPPER = (_BYTE >= 65) & (_BYTE <= 90)
_LETTER = _UPPER | ((_BYTE >= 97) & (_BYTE <= 122))


def byte_counts(texts: pa.Array, table: np.ndarray) -> np.ndarray:
    """For each text the number of its bytes for which ``table`` holds."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    _, off, data = texts.buffers()
    if n == 0 or data is None:
        return np.zeros(n, np.int64)
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    sums = np.concatenate([[0], np.cumsum(table[raw], dtype=np.int64)])
    return np.diff(sums[offsets - offsets[0]])


class Batch:
    """Texts with counts that are made when asked for, for chosen rows."""

    def __init__(self, texts: pa.Array):
        self.texts = plain(texts)
        self._rows: np.ndarray | None = None
        self._words: Words | None = None

    def _take(self, rows: np.ndarray) -> pa.Array:
        return self.texts if len(rows) == len(self.texts) else self.texts.take(pa.array(rows))

    def words(self, rows: np.ndarray) -> Words:
        if self._words is None or not np.isin(rows, self._rows, assume_unique=True).all():
            self._rows, self._words = rows, words_of(self._take(rows))
        w = self._words
        if len(rows) == len(self._rows):
            return w
        at = np.searchsorted(self._rows, rows)
        counts = np.diff(w.offsets)[at]
        offsets = np.concatenate([[0], np.cumsum(counts)])
        pick = np.repeat(w.offsets[:-1][at] - offsets[:-1], counts) + np.arange(offsets[-1])
        return Words(w.codes[pick], offsets, w.vocabulary)

    def n_words(self, rows):
        return np.diff(self.words(rows).offsets)

    def word_chars(self, rows):
        return byte_counts(self._take(rows), _CODE_POINT)

    def n_symbols(self, rows):
        return byte_counts(self._take(rows), _SYMBOL)

    def n_upper(self, rows):
        return byte_counts(self._take(rows), _UPPER)

    def n_letters(self, rows):
        return byte_counts(self._take(rows), _LETTER)

    def _lines(self, rows):
        """Offsets by text and codes of the lines that hold a word."""
        lists = pc.split_pattern(self._take(rows), "\n")
        offsets = np.asarray(lists.offsets).astype(np.int64)
        lines = lists.flatten()
        full = byte_counts(lines, ~_BLANK) > 0
        before = np.concatenate([[0], np.cumsum(full)])
        codes = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        return before[offsets - offsets[0]], codes[full]

    def n_lines(self, rows):
        return np.diff(self._lines(rows)[0])

    def n_dup_lines(self, rows):
        offsets, codes = self._lines(rows)
        text = np.repeat(np.arange(len(rows)), np.diff(offsets))
        distinct = np.unique(text * (codes.max(initial=0) + 1) + codes)
        first = np.bincount(distinct // (codes.max(initial=0) + 1), minlength=len(rows))
        return np.diff(offsets) - first

    def n_stutter(self, rows):
        """Words equal to the word before them."""
        w = self.words(rows)
        same = np.concatenate([[False], w.codes[1:] == w.codes[:-1]]) if len(w.codes) else np.zeros(0, bool)
        starts = w.offsets[:-1]
        same[starts[starts < len(w.codes)]] = False
        return np.diff(np.concatenate([[0], np.cumsum(same)])[w.offsets])

    def n_repeat_words(self, rows):
        """Words inside a window of ``WINDOW`` words that the text holds
        twice or more (windows are compared by 64-bit hashes)."""
        w = self.words(rows)
        hashes, starts = window_hashes(mix64(w.codes.astype(np.uint64) + np.uint64(1)), w.offsets, WINDOW)
        text = np.repeat(np.arange(len(rows)), np.diff(starts))
        key = hashes ^ mix64(text.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at = np.nonzero(twice)[0]
        first = w.offsets[:-1][text[at]] + at - starts[:-1][text[at]]
        edges = np.bincount(first, minlength=len(w.codes) + 1) - np.bincount(first + WINDOW, minlength=len(w.codes) + 1)
        covered = np.concatenate([[0], np.cumsum(np.cumsum(edges)[:-1] > 0)])
        return np.diff(covered[w.offsets])


@dataclass(frozen=True)
class Rule:
    """Rejects where ``rejects(*counts)`` holds, all in whole numbers."""

    name: str
    counts: tuple[str, ...]
    rejects: Callable[..., np.ndarray]
    sql: str  #: the same condition in SQL, over columns of these names


#: Rules of the base verdict, then the others. All thresholds are ratios of counts.
RULES = (
    Rule("few_words", ("n_words",), lambda n: n < 20, "n_words < 20"),
    Rule("repeats", ("n_repeat_words", "n_words"), lambda r, n: 100 * r > 30 * n, "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", ("n_symbols", "n_words"), lambda s, n: 10 * s > n, "10 * n_symbols > n_words"),
    Rule("repeated_lines", ("n_dup_lines", "n_lines"), lambda d, n: 2 * d > n, "2 * n_dup_lines > n_lines"),
    Rule("stutter", ("n_stutter", "n_words"), lambda s, n: 100 * s > 30 * n, "100 * n_stutter > 30 * n_words"),
    Rule("shouting", ("n_upper", "n_letters"), lambda u, n: 2 * u > n, "2 * n_upper > n_letters"),
    Rule("word_length", ("word_chars", "n_words"), lambda c, n: (c < 2 * n) | (c > 30 * n), "(word_chars < 2 * n_words OR word_chars > 30 * n_words)"),
)
BASE = ("few_words", "repeats")


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most about ``most`` bytes of text, one row at least."""
    size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))])
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(size, size[at] + most, "right")) - 1)
        yield at, end - at
        at = end


def cascade(batch: Batch, rules: Sequence[Rule]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """For each text the index of the first of ``rules`` that rejects it (-1:
    none), and the counts made on the way (-1: not needed)."""
    n = len(batch.texts)
    failed, alive, made = np.full(n, -1), np.arange(n), {}
    for i, rule in enumerate(rules):
        if not len(alive):
            break
        for c in rule.counts:
            have = made.setdefault(c, np.full(n, -1, np.int64))
            todo = alive[have[alive] < 0]
            if len(todo):
                have[todo] = getattr(batch, c)(todo)
        bad = rule.rejects(*[made[c][alive] for c in rule.counts])
        failed[alive[bad]] = i
        alive = alive[~bad]
    return failed, made


def order_rules(docs: DataFrame, text_col: str, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """``rules`` by rejections per second, measured on about ``sample_rows``
    rows: a Bernoulli sample of the rows, so a text that very many rows share
    is drawn no more often than its share of them. Only the order of the rules
    hangs on it."""
    n = docs.count()
    sample = docs.select(F.col(text_col).alias("text")).sample(min(1.0, sample_rows / max(1, n)), seed=1)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = TASK_ROWS
        for b in batches:
            b, left = b.slice(0, left), left - min(left, b.num_rows)
            for at, length in slices(b.column(0)):
                for i, rule in enumerate(rules):
                    began = time.perf_counter()
                    batch = Batch(b.column(0).slice(at, length))
                    failed, _ = cascade(batch, [rule])
                    took = time.perf_counter() - began
                    yield pa.RecordBatch.from_pydict({"rule": pa.array([i], pa.int32()), "seconds": [took], "rejected": pa.array([int((failed >= 0).sum())], pa.int64())})

    rows = sample.mapInArrow(giving_back_batches(measure), "rule int, seconds double, rejected bigint").groupBy("rule").agg(F.sum("seconds").alias("s"), F.sum("rejected").alias("r")).collect()
    gain = {r["rule"]: r["r"] / max(r["s"], 1e-9) for r in rows}  # at most one row a rule
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: (-gain.get(i, 0.0), i))]


def judge(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES, counts: Sequence[str] = (),
          keep_columns: Sequence[str] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with ``failed_rule`` (the first rejecting rule in cascade
    order, null: kept), ``kept`` and, where asked for, ``counts``: those that
    the cascade did not need for a document are made after it."""
    ordered = order_rules(docs, text_col, rules, sample_rows)
    passed = list(docs.columns if keep_columns is None else keep_columns)
    src = docs.select(F.col(text_col).alias("_text"), F.struct(*[F.col(f"`{c}`") for c in passed]).alias("_row"))
    names = [r.name for r in ordered]
    fields = ["_row", "failed_rule", "kept", *counts]
    schema = src.select("_row").schema.add("failed_rule", "string").add("kept", "boolean")
    for c in counts:
        schema = schema.add(c, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0)
            for at, length in slices(texts):
                batch = Batch(texts.slice(at, length))
                failed, made = cascade(batch, ordered)
                for c in counts:
                    have = made.setdefault(c, np.full(length, -1, np.int64))
                    rest = np.nonzero(have < 0)[0]
                    if len(rest):
                        have[rest] = getattr(batch, c)(rest)
                rule = pa.array([None if f < 0 else names[f] for f in failed], pa.string())
                yield pa.RecordBatch.from_arrays([b.column(1).slice(at, length), rule, pa.array(failed < 0), *[pa.array(made[c]) for c in counts]], names=fields)

    out = src.mapInArrow(giving_back_batches(run), schema)
    clash = {"failed_rule", "kept", *counts}
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in passed if c not in clash], "failed_rule", "kept", *counts)


def keep_good(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows that no rule rejects, with the columns of ``docs``."""
    ordered = order_rules(docs, text_col, rules, sample_rows)
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]  # the text travels once
    src = docs.select(F.col(text_col).alias("_text"), F.struct(F.lit(0).alias("_none"), *others).alias("_row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, length in slices(b.column(0)):
                failed, _ = cascade(Batch(b.column(0).slice(at, length)), ordered)
                yield b.slice(at, length).filter(pa.array(failed < 0))

    kept = src.mapInArrow(giving_back_batches(run), src.schema)
    return kept.select(*[F.col("_text" if c == text_col else f"_row.`{c}`").alias(c) for c in docs.columns])
