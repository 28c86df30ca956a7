"""Line dedup against plain Python; the stream over every way to cut it."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from llm_fixtures import HARD_TEXTS, documents, long_text  # noqa: F401
from pyspark.sql import functions as F

from eventlens.llm import line_dedup
from eventlens.llm.queries import QUERIES

UPPER = {c: c + 32 for c in range(65, 91)}


def key_of(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(UPPER)


def brute(rows, min_docs=10, min_chars=1):
    found = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key_of(line)) >= min_chars:
                found[key_of(line)].add((i, text or ""))
    gone = {k for k, ds in found.items() if len(ds) >= min_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key_of(x) not in gone]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def corpus(long_text):
    rng = random.Random(5)
    shared = [f"Shared line {k}" for k in range(6)] + ["\t HOT line \r", "hot LINE", "é", "É", "", " ", "x\x0by"]
    rows = []
    for i in range(120):
        lines = [rng.choice(shared) if rng.random() < 0.6 else f"own {i} {k}" for k in range(rng.randrange(0, 9))]
        rows.append((i, "\n".join(["hot line"] * (i % 3 > 0) + lines)))
    rows += [(200 + i, t) for i, t in enumerate(HARD_TEXTS)]
    rows += [(300 + i, "copy of all\nhot line\nend") for i in range(40)]
    rows += [(None, "copy of all\nhot line"), (None, "other"), (0, "another text of id 0\nHot Line"), (7, rows[7][1]), (7, rows[7][1])]
    rows += [(400, long_text.replace(" ", "\n")), (401, long_text), (402, "only\n" * 3000 + "hot line"), (403, "hot line\n" * 20000)]
    return rows


def result(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in df.collect()), key=repr)


@pytest.mark.parametrize("min_docs,min_chars", [(10, 1), (1, 4), (2, 1), (41, 1)])
def test_against_brute_force(spark, long_text, min_docs, min_chars):
    rows = corpus(long_text)
    df = documents(spark, rows, ["n_lines", "_d", "bitmap"]).repartition(5)
    got = line_dedup.dedup_lines(df, min_docs=min_docs, min_chars=min_chars)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "_d", "bitmap", "n_lines", "n_dropped"]
    assert result(got) == brute(rows, min_docs, min_chars)


def test_first_occurrences_stay(spark, long_text):
    rows = [(i, t) for i, t in corpus(long_text) if i is not None and i < 400]
    got = line_dedup.dedup_lines(documents(spark, rows).repartition(7), keep="first", min_docs=1)
    kept = [key_of(x) for i, _, _, t in {r[0:1] + r[3:]: r for r in result(got)}.values() for x in t.split("\n") if key_of(x)]
    every = {key_of(x) for _, t in rows for x in (t or "").split("\n")} - {""}
    assert len(kept) == len(set(kept)) and set(kept) == every
    with pytest.raises(ValueError):
        line_dedup.keep_bitmaps(documents(spark, rows), keep="last")


def test_empty_table_and_bitmaps(spark):
    assert line_dedup.dedup_lines(documents(spark, [])).count() == 0
    rows = [(i, f"a\nb\nc{i}\n" + "z\n" * i) for i in range(12)]
    maps = line_dedup.keep_bitmaps(documents(spark, rows), min_docs=10).collect()
    assert sorted(m._d for m in maps) == list(range(12))
    for m in maps:
        lines = rows[m._d][1].split("\n")
        keep = line_dedup.unpack_bitmap(m.bitmap, len(lines))
        assert [x for x, k in zip(lines, keep) if k] == [f"c{m._d}", ""] and m.n_dropped == (~keep).sum()
    for n in (1, 7, 8, 9, 64, 1000):
        gone = np.unique(np.random.default_rng(n).integers(0, n, n // 3 + 1))
        assert np.flatnonzero(~line_dedup.unpack_bitmap(line_dedup.pack_bitmap(gone), n + 5)).tolist() == gone.tolist()


@pytest.mark.parametrize("min_docs,keep_first", [(1, True), (3, False), (3, True), (5, False), (1000, True)])
def test_stream_of_any_cuts(min_docs, keep_first):
    """The same decisions wherever partitions (between documents) and batches are cut."""
    rng = np.random.default_rng(min_docs)
    for _ in range(60):
        n = int(rng.integers(1, 60))
        rows = np.zeros((n, 5), np.int64)
        rows[:, 0], rows[:, 2], rows[:, 4] = rng.integers(0, rng.integers(1, 6), n), rng.integers(0, 8, n), rng.integers(0, 9, n)
        rows = rows[np.lexsort((rows[:, 4], rows[:, 2], rows[:, 0]))]
        want = set()
        for h in np.unique(rows[:, 0]):
            of = rows[rows[:, 0] == h]
            if len(np.unique(of[:, 2])) >= min_docs:
                want |= {(h, k) for k in range(int(keep_first), len(of))}
        between = [i for i in range(1, n) if (rows[i, [0, 2]] != rows[i - 1, [0, 2]]).any()]
        parts = np.split(np.arange(n), sorted(rng.choice(between, min(len(between), int(rng.integers(0, 5))), replace=False)) if between else [])
        out, order = [], {}
        for i, r in enumerate(rows):
            order.setdefault(r[0], i)
        for p, at in enumerate(parts):
            stream = line_dedup.KeyStream(min_docs, keep_first)
            marked = rows[at].copy()
            marked[:, 4] = at  # a position of its own for every row
            made = [x for piece in np.array_split(marked, int(rng.integers(1, 8))) for x in stream.feed(piece)] + stream.end()
            assert len(stream.held) <= n
            out += [(*r, p) for x in made for r in x.tolist()]
        docs, first = defaultdict(int), {}
        for kind, h, *_, k, p in out:
            if kind == 2:
                docs[h] += k
                first[h] = min(first.get(h, p), p)
        got = {(h, pos - order[h]) for kind, h, _, _, _, pos, k, p in out
               if kind == 0 or (kind == 1 and docs[h] >= min_docs and not (keep_first and k == 1 and p == first[h]))}
        assert got == want


def test_hot_key_over_many_partitions(spark):
    """A line of all documents is cut over partitions and still counted once a document."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("hot\nown "), F.col("id").cast("string"), F.lit("\nHOT ")).alias("text"))
        got = line_dedup.dedup_lines(df, min_docs=3000)
        assert got.where("text = concat('own ', doc_id) AND n_lines = 3 AND n_dropped = 2").count() == 3000
        assert line_dedup.dedup_lines(df, min_docs=3001).where("n_dropped = 0").count() == 3000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_query_digests(spark):
    from llm_fixtures import SF0001
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect()]
    want = [(i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in brute(rows)]
    got = QUERIES["op11_line_bitmaps"](spark, SF0001)
    assert sorted(tuple(r) for r in got.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()) == sorted(want)
