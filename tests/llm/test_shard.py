"""Shards against the documents themselves."""

import zlib
from collections import Counter

import pytest
from llm_fixtures import HARD_TEXTS, SF0001, documents, long_text  # noqa: F401

from eventlens.llm import shard
from eventlens.llm.queries import QUERIES


def check(rows, texts, n_shards, slack):
    """rows: (doc_id, shard, slot); slack: what the bytes may differ by."""
    size = {d: len((t or "").encode()) + 1 for d, t in texts.items()}
    assert Counter(d for d, _, _ in rows) == Counter(texts.keys())
    total, by = sum(size.values()), Counter()
    slots = {}
    for d, s, k in rows:
        assert 0 <= s < n_shards
        by[s] += size[d]
        slots.setdefault(s, []).append(k)
    for ks in slots.values():
        assert sorted(ks) == list(range(len(ks)))
    assert all(abs(by[s] - total / n_shards) <= slack for s in range(n_shards)), by


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect()}
    rows = QUERIES["op2_histogram_shards"](spark, SF0001).collect()
    check([(r.doc_id, r.shard, r.slot) for r in rows], texts, 16, max(len(t.encode()) for t in texts.values()) + 1)
    for r in rows:
        assert r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        assert r.law == "bytes" and r.grown_shard is None


@pytest.mark.parametrize("chunk", [32 << 20, 500])
def test_hot_text_is_cut(spark, chunk):
    texts = {i: "the same text" if i % 3 else f"text {i} " * (i % 9) for i in range(3000)}
    df = shard.shard_documents(documents(spark, texts.items(), ["_h", "_size"]), 16, chunk_bytes=chunk)
    check([(r.doc_id, r.shard, r.slot) for r in df.collect()], texts, 16, 80)


def test_hard_texts_null_ids_and_empty(spark, long_text):
    rows = [(None, t) for t in HARD_TEXTS] + [(1, "same")] * 5 + [(2, long_text), (3, None)]
    df = shard.shard_documents(documents(spark, rows, ["shard", "slot"]), 4)
    got = df.collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows) and df.columns[-2:] == ["shard", "slot"]
    for s in range(4):
        ks = sorted(r.slot for r in got if r.shard == s)
        assert ks == list(range(len(ks)))
    assert len({r.shard for r in got if r.doc_id == 1}) == 1
    assert shard.shard_documents(documents(spark, []), 4).count() == 0
    assert shard.shard_documents(documents(spark, [(1, "x")]), 4).count() == 1
