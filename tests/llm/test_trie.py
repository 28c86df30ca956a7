"""Conversation trie against a trie of Python dictionaries."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from llm_fixtures import SF0001, long_text  # noqa: F401
from pyspark.sql import functions as F

from eventlens.llm import conv_trie
from eventlens.llm.queries import QUERIES, rebuilt

SCHEMA = "conv_id long, turn long, role string, text string"


def ordered(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        r, x = r or "", x or ""
        convs[c].append((t is not None, t or 0, hashlib.md5(f"{len(r)}:{r}{x}".encode()).hexdigest(), r, x))
    return {c: [v[3:] for v in sorted(turns)] for c, turns in convs.items()}


def heads(convs):
    out = {}
    for c, turns in convs.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 6
        base = [] if c is None else convs.get(c - int(c / 100) * 100 if False else c - (abs(c) % 100) * (1 if c >= 0 else -1), [])
        out[c] = base[:h] + turns[h:]
    return out


def brute(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    least = {p: min((c for c in cs if c is not None), default=None) for p, cs in members.items()}
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        leaves[p] = sum(leaves[k] for k in children[p]) if children[p] else 1
        saved[p] = own + sum(saved[k] for k in children[p])
    out = []
    for p, cs in members.items():
        ends = sorted(c for c in cs if len(convs[c]) == len(p) and c is not None)
        out.append((least[p], len(p), least[p[:-1]] if p else None, len(cs), len(children[p]), leaves[p], saved[p],
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=repr)


def forest(seed, n, deep):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        rows += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "", None, "é😀"])) for t in range(rng.randrange(1, deep))]
    return rows


@pytest.mark.parametrize("slots", [1, 2, 4, 5])
def test_against_dictionaries(spark, slots):
    rows = forest(3, 60, 12) + [(500 + i, t, "user", "same") for i in range(30) for t in range(9)]
    rows += [(600, None, "user", "null turn"), (600, 0, "user", "x"), (600, 0, "user", "x"), (600, 0, "assistant", "y"), (-3, 1, "a", "b"), (-3, -1, "a", "bb")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ord", F.lit("clash"))
    turns = conv_trie.number_turns(df.repartition(4))
    assert result(conv_trie.prefix_trie(turns, turns.select("conv_id").distinct(), slots)) == brute(ordered(rows))


@pytest.mark.parametrize("stride", [2, 4096])
def test_long_conversations_and_strides(spark, long_text, monkeypatch, stride):
    """One conversation with most rows, a copy that leaves it late, and a null id."""
    monkeypatch.setattr(conv_trie, "STRIDE", stride)
    rows = [(c, t, "user", f"t{t}" if c < 2 or t < 70 else "other") for c in (0, 1, 2) for t in range(90)]
    rows += [(9, 0, "user", long_text), (10, 0, "user", long_text), (10, 1, "user", long_text + "!"), (None, 0, "user", "t0"), (None, 1, "user", "t1")]
    turns = conv_trie.number_turns(spark.createDataFrame(rows, SCHEMA))
    convs = spark.createDataFrame([(c,) for c in (0, 1, 2, 9, 10, None, 11, 12)], "conv_id long")
    assert result(conv_trie.prefix_trie(turns, convs)) == brute(ordered(rows) | {11: [], 12: []})


def test_rebuilt_conversations(spark):
    rows = [r for c in (0, 1, 2, 3, 50, 99, 100, 101, 150, 205, 399, -1, -100, -105, 1200, 1201) for r in
            [(c, t, "user" if t % 2 else "assistant", f"{c // 100 if c % 3 else c} {t}") for t in range(abs(c) % 7 + 1)]] + [(None, 0, "user", "n"), (None, 1, "user", "m")]
    turns, convs = rebuilt(conv_trie.number_turns(spark.createDataFrame(rows, SCHEMA)))
    want = heads(ordered(rows))
    assert any(not t for t in want.values())
    assert result(conv_trie.prefix_trie(turns, convs)) == brute(want)


def test_empty_and_one(spark):
    def trie(rows):
        turns = conv_trie.number_turns(spark.createDataFrame(rows, SCHEMA))
        return result(conv_trie.prefix_trie(turns, turns.select("conv_id").distinct()))

    assert trie([]) == []
    assert trie([(5, None, None, None)]) == brute({5: [("", "")]})


def test_query(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SF0001}/conversations.parquet").collect()]
    assert result(QUERIES["op12_conversation_trie"](spark, SF0001)) == brute(heads(ordered(rows)))
