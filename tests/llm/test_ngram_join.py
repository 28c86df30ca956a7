"""The n-gram join against brute force over all pairs."""

import re
from itertools import combinations

import pytest
from llm_fixtures import HARD_TEXTS, SF0001, documents, long_text  # noqa: F401

from eventlens.llm import ngram_join
from eventlens.llm.components import connected
from eventlens.llm.queries import QUERIES

_UPPER = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_UPPER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def roots(pairs, nodes):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def brute(rows):
    """(doc_id, n_shingles, component) for rows (doc_id, text); ids unique."""
    sets = [shingles(t) for _, t in rows]
    links = []
    for (i, a), (j, b) in combinations(list(enumerate(sets)), 2):
        if a and b and 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)):
            both = len(a & b)
            if 100 * both >= 75 * (len(a) + len(b) - both):
                links.append((rows[i][0], rows[j][0]))
    top = roots(links, [d for d, _ in rows])
    return sorted((d, len(s), top[d]) for (d, _), s in zip(rows, sets))


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in QUERIES["op9_ngram_jaccard"](spark, SF0001).collect())
    assert got == brute(rows)


def near_copies(n):
    """A chain: each text differs a little from the one before."""
    words = [f"t{i}" for i in range(60)]
    out = []
    for i in range(n):
        words[(i * 11) % 60] = f"x{i}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("blocks", [1, 8])
def test_hard_cases(spark, long_text, blocks):
    passage = " ".join(f"p{i}" for i in range(30))
    texts = HARD_TEXTS + HARD_TEXTS[3:9] + ["A B C D", "a b c d e", "A b C d E", "a b c d f"] + near_copies(60)
    texts += [f"{passage} own{i} " + " ".join(f"q{i}_{k}" for k in range(i % 12)) for i in range(80)]
    texts += [long_text, long_text + " tail", long_text[: len(long_text) * 3 // 4 + 9], long_text.upper()]
    rows = [((i * 37) % 1009, t) for i, t in enumerate(texts)]
    spark.conf.set("spark.sql.shuffle.partitions", blocks)
    try:
        got = sorted(tuple(r) for r in ngram_join.components(documents(spark, rows, ["n", "sid", "component_id"])).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert got == brute(rows)


def test_empty_null_ids_and_repeated_rows(spark):
    assert ngram_join.components(documents(spark, [])).count() == 0
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (7, "z y x w v u"), (5, "z y x w v u"), (None, None), (9, None)]
    got = sorted((tuple(r) for r in ngram_join.components(documents(spark, rows)).collect()), key=str)
    assert got == sorted([(None, 2, None), (7, 2, 7), (7, 2, 7), (7, 2, 5), (5, 2, 5), (None, 0, None), (9, 0, 9)], key=str)


def test_components_on_paths_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(300, 300)]
    got = {r.node: r.component for r in connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = roots([e for e in edges if e[0] != e[1]], {n for e in edges if e[0] != e[1] for n in e})
    assert got == want
    assert connected(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
