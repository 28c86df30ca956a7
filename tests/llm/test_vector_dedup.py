"""Near vectors against all cosines, and the graph's recall."""

import numpy as np
import pytest
from llm_fixtures import SF0001

from eventlens.llm import vector_dedup
from eventlens.llm.hnsw import Graph
from eventlens.llm.queries import QUERIES

SF01 = "/root/testdata/sf0.01"


def brute(rows, threshold=0.93):
    """rows: (id, vector or None, label); ids unique."""
    ok = [i for i, (_, v, lab) in enumerate(rows) if lab is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    links = {i: set() for i in range(len(rows))}
    for key in {(rows[i][2], len(rows[i][1])) for i in ok}:
        own = [i for i in ok if (rows[i][2], len(rows[i][1])) == key]
        x = np.array([rows[i][1] for i in own], np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(x @ x.T >= threshold)):
            if a != b:
                links[own[a]].add(own[b])
    least, todo = {}, set(range(len(rows)))
    while todo:
        group, stack = set(), [todo.pop()]
        while stack:
            i = stack.pop()
            if i not in group:
                group.add(i)
                stack += links[i]
        todo -= group
        for i in group:
            least[i] = min(rows[j][0] for j in group)
    return sorted((r[0], len(links[i]), least[i], least[i] == r[0]) for i, r in enumerate(rows))


@pytest.mark.parametrize("shard_rows", [4096, 40])
def test_whole_table(spark, shard_rows):
    t = spark.read.parquet(f"{SF01}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding), r.label) for r in t.collect()]
    got = sorted(tuple(r) for r in vector_dedup.near_vectors(t, shard_rows=shard_rows).collect())
    assert got == brute(rows)


def test_query(spark):
    t = spark.read.parquet(f"{SF0001}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding), r.label) for r in t.collect()]
    assert sorted(tuple(r) for r in QUERIES["op8_hnsw_dedup"](spark, SF0001).collect()) == brute(rows)


def clusters(n, width=16):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, width))
    out = []
    for i in range(n):
        spread = [0.02, 0.2, 0.45, 2][i % 4]
        out.append((centres[i % 6 if i % 3 else 0] + rng.normal(scale=spread, size=width)).astype(np.float32).tolist())
    return out


def test_hard_vectors(spark):
    vs = clusters(400)
    bad = [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0], [2.0], [-1.0]]
    rows = [(i * 3, v, i % 2 if i % 50 else None) for i, v in enumerate(vs + vs[:40] * 3 + bad + bad)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").selectExpr("*", "'x' AS node", "'y' AS component_id", "'z' AS m")
    got = sorted(tuple(r) for r in vector_dedup.near_vectors(df, shard_rows=90).collect())
    assert got == brute(rows)


def test_magnitudes(spark):
    base = [[1.0, 2.0, 3.0], [1.0, 2.0, 3.0001], [-1.0, 2.0, -3.0], [3.0, -2.0, 1.0]]
    scales = [1e200, 1e-200, 1.0, 1.7e308 / 3.0001, 5e-324, -1e250]
    rows = [(k * 10 + i, [c * s for c in v], 1) for k, s in enumerate(scales) for i, v in enumerate(base)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = {r.vec_id: tuple(r) for r in vector_dedup.near_vectors(df, shard_rows=7).collect()}
    assert sorted(got.values()) == brute(rows)
    assert all(got[k][1] >= 1 for k in (0, 1, 10, 11, 30, 31))


def test_null_ids_repeated_rows_and_empty(spark):
    schema = "vec_id bigint, embedding array<float>, label int"
    assert vector_dedup.near_vectors(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (4, [0.0, 1.0], 1), (2, [0.0, 1.0], 1), (9, [1.0, 0.0], 2)]
    got = sorted((tuple(r) for r in vector_dedup.near_vectors(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(None, 2, None, False), (4, 2, 4, True), (4, 2, 4, True), (4, 1, 2, False), (2, 1, 2, True), (9, 0, 9, True)], key=str)


@pytest.mark.parametrize("n", [1, 2, 3, 31, 700])
def test_graph_recall(n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = Graph(x).build()
    again = Graph.load(x, g.dump())
    q = x + rng.normal(scale=0.03, size=x.shape)
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    seen = again.search(q, 32, 0.9)
    best = seen.argmax(axis=1)
    assert (best == np.arange(n)).mean() >= 0.97
    truth, found = q @ x.T >= 0.9, seen >= 0.9 - 1e-6
    assert (truth & found).sum() >= 0.97 * truth.sum() and not (found & (q @ x.T < 0.9 - 1e-4)).any()


def test_audit_widens_the_beam():
    x = np.random.default_rng(1).normal(size=(300, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = Graph(x).build()
    g.layers = [(g.layers[0][0], g.layers[0][1][:, :2])]  # a poor graph
    found = vector_dedup.find_links(g, x, x, 0.8, 1, 64, 0.95)
    truth = x @ x.T >= 0.8
    assert (found & truth).sum() >= 0.85 * truth.sum() and not (found & ~truth).any()


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def poor(x):
    g = Graph(x).build()
    g.layers = [(nodes, links[:, :2]) for nodes, links in g.layers]
    return g


def pairs_and_a_group(n=4096, width=24):
    """A third of the vectors are near copies of one, the others are pairs."""
    rng = np.random.default_rng(5)
    group = unit(rng.normal(size=(1, width))) + rng.normal(scale=0.02, size=(n // 3, width))
    first = unit(rng.normal(size=((n - n // 3) // 2, width)))
    x = unit(np.concatenate([group, first, first + rng.normal(scale=0.04, size=first.shape)]))
    return x[rng.permutation(len(x))]


def test_audit_counts_queries_not_links():
    x = pairs_and_a_group()
    truth = x @ x.T >= 0.93
    g = Graph(x).build()
    lost = np.nonzero(truth.sum(axis=1) < 10)[0][::2]  # no way to half of those in pairs
    g.layers = [(nodes, np.where(np.isin(nodes[links], lost), -1, links)) for nodes, links in g.layers]
    found = vector_dedup.find_links(g, x, x, 0.93, 32, 64, 0.99)
    found |= found.T
    whole = (found & truth).sum(axis=1) >= 0.99 * truth.sum(axis=1)
    assert whole.mean() >= 0.99 and not (found & ~truth).any()
    audit = vector_dedup.audited_links(g, x, x, 0.93, 32, 64, 0.99, own=True)[1]
    assert audit["passed"] >= 0.99 * audit["audited"] and audit["audited"] == 128


def test_audit_of_shards_with_few_common_partners():
    rng = np.random.default_rng(6)
    x = unit(rng.normal(size=(4096, 24)))
    q = unit(rng.normal(size=(4096, 24)))
    some = rng.choice(4096, 20, replace=False)
    q[some] = unit(x[rng.choice(4096, 20, replace=False)] + rng.normal(scale=0.04, size=(20, 24)))
    truth = q @ x.T >= 0.93
    assert truth[np.linspace(0, 4095, 64).astype(int)].sum() == 0  # an even sample of the queries has no answer
    found = vector_dedup.find_links(poor(x), x, q, 0.93, 32, 64, 0.99)
    assert truth.sum() >= 20 and (found == truth).all()


def test_audit_rows_per_label(spark):
    rows = [(i, v, i % 2) for i, v in enumerate(clusters(400))]
    got = vector_dedup.search_audits(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int"), shard_rows=90).collect()
    assert sorted(r.label for r in got) == [0, 1]
    assert all(r.pairs == 6 and r.audited > 0 and r.passed >= 0.99 * r.audited and r.found <= r.true for r in got)
