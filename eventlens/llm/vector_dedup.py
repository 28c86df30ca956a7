"""Near-duplicate vectors by HNSW graphs per shard (operator 8).

Vectors of a label are dealt by hash into shards of at most about
``SHARD_ROWS``; equal vectors are one, with a count. Each shard's graph is
built once and written. Every shard is then searched for the vectors of every
shard of its label (each pair of shards once, a link counts for both sides).
A search follows the links of whatever reaches the threshold, and its beam is
doubled until an audit passes, query by query, against brute force over the
shard. Audited are queries that have an answer there: of the task's own as many
as a bounded search finds, and vectors of the shard moved by up to the
threshold. Cosines of what was found are verified in double precision, links are counted, and each task
sends on a star of edges for every group it has united, never the pairs.

Defined cases: a vector that is null, empty, zero or holds a null, NaN or
infinity, and one without a label or of another length than the one compared,
links with nothing; finite vectors of any magnitude are compared (each is
scaled by its largest component first); a null id has no component and names none; rows of equal
id are separate vectors; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .components import connected
from .hnsw import LINKS, Graph

THRESHOLD = 0.93
SHARD_ROWS = 4096
BEAM = 32
#: Queries of either kind that a task audits, the share of them that must pass, which is also the share of its links
#: that a query must find, and the task's own queries that are compared with all to find some with an answer.
AUDIT_ROWS, AUDIT_RECALL = 64, 0.99
AUDIT_TRIED = 1024
BLOCK = 256


def _matrix(shard: pa.Table) -> np.ndarray:
    """The unit vectors of a shard's row."""
    return np.frombuffer(shard["vectors"][0].as_py(), np.float64).reshape(-1, shard["width"][0].as_py())


def _build(table: pa.Table) -> pa.Table:
    v = np.array(table.column("v").to_pylist(), np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    graph = Graph(v).build()
    row = {"label": table.column("label")[0].as_py(), "width": v.shape[1], "shard": table.column("shard")[0].as_py(), "shards": table.column("shards")[0].as_py(),
           "nodes": table.column("node").to_pylist(), "counts": table.column("m").to_pylist(), "vectors": v.tobytes(), "graph": graph.dump()}
    return pa.Table.from_pylist([row], pa.schema(_SHARD_ARROW))


_SHARD = "label bigint, width int, shard int, shards int, nodes array<bigint>, counts array<bigint>, vectors binary, graph binary"
_SHARD_ARROW = [("label", pa.int64()), ("width", pa.int32()), ("shard", pa.int32()), ("shards", pa.int32()), ("nodes", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("vectors", pa.binary()), ("graph", pa.binary())]


def _reach(graph: Graph, unit: np.ndarray, queries: np.ndarray, threshold: float, beam: int) -> np.ndarray:
    """Which (query, node) reach the threshold, among those the search saw."""
    slack = 1e-4  # of single precision; what is near is computed again in double
    found = np.zeros((len(queries), len(unit)), bool)
    for at in range(0, len(queries), BLOCK):
        q = queries[at : at + BLOCK]
        r, c = np.nonzero(graph.search(q, beam, threshold - slack) >= threshold - slack)
        exact = np.concatenate([np.einsum("kd,kd->k", q[r[k : k + 65536]], unit[c[k : k + 65536]]) for k in range(0, max(1, len(r)), 65536)])
        found[at + r[exact >= threshold], c[exact >= threshold]] = True
    return found


def _own_samples(unit: np.ndarray, queries: np.ndarray, threshold: float, rows: int, own: bool, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``rows`` of the queries that have links, and these links. In its
    ``own`` shard a query's link with itself is no answer."""
    order = rng.permutation(len(queries))[:AUDIT_TRIED]
    picked, links, have = [order[:0]], [np.zeros((0, len(unit)), bool)], 0
    for at in range(0, len(order), BLOCK):
        part = order[at : at + BLOCK]
        truth = queries[part] @ unit.T >= threshold
        if own:
            truth[np.arange(len(part)), part] = False
        some = np.nonzero(truth.any(axis=1))[0][: rows - have]
        picked.append(part[some])
        links.append(truth[some])
        have += len(some)
        if have >= rows:
            break
    return queries[np.concatenate(picked)], np.concatenate(links)


def _moved_samples(unit: np.ndarray, threshold: float, rows: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the shard turned to a cosine between the threshold and 1,
    and the links of each."""
    x = unit[rng.permutation(len(unit))[:rows]]
    aside = rng.normal(size=x.shape)
    aside -= np.einsum("kd,kd->k", aside, x)[:, None] * x
    length = np.linalg.norm(aside, axis=1, keepdims=True)
    cosine = rng.uniform(min(max(threshold, -1.0), 1.0), 1.0, size=(len(x), 1))
    q = np.where(length > 1e-9, cosine * x + np.sqrt(1 - cosine**2) * aside / np.maximum(length, 1e-9), x)
    truth = q @ unit.T >= threshold
    some = truth.any(axis=1)
    return q[some], truth[some]


def audited_links(graph: Graph, unit: np.ndarray, queries: np.ndarray, threshold: float, beam: int, audit_rows: int, audit_recall: float,
                  own: bool = False) -> tuple[np.ndarray, dict[str, int]]:
    """Which (query, node) reach the threshold, and the audit's counts:
    queries audited, those that passed, their links, and the links found. A
    query passes with the share ``audit_recall`` of its own links, and that
    share of the queries of each kind must pass. Beams are tried on the
    samples; where a beam's links are as many as the shard's nodes and the
    audit still fails, all cosines are taken."""
    rng = np.random.default_rng(11)
    kinds = [_own_samples(unit, queries, threshold, audit_rows, own, rng), _moved_samples(unit, threshold, audit_rows, rng)]
    audit = {"audited": sum(len(q) for q, _ in kinds), "true": sum(int(truth.sum()) for _, truth in kinds)}
    while True:
        hits = [(_reach(graph, unit, q, threshold, beam) & truth).sum(axis=1) for q, truth in kinds]
        passed = [hit >= audit_recall * truth.sum(axis=1) for hit, (_, truth) in zip(hits, kinds)]
        if all(p.sum() >= audit_recall * len(p) for p in passed):
            audit |= {"passed": sum(int(p.sum()) for p in passed), "found": sum(int(h.sum()) for h in hits)}
            return _reach(graph, unit, queries, threshold, beam), audit
        if beam * LINKS >= len(unit):  # the graph has no way there: compare with all, in blocks
            found = np.zeros((len(queries), len(unit)), bool)
            for at in range(0, len(queries), BLOCK):
                found[at : at + BLOCK] = queries[at : at + BLOCK] @ unit.T >= threshold
            return found, audit | {"passed": audit["audited"], "found": audit["true"]}
        beam *= 2


def find_links(graph: Graph, unit: np.ndarray, queries: np.ndarray, threshold: float, beam: int, audit_rows: int, audit_recall: float) -> np.ndarray:
    """The links of ``audited_links`` alone."""
    return audited_links(graph, unit, queries, threshold, beam, audit_rows, audit_recall)[0]


def _stars(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each linked node with one node of its group in this pair of shards."""
    ids = np.concatenate([left, right])
    mark = ids.copy()
    n = len(left)
    while True:
        before = mark.copy()
        for at in range(0, n, BLOCK):  # the least mark across each link, both ways
            part = links[at : at + BLOCK]
            low = np.where(part, mark[n:], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
            mark[at : at + len(part)] = np.minimum(mark[at : at + len(part)], low)
            back = np.where(part, mark[at : at + len(part), None], np.iinfo(np.int64).max).min(axis=0, initial=np.iinfo(np.int64).max)
            mark[n:] = np.minimum(mark[n:], back)
        if (mark == before).all():
            linked = mark != ids
            return ids[linked], mark[linked]


#: Columns of a task's audit row, whose node is null.
_AUDIT = ("label", "audited", "passed", "true", "found")


def _search(threshold: float, beam: int, audit_rows: int, audit_recall: float):
    def run(_: tuple, index: pa.Table, queries: pa.Table) -> pa.Table:
        out: dict[str, list] = {"node": [], "links": [], "root": []}
        audits: list[dict] = []
        if len(index) and len(queries):
            x, q = _matrix(index), _matrix(queries)
            x_nodes, q_nodes = (np.array(t["nodes"][0].as_py(), np.int64) for t in (index, queries))
            x_counts, q_counts = (np.array(t["counts"][0].as_py(), np.int64) for t in (index, queries))
            own = index["shard"][0].as_py() == queries["shard"][0].as_py()
            links, audit = audited_links(Graph.load(x, index["graph"][0].as_py()), x, q, threshold, beam, audit_rows, audit_recall, own)
            audits.append({"label": index["label"][0].as_py(), **audit})
            if own:
                links |= links.T
                links[np.arange(len(x)), np.arange(len(x))] = False
            per_query = links @ x_counts
            node, root = _stars(links, q_nodes, x_nodes)
            sides = [(q_nodes, per_query)] if own else [(q_nodes, per_query), (x_nodes, q_counts @ links)]
            nodes, counts = (np.concatenate(s) for s in zip(*sides))
            some = counts > 0
            out = {"node": np.concatenate([nodes[some], node]), "links": np.concatenate([counts[some], np.zeros(len(node), np.int64)]),
                   "root": np.concatenate([nodes[some], root])}
        schema = pa.schema([(k, pa.int64()) for k in (*out, *_AUDIT)])
        rows = pa.Table.from_pydict({k: pa.array(out.get(k, [None] * len(out["node"])), pa.int64()) for k in schema.names}, schema)
        return pa.concat_tables([rows, pa.Table.from_pylist(audits, schema)])

    return run


def _searched(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, threshold: float, shard_rows: int, beam: int, audit_rows: int,
              audit_recall: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with their node, distinct vectors, and what the search of all
    pairs of shards returned, links and audit rows, written."""
    v = F.col(vector_col).cast("array<double>")
    base = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("bigint").alias("label"), v.alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    sound = F.coalesce(F.col("label").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda c: c != 0), F.lit(False))
    base = base.withColumn("node", F.when(sound, F.xxhash64("label", "v")))
    distinct = materialize(base.where("node IS NOT NULL").groupBy("node").agg(
        F.any_value("label").alias("label"), F.any_value("v").alias("v"), F.count(F.lit(1)).alias("m"), F.min("vec_id").alias("least")), "vectors")
    sizes = materialize(distinct.groupBy(F.col("label").alias("l"), F.size("v").alias("width")).agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards")), "vector-counts")
    dealt = distinct.join(sizes, (F.col("label") == F.col("l")) & (F.size("v") == F.col("width")))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int"))
    graphs = materialize(dealt.select("label", "width", "shard", "shards", "node", "m", "v").groupBy("label", "width", "shard").applyInArrow(_build, _SHARD), "graphs")
    shard, last = F.col("shard"), F.col("shards") - 1
    index = graphs.withColumn("x", shard).withColumn("y", F.explode(F.sequence(F.lit(0), shard)))
    queries = graphs.drop("graph").withColumn("y", shard).withColumn("x", F.explode(F.sequence(shard, last)))
    key = ["label", "width", "x", "y"]
    schema = ", ".join(f"`{c}` bigint" for c in ("node", "links", "root", *_AUDIT))
    pairs = index.groupBy(*key).cogroup(queries.groupBy(*key)).applyInArrow(_search(threshold, beam, audit_rows, audit_recall), schema)
    return base, distinct, materialize(pairs, "vector-links")


def search_audits(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD,
                  shard_rows: int = SHARD_ROWS, beam: int = BEAM, audit_rows: int = AUDIT_ROWS, audit_recall: float = AUDIT_RECALL) -> DataFrame:
    """One row per label: ``pairs`` of shards searched, queries ``audited``
    and ``passed``, their ``true`` links and those ``found``."""
    found = _searched(vectors, id_col, vector_col, label_col, threshold, shard_rows, beam, audit_rows, audit_recall)[2]
    return found.where("node IS NULL").groupBy("label").agg(F.count(F.lit(1)).alias("pairs"), *[F.sum(c).alias(c) for c in _AUDIT[1:]])


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD,
                 shard_rows: int = SHARD_ROWS, beam: int = BEAM, audit_rows: int = AUDIT_ROWS, audit_recall: float = AUDIT_RECALL) -> DataFrame:
    """One row per vector: ``vec_id``, ``n_links``, ``component_id`` and
    ``kept`` (the vector names its component)."""
    base, distinct, found = _searched(vectors, id_col, vector_col, label_col, threshold, shard_rows, beam, audit_rows, audit_recall)
    found = found.where("node IS NOT NULL").select("node", "links", "root")
    counts = found.groupBy(F.col("node").alias("n")).agg(F.sum("links").alias("links"))
    roots = connected(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = distinct.select("node", "m", "least").join(counts, F.col("node") == F.col("n"), "left").drop("n")
    named = named.join(roots.select(F.col("node").alias("n"), "component"), F.col("node") == F.col("n"), "left")
    named = materialize(named.select("node", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), "least", F.coalesce("component", "node").alias("root")), "vector-groups")
    smallest = materialize(named.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("smallest")), "smallest")
    by_node = materialize(named.join(smallest, F.col("root") == F.col("r")).select(F.col("node").alias("n"), "n_links", "smallest"), "vector-components")
    out = base.select("vec_id", "node").join(by_node, F.col("node") == F.col("n"), "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("smallest", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
