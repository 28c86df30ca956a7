"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``edges`` (two long columns) to (node, component): the smallest node
    that can be reached. Nodes without an edge to another node are left out.

    Each round points the larger neighbours of every node, then the smaller
    ones, at its smallest neighbour (large-star and small-star), until the
    edges no longer change; they are then stars around the smallest nodes.
    Only minima are gathered per node, in partial aggregates, so a node with
    very many edges needs no large group. Each round's edges are written to
    the shared folder.
    """
    u, v = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    e = materialize(edges.where(F.col(a) != F.col(b)).select(u, v).distinct(), "edges")
    before = None
    while True:
        mark = tuple(e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        if mark == before or not mark[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = mark
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy(F.col("u").alias("n")).agg(F.least("n", F.min("v")).alias("m")), "least")
        large = both.join(least, F.col("u") == F.col("n")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large")  # from here on u > v
        down = materialize(large.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m")), "down")
        small = large.join(down, F.col("u") == F.col("n")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(small.unionByName(down.select(F.col("n").alias("u"), F.col("m").alias("v"))).distinct(), "edges")
