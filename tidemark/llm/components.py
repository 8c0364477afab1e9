"""Connected components of a graph given as a table of edges.

Alternates two rewritings until nothing changes: every node links its larger
neighbours to the smallest node around it, then its smaller neighbours. Both
need only minima per node (combined before the shuffle) and one join, which
adaptive execution may split for a node with very many edges. Every round is
written to the shared store, so its lineage does not grow and a lost executor
costs one round at most; the round before it is removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, written


def _linked(edges: DataFrame, larger: bool) -> DataFrame:
    """Edges (v, m): m is the smallest of u and its neighbours. Larger: for
    neighbours v > u; smaller: of each edge's larger end u, for v < u and u."""
    ends = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))  # a > b
    around = ends.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))) if larger else ends
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    if larger:
        out = around.where("v > u").join(least, "u").select("v", "m")
    else:
        out = ends.join(least, "u").select("v", "m").unionByName(least.select(F.col("u").alias("v"), "m"))
    return out.where("v > m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Columns node, root (smallest node of its component) of all nodes that
    have an edge to another node. Null ends and loops are dropped; repeated
    edges and either direction are fine."""
    ends = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x != y")
    now = written(ends.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges")
    state = None
    while True:
        before, now = now, written(_linked(_linked(now, True), False), "edges")
        discard(before)
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if seen == state:
            break
        state = seen
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
