"""Connected components by alternating star contraction; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm import _common as C


#: Degree from which a node's neighbours are not brought to one task.
HUB = 200
#: How many such nodes may be sent to every executor.
BROADCAST_HUBS = 1_000_000


def _beside(edges: DataFrame, low: DataFrame) -> DataFrame:
    """edges with the m of low(a, m, n) for their a; the few nodes of high degree are broadcast, so that their edges stay where they are."""
    low = C.materialize(low, "lowest")
    hubs = low.where(F.col("n") > HUB)
    if not 0 < hubs.count() <= BROADCAST_HUBS:
        return edges.join(low.drop("n"), "a")
    rest = edges.join(F.broadcast(hubs.select("a")), "a", "left_anti").join(low.where(F.col("n") <= HUB).drop("n"), "a")
    return edges.join(F.broadcast(hubs.drop("n")), "a").unionByName(rest)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of edges(a, b); the component is its smallest node.

    A round hangs the larger neighbours of each node, then the node and its smaller neighbours, on its smallest one.
    Edges never grow in number; a few rounds are enough, and each ends in a written table.
    """
    edges = C.materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = _beside(both, low).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = C.materialize(large, "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = _beside(large, low).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        edges = C.materialize(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components: not settled after {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", F.col("b").alias("component")).distinct())
