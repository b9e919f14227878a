"""Connected components as joins and aggregations over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; the component is its smallest node.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the edges form stars. A step is a minimum
    by node (pre-aggregated before the shuffle) and a join that adaptive execution may split, so a node with very many
    edges does not gather in one task. Edges may repeat, point either way, or join a node to itself; null ends are
    ignored. Every step's edges are a table in the shared folder.
    """
    edges = materialise(
        edges.filter("a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    links = edges.filter("u <> v")
    state = before = None
    while True:
        # large-star: every larger neighbour of a node moves to the node's smallest neighbour
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        links = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small-star: a node and its smaller neighbours move to the smallest of them
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        moved = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        links = materialise(moved.union(least.select("u", F.col("m").alias("v"))).distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if before is not None:
            discard(before)  # the last step's edges are read for the last time
        before = links
        if now == state:
            break
        state = now
    return nodes.join(links.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


class Forest:
    """Union-find over positions 0..n-1 inside one task."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
