"""Capped multi-source traversal and reachability over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.versioned import staged


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of ``edges(src, dst)``, without repeats and self-loops."""
    return edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src <> dst").distinct()


def neighbour_counts(edges: DataFrame) -> DataFrame:
    """Distinct neighbours of each node in either direction."""
    return undirected(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("neighbours"))


def capped_traversal(edges: DataFrame, seeds: DataFrame, depth: int, cap: int | None, directed: bool = False) -> DataFrame:
    """Breadth-first traversal from ``seeds(node, origin, seed_rank)``: node, depth, origins, seed_rank.

    A node takes the least depth, all origins and the smallest rank of its parents in the level before. With ``cap``
    each level keeps the best nodes by (rank, node) until so many nodes are reached, then the traversal ends.
    """
    # Repeated edges fall together when a level's nodes are grouped, so there is no distinct over all edges.
    both = edges.select("src", "dst")
    both = both.filter("src <> dst") if directed else both.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src <> dst")
    level = seeds.groupBy("node").agg(F.array_sort(F.collect_set("origin")).alias("origins"), F.min("seed_rank").alias("seed_rank")).withColumn("depth", F.lit(0))
    reached, count = level, level.count() if cap is not None else 0
    for d in range(1, depth + 1):
        if cap is not None and count >= cap:
            break
        following = level.join(both, level["node"] == both["src"]).select(F.col("dst").alias("node"), "origins", "seed_rank")
        following = following.join(reached.select("node"), "node", "left_anti")
        following = following.groupBy("node").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("origins")))).alias("origins"), F.min("seed_rank").alias("seed_rank")).withColumn("depth", F.lit(d))
        if cap is not None:
            following = following.orderBy("seed_rank", "node").limit(cap - count)
        level = staged(following)
        if cap is not None:
            count += level.count()
        reached = reached.unionByName(level)
    return reached.select("node", "depth", F.array_join("origins", ",").alias("origins"), "seed_rank")


def frontier(relations: DataFrame, nodes: DataFrame, limit: int = 200) -> DataFrame:
    """The first ``limit`` outgoing and incoming relations of a frontier, in the order in which nodes are admitted."""
    out = relations.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").withColumn("direction", F.lit("out"))
    into = relations.join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").withColumn("direction", F.lit("in"))
    order = Window.partitionBy("direction").orderBy("relation_type", "src", "dst")
    return out.unionByName(into).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


def within_budget(relations: DataFrame, nodes: DataFrame, budget: int) -> DataFrame:
    """Relations at some nodes in order of type and ends, as long as their summed ``cost`` stays within the budget.

    Every admitted relation costs 1 at least, so the first ``budget`` ones are enough to look at; they are what the sum
    runs over.
    """
    near = relations.join(nodes.select(F.col("node").alias("src")).distinct(), "src", "left_semi").unionByName(relations.join(nodes.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi"))
    first = near.distinct().orderBy("relation_type", "src", "dst").limit(budget)
    used = F.sum(F.greatest("cost", F.lit(1))).over(Window.orderBy("relation_type", "src", "dst").rowsBetween(Window.unboundedPreceding, 0))
    return first.withColumn("used", used).filter(F.col("used") <= budget).select("src", "dst", "relation_type", "used")
