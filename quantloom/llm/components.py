"""Connected components of an edge table by alternating star contraction.

Every round is two aggregations and joins on edge tables; nothing is collected
but the number of changed rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import discard, saved


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them; u > v in all edges."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).filter("u <> v")


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for nodes that have edges.

    ``edges`` has long columns u and v; loops, repeats and both directions are allowed.
    Ends when the edge table is a set of stars, that is, when no node has two parents
    and no parent has one; the number of rounds grows with the logarithm of the nodes.
    """
    current = saved(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    for _ in range(most_rounds):
        parents = current.groupBy("u").agg(F.count("*").alias("n"))
        twice = parents.filter("n > 1").limit(1).count()
        if not twice and not current.join(parents.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count():
            break
        before, current = current, saved(_small_star(_large_star(current).distinct()).distinct(), "cc")
        discard(before)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    own = current.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(own)
