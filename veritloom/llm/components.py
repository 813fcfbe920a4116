"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour."""
    both = edges.select(F.col("big").alias("u"), F.col("small").alias("v")).union(edges.select(F.col("small"), F.col("big")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("big"), F.col("m").alias("small"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    least = edges.groupBy("big").agg(F.min("small").alias("m"))
    others = edges.join(least, "big").where("small <> m").select(F.col("small").alias("big"), F.col("m").alias("small"))
    return others.union(least.select("big", F.col("m").alias("small")))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge.

    Each round is a fixed number of aggregations and equi-joins over the edges,
    written to the shared folder; rounds grow with the logarithm of the longest
    chain.  A node with very many edges is pre-aggregated to its minimum, and
    its edges lie in a join whose hot side may be split.  Only two numbers per
    round reach the driver.
    """
    state = (
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("big"), F.least(a, b).alias("small"))
        .distinct()
    )
    state = written(state, "edges")
    mark = None
    while True:
        now = state.agg(F.count("*"), F.sum(F.xxhash64("big", "small").cast("decimal(38,0)"))).first()
        if now == mark or now[0] == 0:
            break
        mark = now
        after = written(_small_star(_large_star(state).distinct()).distinct(), "edges")
        discard(state)
        state = after
    roots = state.select("small").distinct()
    return state.select(F.col("big").alias("node"), F.col("small").alias("component")).union(roots.select("small", "small"))
