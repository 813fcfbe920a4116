"""Projections: capped breadth-first neighbourhoods with each node's strongest edges.

Graph: ``nodes`` (node_id, node_type, topic_labels, ...), ``weights`` (source,
target, weight, edge_ord), ``edges`` (source, target, type, edge_ord).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut, numbered


@dataclass(frozen=True)
class ProjectionParameters:
    coherence_threshold: float = 0.5
    top_k_per_node: int = 5
    max_depth: int = 3
    max_nodes: int = 100
    topic_filter: bool = False

    def __post_init__(self) -> None:
        if not 0 <= self.coherence_threshold <= 1 or min(self.top_k_per_node, self.max_depth, self.max_nodes) < 1:
            raise ValueError(f"out of range: {self}")


# Threshold, edges per node, depth and nodes of the seven perspectives.
PERSPECTIVES = [(0.2, 5, 1, 50), (0.2, 3, 5, 100), (0.5, 5, 1, 30), (0.5, 4, 3, 60), (0.7, 3, 2, 25), (0.7, 2, 4, 50), (0.9, 2, 1, 15)]


#: Arrivals of a level that one task may rank.
ONE_TASK = 100_000


@dataclass(frozen=True)
class Projection:
    params: ProjectionParameters
    nodes: DataFrame
    edges: DataFrame
    metadata: DataFrame


def coherent(weights: DataFrame, threshold: float) -> DataFrame:
    """Weighted edges at or above a coherence threshold."""
    return weights.where(F.col("weight") >= threshold)


def neighbors(weights: DataFrame, edges: DataFrame, threshold: float) -> DataFrame:
    """(node, other, weight, kind, edge_ord) from either end; weighted edges (kind 0) come first."""
    w = coherent(weights, threshold).select("source", "target", "weight", F.lit(0).alias("kind"), "edge_ord")
    e = edges.select("source", "target", F.lit(1.0).alias("weight"), F.lit(1).alias("kind"), "edge_ord")
    both = w.union(e)
    return both.select(F.col("source").alias("node"), F.col("target").alias("other"), "weight", "kind", "edge_ord").union(both.select("target", "source", "weight", "kind", "edge_ord"))


def passes_topics(adjacent: DataFrame, nodes: DataFrame) -> DataFrame:
    """Weighted steps between labelled atomic nodes need a common label."""
    labels = F.coalesce("topic_labels", F.array().cast("array<string>"))
    mine = nodes.select(F.col("node_id").alias("node"), labels.alias("_own"))
    yours = nodes.select(F.col("node_id").alias("other"), F.col("node_type").alias("_kind"), labels.alias("_their"))
    ok = (F.col("kind") == 1) | (F.size("_own") == 0) | (F.col("_kind") != "atomic") | F.arrays_overlap("_own", "_their")
    return adjacent.join(mine, "node").join(yours, "other").where(ok).select(adjacent.columns)


def discover(focus: str, nodes: DataFrame, weights: DataFrame, edges: DataFrame, params: ProjectionParameters) -> DataFrame:
    """(node_id, rank, depth) in the order a first-in-first-out search reaches them, up to the cap.

    Level by level: a node's first arrival decides its place, so ranking a
    level's arrivals by (parent's rank, kind, edge order) gives the queue's order.
    A level holds at most ``max_nodes`` rows; edges are joined, never collected.
    """
    adjacent = neighbors(weights, edges, params.coherence_threshold)
    if params.topic_filter:
        adjacent = passes_topics(adjacent, nodes)
    found = cut(nodes.where(F.col("node_id") == focus).limit(1).select("node_id", F.lit(0).cast("bigint").alias("rank"), F.lit(0).alias("depth")))
    level, total = found, found.count()
    if not total:
        raise ValueError(f"no such node: {focus}; the first atomic ones are: " + ", ".join(r["node_id"] for r in first_atomic(nodes).collect()))
    for depth in range(1, params.max_depth + 1):
        room = params.max_nodes - total
        if room <= 0:
            break
        arrivals = level.select(F.col("node_id").alias("node"), "rank").join(adjacent, "node").groupBy(F.col("other").alias("node_id")).agg(F.min(F.struct("rank", "kind", "edge_ord")).alias("key"))
        fresh = arrivals.join(found.select("node_id"), "node_id", "left_anti").join(nodes.select("node_id"), "node_id", "left_semi")
        fresh = cut(fresh)
        fresh_count = fresh.count()
        chosen = fresh if fresh_count <= room else fresh.orderBy("key", "node_id").limit(room)
        if min(fresh_count, room) <= ONE_TASK:
            ranked = chosen.withColumn("rank", (F.row_number().over(Window.orderBy("key", "node_id")) - 1 + total).cast("bigint"))
        else:
            ranked = numbered(chosen, "rank", "key", "node_id").withColumn("rank", F.col("rank") + total)
        level = cut(ranked.select("node_id", "rank", F.lit(depth).alias("depth")))
        n = level.count()
        if not n:
            break
        found, total = cut(found.union(level)), total + n
    return found


def first_atomic(nodes: DataFrame, n: int = 10) -> DataFrame:
    """The first atomic nodes, as an error about a missing focus names them."""
    return nodes.where("node_type = 'atomic'").orderBy("node_ord").limit(n).select("node_id", F.substring("statement", 1, 60).alias("statement") if "statement" in nodes.columns else F.lit(None).cast("string").alias("statement"))


def extract_edges_flat(members: DataFrame, weights: DataFrame, edges: DataFrame, threshold: float) -> DataFrame:
    """All weighted edges at or above the threshold and all directed ones, within the members."""
    from ..operators.graph import edges_within

    w = edges_within(coherent(weights, threshold), members).select("source", "target", F.lit("related_to").alias("edge_type"), "weight")
    e = edges_within(edges, members).select("source", "target", F.col("type").alias("edge_type"), F.lit(None).cast("double").alias("weight"))
    return w.union(e)


def extract_edges(members: DataFrame, weights: DataFrame, edges: DataFrame, threshold: float, k: int) -> DataFrame:
    """Each member's k strongest weighted edges, each pair once, and all directed edges, within the members."""
    from ..operators.graph import edges_within

    inside = edges_within(coherent(weights, threshold), members).select("source", "target", "weight", "edge_ord")
    ends = inside.select(F.col("source").alias("node"), F.col("target").alias("other"), "*").union(inside.select(F.col("target"), F.col("source"), "*"))
    best = Window.partitionBy("node").orderBy(F.desc("weight"), "other", "edge_ord")
    top = ends.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k)
    pair = (F.least("source", "target").alias("_a"), F.greatest("source", "target").alias("_b"))
    pairs = top.groupBy(*pair).agg(F.min(F.struct("edge_ord", "source", "target", "weight")).alias("e"))
    w = pairs.select("e.source", "e.target", F.lit("related_to").alias("edge_type"), "e.weight")
    e = edges_within(edges, members).select("source", "target", F.col("type").alias("edge_type"), F.lit(None).cast("double").alias("weight"))
    return w.union(e)


def metadata(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_count, edge_count, average_degree, density."""
    n = nodes.agg(F.count("*").alias("node_count"))
    m = edges.agg(F.count("*").alias("edge_count"))
    both = n.select("node_count", m.scalar().alias("edge_count"))
    possible = F.when(F.col("node_count") > 1, F.col("node_count") * (F.col("node_count") - 1) / 2).otherwise(F.lit(1.0))
    return both.select(
        "node_count",
        "edge_count",
        F.when(F.col("node_count") > 0, F.round(2 * F.col("edge_count") / F.col("node_count"), 2)).otherwise(0.0).alias("average_degree"),
        F.round(F.col("edge_count") / possible, 4).alias("density"),
    )


def project(focus: str, nodes: DataFrame, weights: DataFrame, edges: DataFrame, params: ProjectionParameters) -> Projection:
    members = discover(focus, nodes, weights, edges, params)
    inside = nodes.join(members.select("node_id"), "node_id", "left_semi")
    kept = extract_edges(members, weights, edges, params.coherence_threshold, params.top_k_per_node)
    return Projection(params, inside, kept, metadata(inside, kept))


def perspective_suite(focus: str, nodes: DataFrame, weights: DataFrame, edges: DataFrame) -> list[Projection]:
    return [project(focus, nodes, weights, edges, ProjectionParameters(*p)) for p in PERSPECTIVES]


def best_focus(nodes: DataFrame, weights: DataFrame, edges: DataFrame) -> DataFrame:
    """The atomic node with most edges; the first (by node_ord) of equals."""
    from ..operators.graph import both_ways

    ends = both_ways(weights.select("source", "target").union(edges.select("source", "target")))
    counts = ends.groupBy(F.col("node").alias("node_id")).agg(F.count("*").alias("degree"))
    atomic = nodes.where("node_type = 'atomic'").join(counts, "node_id", "left").na.fill(0, ["degree"])
    return atomic.orderBy(F.desc("degree"), "node_ord").limit(1).select("node_id", "degree")
