"""The truth layer: integrity, deltas, connectivity and statistics of a graph.

``nodes``: node_id, node_type, ...; ``edges``: source, target, type, ...;
``weights``: source, target, weight, ...; ``candidates``: statement, reason, ...
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TruthDelta:
    nodes: DataFrame
    edges: DataFrame
    weights: DataFrame
    candidates: DataFrame
    provenance: DataFrame


def delta(now: TruthDelta, before: TruthDelta) -> TruthDelta:
    """What ``now`` has beyond ``before``; candidates are never compared."""
    return TruthDelta(
        now.nodes.join(before.nodes.select("node_id"), "node_id", "left_anti"),
        now.edges.join(before.edges.select("source", "target", "type"), ["source", "target", "type"], "left_anti"),
        now.weights.join(before.weights.select("source", "target"), ["source", "target"], "left_anti"),
        now.candidates,
        now.provenance,
    )


def both_ways(edges: DataFrame) -> DataFrame:
    """(node, other) of every edge from either end."""
    return edges.select(F.col("source").alias("node"), F.col("target").alias("other")).union(edges.select("target", "source"))


def connectivity(edges: DataFrame) -> DataFrame:
    """Distinct neighbours (node, other)."""
    return both_ways(edges).distinct()


def orphans(nodes: DataFrame, edges: DataFrame, ignore_types: tuple[str, ...] = ()) -> DataFrame:
    """Atomic nodes without any edge (of types that count)."""
    counted = edges.where(~F.col("type").isin(*ignore_types)) if ignore_types else edges
    ends = both_ways(counted).select(F.col("node").alias("node_id"))
    return nodes.where("node_type = 'atomic'").join(ends, "node_id", "left_anti")


def edges_within(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends among ``members`` (node_id)."""
    ids = members.select("node_id").distinct()
    return edges.join(ids.withColumnRenamed("node_id", "source"), "source", "left_semi").join(ids.withColumnRenamed("node_id", "target"), "target", "left_semi")


def edge_lookup(edges: DataFrame, a: str, b: str) -> DataFrame:
    """The first edge (by edge_ord) between two nodes, in either direction."""
    hit = ((F.col("source") == a) & (F.col("target") == b)) | ((F.col("source") == b) & (F.col("target") == a))
    return edges.where(hit).orderBy("edge_ord").limit(1)


def node_lookup(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.where(F.col("node_id") == node_id).limit(1)


def edge_type_distribution(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.coalesce("type", F.lit("unknown")).alias("type")).agg(F.count("*").alias("n"))


def degree(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("node").agg(F.count("*").alias("degree"))


# What an edge of a type counts for in a node's importance.
IMPORTANCE = {"depends_on": 2.0, "related_to": 1.0, "appears_in": 0.5}


def weighted_degree(edges: DataFrame) -> DataFrame:
    """Importance: weights (0.5 where missing) times the type's factor, over a node's edges."""
    factor = F.lit(1.0)
    for type_, value in IMPORTANCE.items():
        factor = F.when(F.col("type") == type_, F.lit(value)).otherwise(factor)
    worth = F.coalesce("weight", F.lit(0.5)) * factor
    ends = edges.select(F.col("source").alias("node"), worth.alias("w")).union(edges.select("target", worth))
    return ends.groupBy("node").agg(F.sum("w").alias("importance"))


def degree_distribution(edges: DataFrame) -> DataFrame:
    return degree(edges).groupBy("degree").agg(F.count("*").alias("n_nodes"))


def degree_summary(edges: DataFrame) -> DataFrame:
    """Greatest and mean degree over nodes that have edges."""
    return degree(edges).agg(F.max("degree").alias("max_degree"), F.avg("degree").alias("average_degree"))


def graph_stats(nodes: DataFrame, edges: DataFrame, weights: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row of counts and ratios."""
    tagged = (
        nodes.select(F.when(F.col("node_type") == "atomic", "atomic").otherwise("context").alias("kind"), F.lit(None).cast("double").alias("weight"))
        .union(edges.select(F.lit("edge"), F.lit(None).cast("double")))
        .union(weights.select(F.lit("weight"), F.col("weight")))
        .union(candidates.select(F.lit("candidate"), F.lit(None).cast("double")))
    )
    n = lambda kind: F.count_if(F.col("kind") == kind)
    return tagged.agg(
        n("atomic").alias("atomic_nodes"), n("context").alias("context_nodes"), n("edge").alias("directed_edges"), n("weight").alias("weighted_edges"), n("candidate").alias("candidates"), F.avg("weight").alias("mean_weight")
    ).select(
        "*",
        F.when(F.col("atomic_nodes") > 0, (F.col("directed_edges") + F.col("weighted_edges")) / F.col("atomic_nodes")).alias("avg_connectivity"),
        (F.col("candidates") / F.greatest(F.col("atomic_nodes"), F.lit(1))).alias("candidate_ratio"),
    )


def engine_statistics(nodes: DataFrame, edges: DataFrame, weights: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row of the sizes of a graph, and how many atomic nodes have no edge."""
    ends = edges.select("source", "target", "type").union(weights.select("source", "target", "type"))
    alone = orphans(nodes, ends).agg(F.count("*")).scalar()
    stats = graph_stats(nodes, edges, weights, candidates)
    return stats.select("atomic_nodes", "context_nodes", "directed_edges", "weighted_edges", "candidates", alone.alias("orphans"))


def validate_structure(stats: DataFrame) -> DataFrame:
    """Warnings about a graph, from :func:`graph_stats`."""
    total = F.col("atomic_nodes") + F.col("context_nodes")
    many = F.when(F.col("candidates") > 0.5 * total, F.lit("high candidate ratio"))
    bare = F.when((F.col("directed_edges") == 0) & (total > 1), F.lit("no edges"))
    return stats.select(total.alias("nodes"), "directed_edges", "weighted_edges", "candidates", F.array_join(F.array_compact(F.array(many, bare)), "; ").alias("warnings"))


def provenance(contexts: DataFrame) -> DataFrame:
    """A running record for every context, in order of ``seq``."""
    return contexts.withColumn("record_id", F.format_string("prov_%06d", F.col("seq")))
