"""Snapshots of projections: deterministic 3-D places, sizes, colours and visibility."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import display_label, hex_seed
from .graph import degree, weighted_degree

# Colours by node and edge type, and those of other types.
NODE_COLORS = {"atomic": "#4A90E2", "context": "#9B9B9B"}
EDGE_COLORS = {"related_to": "#00AAFF", "depends_on": "#E74C3C", "appears_in": "#FFFFFF"}
OTHER_NODE, OTHER_EDGE = "#999999", "#CCCCCC"
# Constants of the force layout.
RADIUS, REST, REPULSION, SPRING, DAMPING, SOFTENING, ITERATIONS = 10.0, 2.0, 500, 0.05, 0.85, 0.01, 200
#: A weight of zero counts as this in the layout (a spring's rest length divides by it).
LEAST_WEIGHT = 1e-3


def seed_3d(focus: Column, threshold: Column, depth: Column) -> Column:
    """The layout's seed; the threshold prints as the shortest decimal."""
    return hex_seed(F.sha2(F.concat_ws("_", focus, threshold.cast("string"), depth.cast("string")), 256))


def seed_2d(path: Column) -> Column:
    return hex_seed(F.md5(path))


def color(kind: Column, table: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for name, value in table.items():
        out = F.when(kind == name, F.lit(value)).otherwise(out)
    return out


def without_contexts(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    context = nodes.where("node_type = 'context'").select("node_id")
    kept = edges.join(context.withColumnRenamed("node_id", "source"), "source", "left_anti").join(context.withColumnRenamed("node_id", "target"), "target", "left_anti")
    return nodes.where("node_type = 'atomic'"), kept


def size_scale(importance: Column, least: Column, most: Column) -> Column:
    norm = (importance - least) / (most - least + 0.01)
    return 0.3 + F.pow(F.greatest(norm, F.lit(0.0)), F.lit(0.7)) * 2.7


def _places(n: int, links: list[tuple[int, int, float]], seed: int, rounds: int) -> list[list[float]]:
    """Coordinates after ``rounds`` of forces, from seeded places on a sphere."""
    rng = random.Random(seed)
    place = []
    for _ in range(n):
        turn, tilt = rng.uniform(0, 2 * math.pi), rng.uniform(0, math.pi)
        place.append([RADIUS * math.sin(tilt) * math.cos(turn), RADIUS * math.sin(tilt) * math.sin(turn), RADIUS * math.cos(tilt)])
    place = np.array(place).reshape(n, 3)
    speed = np.zeros((n, 3))
    ends = np.array([(a, b) for a, b, _ in links], np.int64).reshape(-1, 2)
    rest, pull = np.array([REST / (w**1.5) for *_, w in links]), np.array([w**2 for *_, w in links])
    for _ in range(rounds):
        gap = place[None, :, :] - place[:, None, :]  # [from, to, axis]
        squared = gap[..., 0] * gap[..., 0] + gap[..., 1] * gap[..., 1] + gap[..., 2] * gap[..., 2] + SOFTENING
        push = ((gap / np.sqrt(squared)[..., None]) * (REPULSION / squared)[..., None]).sum(axis=0)
        if len(ends):
            gap = place[ends[:, 1]] - place[ends[:, 0]]
            far = np.sqrt(gap[:, 0] * gap[:, 0] + gap[:, 1] * gap[:, 1] + gap[:, 2] * gap[:, 2] + SOFTENING)
            part = (gap / far[:, None]) * (SPRING * (far - rest) * pull)[:, None]
            np.add.at(push, ends.ravel(), np.stack([part, -part], axis=1).reshape(-1, 3))
        speed = (speed + push) * DAMPING
        place = place + speed
    return place.tolist()


def force_layout(nodes: list[str], edges: list[tuple[str, str, float]], seed: int, rounds: int = ITERATIONS) -> dict[str, tuple[float, float, float]]:
    """Places of one projection's nodes (at most its node cap), equal for equal input."""
    at = {node: k for k, node in enumerate(nodes)}
    links = [(at[s], at[t], max(w, LEAST_WEIGHT)) for s, t, w in edges]
    return {node: tuple(p) for node, p in zip(nodes, _places(len(nodes), links, seed, rounds), strict=True)}


def layout_3d(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(projection_id, node_id, x, y, z) for many projections at once.

    ``nodes``: projection_id, node_id, node_ord; ``edges``: projection_id,
    source, target, weight, edge_ord; ``seeds``: projection_id, seed.  A group is
    one projection, bounded by its node cap.
    """
    packed = (
        nodes.groupBy("projection_id").agg(F.sort_array(F.collect_list(F.struct("node_ord", "node_id"))).alias("nodes"))
        .join(edges.groupBy("projection_id").agg(F.sort_array(F.collect_list(F.struct("edge_ord", "source", "target", F.coalesce("weight", F.lit(0.5)).alias("weight")))).alias("edges")), "projection_id", "left")
        .join(seeds, "projection_id")
    )

    def run(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                names = [n["node_id"] for n in row.nodes]
                links = [] if row.edges is None else [(e["source"], e["target"], e["weight"]) for e in row.edges]
                found = force_layout(names, links, int(row.seed))
                yield pd.DataFrame([(row.projection_id, n, *found[n]) for n in names], columns=["projection_id", "node_id", "x", "y", "z"])

    return packed.select("projection_id", "nodes", "edges", "seed").mapInPandas(run, "projection_id bigint, node_id string, x double, y double, z double")


def styled_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with degree, importance, size, colour and label."""
    ends = nodes.join(degree(edges).withColumnRenamed("node", "node_id"), "node_id", "left").join(weighted_degree(edges).withColumnRenamed("node", "node_id"), "node_id", "left").na.fill({"degree": 0, "importance": 0.0})
    scores = weighted_degree(edges)
    least, most = scores.agg(F.coalesce(F.min("importance"), F.lit(0.0))).scalar(), scores.agg(F.coalesce(F.max("importance"), F.lit(1.0))).scalar()
    label = F.when(F.col("node_type") == "atomic", display_label(F.col("statement"), 40)).otherwise(F.concat(F.lit("Context: "), F.coalesce("source_file", F.lit("unknown"))))
    return ends.select(
        "node_id", "node_type", "degree", "importance", size_scale(F.col("importance"), least, most).alias("size"), color(F.col("node_type"), NODE_COLORS, OTHER_NODE).alias("color"), label.alias("label"),
        F.least(F.col("degree") / 20, F.lit(0.5)).alias("emissive"),
    )


def styled_edges(edges: DataFrame) -> DataFrame:
    weight = F.coalesce("weight", F.lit(0.5))
    return edges.select("source", "target", weight.alias("weight"), "type", color(F.col("type"), EDGE_COLORS, OTHER_EDGE).alias("color"), F.least(F.greatest(weight, F.lit(0.2)), F.lit(1.0)).alias("opacity"))


def snapshot(nodes: DataFrame, edges: DataFrame, seed: int, keep_contexts: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, metadata) of one projection's 3-D snapshot.

    ``nodes``: node_id, node_type, statement, source_file, node_ord; ``edges``:
    source, target, edge_type, weight.  Without contexts, unless they are kept.
    """
    kept = edges.withColumnRenamed("edge_type", "type")
    if not keep_contexts:
        nodes, kept = without_contexts(nodes, kept)
    one = F.lit(1).cast("bigint").alias("projection_id")
    spark = nodes.sparkSession
    places = layout_3d(nodes.select(one, "node_id", "node_ord"), kept.select(one, "source", "target", "weight", F.concat_ws(" ", "source", "target", "type").alias("edge_ord")), spark.range(1).select(one, F.lit(seed).cast("bigint").alias("seed")))
    styled = styled_nodes(nodes, kept)
    whole = F.when(F.col("node_type") == "atomic", F.col("statement")).alias("full_statement")
    points = styled.join(nodes.select("node_id", whole), "node_id").join(places.select("node_id", "x", "y", "z"), "node_id")
    meta = snapshot_metadata(kept, nodes).withColumns({"layout_algorithm": F.lit("deterministic_force_3d_weighted"), "layout_seed": F.lit(seed).cast("bigint"), "filtered_context_nodes": F.lit(not keep_contexts)})
    return points, styled_edges(kept), meta


def snapshot_metadata(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    scores, ends = weighted_degree(edges), degree(edges)
    return nodes.agg(F.count("*").alias("node_count")).select(
        "node_count",
        edges.agg(F.count("*")).scalar().alias("edge_count"),
        F.coalesce(ends.agg(F.max("degree")).scalar(), F.lit(0)).cast("bigint").alias("max_degree"),
        F.coalesce(scores.agg(F.max("importance")).scalar(), F.lit(0.0)).alias("max_importance"),
        F.coalesce(scores.agg(F.min("importance")).scalar(), F.lit(0.0)).alias("min_importance"),
    )


# Camera distances and the share of the importance range that hides a node.
DETAIL_BANDS = [(25, 0.0), (50, 0.25), (100, 0.5), (150, 0.75)]


def visible_nodes(nodes: DataFrame, distance: float, scale: float = 1.0) -> DataFrame:
    """``nodes`` (node_id, degree, importance) with ``visible`` at a camera distance."""
    worth = F.when(F.coalesce("importance", F.lit(0.0)) != 0, F.col("importance")).otherwise(F.col("degree").cast("double"))
    marked = nodes.withColumn("_worth", worth)
    least, most = marked.agg(F.min("_worth")).scalar(), marked.agg(F.max("_worth")).scalar()
    share = next((s for limit, s in DETAIL_BANDS if distance < limit * scale), None)
    edge = most - 0.5 if share is None else least + (most - least) * share
    return marked.withColumn("visible", F.col("_worth") >= edge).drop("_worth")


def visible_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    seen = nodes.where("visible").select("node_id")
    return edges.join(seen.withColumnRenamed("node_id", "source"), "source", "left_semi").join(seen.withColumnRenamed("node_id", "target"), "target", "left_semi")


def top_labels(nodes: DataFrame, n: int = 30) -> DataFrame:
    return nodes.orderBy(F.desc("importance"), "node_id").limit(n)


def circular_layout(nodes: DataFrame) -> DataFrame:
    """Places on the unit circle in order of node_ord (from 0), within each projection."""
    from pyspark.sql import Window

    n = F.count("*").over(Window.partitionBy("projection_id"))
    angle = 2 * math.pi * F.col("node_ord") / n
    return nodes.select("projection_id", "node_id", F.cos(angle).alias("x"), F.sin(angle).alias("y"))
