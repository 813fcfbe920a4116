"""From texts to a truth delta: extract, validate, deduplicate, relate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_terms, content_hash, context_id, node_id, stability_hash
from ..operators import extract, relate, similarity
from ..operators.graph import TruthDelta, orphans
from ..operators.labels import default_labels
from ..operators.validate import reason, violations
from .lineage import cut, numbered


def statements(docs: DataFrame, strict: bool = True) -> DataFrame:
    """Every unit of every text (doc_id, source_file, text) with its violations."""
    units = extract.explode_units(docs.withColumn("context_id", context_id(F.col("text"))), extract.parse(F.col("text")), "doc_id", "context_id", "source_file")
    return units.withColumn("violations", violations(F.col("text"), strict))


def first_of_each(nodes: DataFrame) -> DataFrame:
    """One row of each node id: the first by (doc_id, ord)."""
    at = Window.partitionBy("node_id").orderBy("doc_id", "ord")
    return nodes.withColumn("_r", F.row_number().over(at)).where(F.col("_r") == 1).drop("_r")


def ingest(
    docs: DataFrame, known: DataFrame | None = None, similarity_k: int = 10, strict: bool = True, fuzzy: bool = True, author: str | None = None, scope: str = "document"
) -> TruthDelta:
    """The delta of a corpus of texts (doc_id, source_file, text) against nodes already ``known``.

    Equal statements are dropped across all texts, near duplicates within a
    document or, with ``scope="corpus"``, across all of them in order of
    (doc_id, ord) and after those already known (node_id, statement).
    Evidence names the context of the text.
    """
    if scope not in ("document", "corpus"):
        raise ValueError(f"no such scope: {scope}")
    found = cut(statements(docs, strict))
    valid = found.where(F.size("violations") == 0)
    if fuzzy and scope == "document":
        units = valid.withColumnRenamed("doc_id", "scope").select("scope", "ord", "text")
        valid = valid.join(similarity.fuzzy_dedup(units).select(F.col("scope").alias("doc_id"), "ord"), ["doc_id", "ord"], "left_semi")
    elif fuzzy:
        units = valid.select(F.lit(0).alias("scope"), F.struct(F.lit(1).alias("new"), "doc_id", "ord").alias("ord"), "text")
        if known is not None and "statement" in known.columns:
            before = known.where("statement is not null").select(F.lit(0).alias("scope"), F.struct(F.lit(0).alias("new"), F.xxhash64("node_id").alias("doc_id"), F.lit(0).cast("bigint").alias("ord")).alias("ord"), F.col("statement").alias("text"))
            units = units.union(before)
        stays = similarity.fuzzy_dedup(units).where("ord.new = 1").select("ord.doc_id", F.col("ord.ord").alias("ord"))
        valid = valid.join(stays, ["doc_id", "ord"], "left_semi")
    evidence = F.array(F.struct(F.col("context_id").alias("source"), F.struct("start", "end").alias("span"), F.lit(1.0).alias("confidence"))).alias("evidence")
    named = valid.select(
        "doc_id", "ord", "context_id", "source_file", node_id(F.col("text")).alias("node_id"), F.col("text").alias("statement"), canonical_terms(F.col("text")).alias("terms"), default_labels(F.col("text")).alias("topic_labels"),
        stability_hash(F.col("text")).alias("stability_hash"), evidence,
    )
    nodes = cut(first_of_each(named))
    if known is not None:
        nodes = cut(nodes.join(known.select("node_id"), "node_id", "left_anti"))
    scoped = relate.number_within(nodes.withColumnRenamed("doc_id", "scope").drop("ord").withColumn("_at", F.col("evidence")[0]["span"]["start"]), "scope", "_at", "node_id").drop("_at")
    scoped = cut(scoped)
    contexts = docs.select(context_id(F.col("text")).alias("node_id"), F.lit("context").alias("node_type"), "source_file", content_hash(F.col("text")).alias("content_hash"), F.lit(author).alias("author"), "doc_id")
    contexts = contexts.groupBy("node_id").agg(F.min_by(F.struct("node_type", "source_file", "content_hash", "author", "doc_id"), "doc_id").alias("c")).select("node_id", "c.*")
    atomic = nodes.select("node_id", F.lit("atomic").alias("node_type"), "statement", F.col("terms").alias("canonical_terms"), "topic_labels", "evidence", "stability_hash")
    edges = relate.appears_in(scoped)
    for make, type_ in ((relate.derived_from, "derived_from"), (relate.refines, "refines"), (relate.depends_on, "depends_on")):
        edges = edges.unionByName(relate.typed_edges(scoped, make(scoped), type_))
    weights = similarity.similarity_edges(scoped.withColumn("text", F.col("statement")), similarity_k).select("source", "target", "type", "weight", "metadata")
    no_id = F.lit(None).cast("string").alias("proposed_node_id")
    rejected = found.where(F.size("violations") > 0).select(F.col("text").alias("statement"), reason(F.col("violations")).alias("reason"), evidence, no_id)
    alone = orphans(atomic, edges.select("source", "target", "type").union(weights.select("source", "target", "type")))
    candidates = rejected.union(alone.select("statement", F.lit("Lacks connectivity to other nodes"), "evidence", "node_id"))
    records = numbered(contexts.select(F.col("node_id").alias("context_node_id"), "source_file", "doc_id"), "seq", "doc_id", "context_node_id")
    records = records.select(F.format_string("prov_%06d", F.col("seq")).alias("record_id"), "context_node_id", "source_file")
    return TruthDelta(atomic.unionByName(contexts.drop("doc_id"), allowMissingColumns=True), edges, weights, candidates, records)
