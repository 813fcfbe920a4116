"""Readers of texts, chat exports, truth documents and projections, and their writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import TruthDelta
from ..plans.lineage import cut

EVIDENCE = "array<struct<source:string,span:array<int>,confidence:double>>"
TRUTH = (
    "nodes_added array<struct<node_id:string,statement:string,canonical_terms:array<string>,topic_labels:array<string>,"
    f"evidence:{EVIDENCE},stability_hash:string,created_at:string,node_type:string,source_file:string,content_hash:string,metadata:map<string,string>>>, "
    f"edges_added array<struct<source:string,target:string,type:string,evidence:{EVIDENCE}>>, "
    "weights_added array<struct<source:string,target:string,type:string,weight:double,metadata:struct<similarity_method:string,k:int,measurement_type:string>>>, "
    f"candidates array<struct<statement:string,reason:string,evidence:{EVIDENCE},proposed_node_id:string>>, "
    "provenance array<struct<record_id:string,context_node_id:string,source_file:string,ingestion_timestamp:string,metadata:map<string,string>>>"
)
PROJECTION = (
    "projection_parameters struct<focus_node:string,coherence_threshold:double,top_k_per_node:int,max_depth:int,max_nodes:int,topic_filter:boolean>, "
    f"nodes array<struct<node_id:string,statement:string,canonical_terms:array<string>,evidence:{EVIDENCE},node_type:string,source_file:string,content_hash:string,metadata:map<string,string>>>, "
    f"edges array<struct<source:string,target:string,edge_type:string,weight:double,evidence:{EVIDENCE}>>, "
    "metadata struct<node_count:bigint,edge_count:bigint,average_degree:double,density:double>"
)
CHAT = (
    "id string, conversation_id string, title string, mapping map<string, struct<parent:string,children:array<string>,"
    "message:struct<id:string,author:struct<role:string>,create_time:string,content:struct<parts:array<string>>>>>"
)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, text) of whole files; UTF-8, or Latin-1 where that fails."""
    raw = spark.read.format("binaryFile").load(path)
    good = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.when(good, F.decode("content", "UTF-8")).otherwise(F.decode("content", "ISO-8859-1"))
    return raw.select(F.col("path").alias("source_file"), text.alias("text"))


def truth_faults(delta: TruthDelta) -> DataFrame:
    """(section, key, fault) of what a reload refuses: times that do not parse, and edges whose ends are missing."""
    ids = delta.nodes.select("node_id").distinct()
    late = delta.nodes.where("created_at is not null").where(F.col("created_at").try_cast("timestamp").isNull()).select(F.lit("nodes").alias("section"), F.col("node_id").alias("key"), F.lit("time").alias("fault"))
    for section, rows in (("edges", delta.edges), ("weights", delta.weights)):
        ends = rows.select(F.concat_ws(" ", "source", "target").alias("key"), F.explode(F.array("source", "target")).alias("node_id"))
        late = late.union(ends.join(ids, "node_id", "left_anti").select(F.lit(section), "key", F.lit("end")).distinct())
    return late


def read_truth(spark: SparkSession, path: str) -> TruthDelta:
    """The five sections of truth documents; fields that older documents lack are null."""
    docs = spark.read.schema(TRUTH).json(path, multiLine=True)
    part = lambda name: docs.select(F.explode(name).alias("x")).select("x.*")
    return TruthDelta(part("nodes_added"), part("edges_added"), part("weights_added"), part("candidates"), part("provenance"))


def read_projection(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROJECTION).json(path, multiLine=True).withColumn("source_file", F.input_file_name())


def _chat_rows(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return spark.read.schema(CHAT + ", _corrupt_record string").json(path, multiLine=not lines, mode="PERMISSIVE").withColumn("source_file", F.input_file_name())


def bad_chat_files(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, n_bytes) of exports that do not parse; a run goes on without them."""
    # The reader wants another column of its own besides the corrupt one.
    return _chat_rows(spark, path).where("_corrupt_record is not null and (mapping is null or size(mapping) >= 0)").groupBy("source_file").agg(F.sum(F.octet_length("_corrupt_record")).cast("bigint").alias("n_bytes"))


def read_chat(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Conversations (source_file, id, title, mapping) of exports that hold an object or an array, or an object a line; :func:`bad_chat_files` names what is skipped."""
    rows = _chat_rows(spark, path, lines).where("_corrupt_record is null")
    falsy = lambda c: F.when(F.length(c) > 0, F.col(c))
    return rows.select("source_file", F.coalesce(falsy("id"), falsy("conversation_id"), F.lit("unknown")).alias("conversation_id"), "title", "mapping")


def message_time(created: Column) -> Column:
    """ISO time in UTC of epoch seconds; other strings as they are; null where missing."""
    seconds = created.try_cast("double")
    return F.when(seconds.isNotNull(), F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss")).otherwise(created)


def walk_messages(conversations: DataFrame) -> DataFrame:
    """Assistant messages in breadth-first order: conversation_id, message_id, ts, text, ord.

    Levels of all conversations advance together; a node's place is its
    parent's place, then its place among the siblings.  A node that several
    others name as child, or one of a circle, is met once: where it comes first.
    """
    nodes = cut(conversations.select("conversation_id", F.explode("mapping").alias("node_key", "node")).select("conversation_id", "node_key", "node.*"))
    keyed = nodes.select("conversation_id", "node_key", F.coalesce("children", F.array().cast("array<string>")).alias("children"))
    level = cut(nodes.where("parent is null").select("conversation_id", "node_key", F.array(F.struct(F.lit(0).alias("d"), F.col("node_key").alias("k"))).alias("path"), F.lit(0).alias("depth")))
    found = level
    depth = 0
    while True:
        depth += 1
        step = level.join(keyed, ["conversation_id", "node_key"]).select("conversation_id", F.posexplode("children").alias("p", "child"), "path")
        step = step.select("conversation_id", F.col("child").alias("node_key"), F.concat("path", F.array(F.struct(F.col("p").alias("d"), F.col("child").alias("k")))).alias("path"), F.lit(depth).alias("depth"))
        met = step.join(nodes.select("conversation_id", "node_key"), ["conversation_id", "node_key"], "left_semi").join(found.select("conversation_id", "node_key"), ["conversation_id", "node_key"], "left_anti")
        level = cut(met.groupBy("conversation_id", "node_key").agg(F.min("path").alias("path"), F.min("depth").alias("depth")))
        if level.isEmpty():
            break
        found = cut(found.union(level))
    parts = F.array_join(F.filter("message.content.parts", lambda p: F.length(p) > 0), "\n")
    text = F.regexp_replace(parts, r"(?U)^\s+|\s+$", "")
    said = (
        found.join(nodes, ["conversation_id", "node_key"])
        .where("message.author.role = 'assistant'")
        .select("conversation_id", F.coalesce("message.id", "node_key").alias("message_id"), message_time(F.col("message.create_time")).alias("ts"), text.alias("text"), "depth", "path")
        .where(F.length("text") > 0)
    )
    order = Window.partitionBy("conversation_id").orderBy("depth", "path")
    return said.withColumn("ord", (F.row_number().over(order) - 1).cast("bigint")).drop("depth", "path")


def _document(delta: TruthDelta) -> DataFrame:
    """One row: the truth document as JSON (for exports that fit one file)."""
    part = lambda df: df.agg(F.to_json(F.collect_list(F.struct("*")), {"ignoreNullFields": "false"})).scalar()
    pieces = [F.concat(F.lit(f'"{name}":'), F.coalesce(part(df), F.lit("[]"))) for name, df in zip(("nodes_added", "edges_added", "weights_added", "candidates", "provenance"), (delta.nodes, delta.edges, delta.weights, delta.candidates, delta.provenance), strict=True)]
    return delta.nodes.sparkSession.range(1).select(F.concat(F.lit("{"), F.concat_ws(",", *pieces), F.lit("}")).alias("value"))


def write_truth(delta: TruthDelta, path: str, single_document: bool = False) -> None:
    """Parquet tables of the five sections, and if asked one JSON document beside them."""
    for name in ("nodes", "edges", "weights", "candidates", "provenance"):
        getattr(delta, name).write.mode("overwrite").parquet(f"{path}/{name}")
    if single_document:
        _document(delta).write.mode("overwrite").text(f"{path}/document")


def read_sections(spark: SparkSession, path: str) -> TruthDelta:
    """The tables that :func:`write_truth` wrote."""
    return TruthDelta(*(spark.read.parquet(f"{path}/{name}") for name in ("nodes", "edges", "weights", "candidates", "provenance")))


def graph_state(delta: TruthDelta) -> DataFrame:
    """One row: the graph keyed by node id, as JSON."""
    by_id = lambda kind: delta.nodes.where(F.col("node_type") == kind).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("node_id", F.struct("*")))))).scalar()
    listed = lambda df: df.agg(F.to_json(F.collect_list(F.struct("*")))).scalar()
    pieces = {"atomic_nodes": by_id("atomic"), "context_nodes": by_id("context"), "edges": listed(delta.edges), "weighted_edges": listed(delta.weights), "candidates": listed(delta.candidates)}
    body = F.concat_ws(",", *(F.concat(F.lit(f'"{k}":'), v) for k, v in pieces.items()))
    return delta.nodes.sparkSession.range(1).select(F.concat(F.lit("{"), body, F.lit("}")).alias("value"))


def write_projections(projections: list, path: str) -> None:
    """Node and edge tables of a suite, partitioned by perspective."""
    for name in ("nodes", "edges", "metadata"):
        for k, p in enumerate(projections, 1):
            getattr(p, name).write.mode("overwrite").parquet(f"{path}/{name}/perspective={k}_t{p.params.coherence_threshold:.1f}_k{p.params.top_k_per_node}_d{p.params.max_depth}")


def merge_deltas(deltas: list[TruthDelta]) -> TruthDelta:
    """Sections put together; repeated nodes and edges once."""
    def merged(name: str, keys: list[str] | None) -> DataFrame:
        out = getattr(deltas[0], name)
        for d in deltas[1:]:
            out = out.unionByName(getattr(d, name), allowMissingColumns=True)
        return out.dropDuplicates(keys) if keys else out

    return TruthDelta(merged("nodes", ["node_id"]), merged("edges", ["source", "target", "type"]), merged("weights", ["source", "target"]), merged("candidates", None), merged("provenance", None))


def write_snapshot(nodes: DataFrame, edges: DataFrame, meta: DataFrame, path: str) -> None:
    for name, df in (("nodes", nodes), ("edges", edges), ("metadata", meta)):
        df.write.mode("overwrite").json(f"{path}/{name}")
