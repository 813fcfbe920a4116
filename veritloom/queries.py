"""Registered queries of the graph operators, each with its SQL where SQL can say the same.

Queries run over whole tables.  ``documents`` has no bullets, comments or
relation phrases, so operators on those get texts derived alike on both sides:
every third line marked, or a phrase and a neighbour's term appended.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle as O
from .functions import text as T
from .operators import embed as similarity_embed
from .operators import chat, extract, graph, labels, layout, relate, similarity, validate
from .plans import projection
from .plans.ingest import ingest
from .plans.lineage import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


# Inputs ------------------------------------------------------------------


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", "text")


def _marked(text: Column) -> Column:
    """Lines in turn: a bullet, a numbered item, as they are; some comments and quoted blocks."""

    def mark(line: Column, i: Column) -> Column:
        return (
            F.when(i % 7 == 5, F.concat(F.lit("# "), line)).when(i % 7 == 6, F.concat(F.lit('"""'), line, F.lit('"""')))
            .when(i % 3 == 0, F.concat(F.lit("- "), line)).when(i % 3 == 1, F.concat((i + 1).cast("string"), F.lit(". "), line)).otherwise(line)
        )

    return F.array_join(F.transform(F.split(text, "\n"), mark), "\n")


def _rows(docs: DataFrame, units: Column) -> DataFrame:
    return extract.explode_units(docs, units, "doc_id").select("doc_id", "ord", F.col("text").alias("unit"), F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "context")


_KEPT: dict[tuple[str, str, str], object] = {}


def _once(kind: str, make: Callable[[SparkSession, str], object]) -> Callable[[SparkSession, str], object]:
    """What queries of one session share over one folder is made once."""

    def shared(spark: SparkSession, d: str) -> object:
        key = spark.sparkContext.applicationId, d, kind
        if key not in _KEPT:
            _KEPT[key] = make(spark, d)
        return _KEPT[key]

    return shared


def _named(kind: str, key: Column) -> Column:
    """The id of a kind from its eight bytes."""
    return F.concat(F.lit(kind), F.lower(F.hex(key)))


def _kept(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the shared folder (a checkpoint takes several times the disk), without the shuffle files that made it."""
    import gc

    spark = df.sparkSession
    path = _folder(spark)
    df.write.option("compression", "zstd").parquet(path)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.parquet(path)


def _units(spark: SparkSession, d: str) -> DataFrame:
    return _rows(_docs(spark, d), extract.sentences(F.col("text")))


def _scoped(units: DataFrame) -> DataFrame:
    return units.select(F.col("doc_id").alias("scope"), "ord", F.col("unit").alias("text"))


def _make_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Valid statements, equal ones once: node_id, doc_id, ord, statement, terms, evidence, context_id."""
    from .plans.ingest import first_of_each

    # Ids are shuffled and kept as their eight bytes.
    docs = _docs(spark, d).withColumn("context_id", F.unhex(T.content_hash(F.col("text"))))
    units = extract.explode_units(docs, extract.sentences(F.col("text")), "doc_id", "context_id")
    valid = units.where(F.size(validate.violations(F.col("text"))) == 0)
    first = first_of_each(valid.select(F.unhex(T.stability_hash(F.col("text"))).alias("node_id"), "doc_id", "ord", F.col("text").alias("statement"), "context_id", "start", "end"))
    # Terms are of the first statement alone; evidence is put together again when it is read.
    kept = _kept(first.select("node_id", "doc_id", "ord", "statement", T.canonical_terms(F.col("statement")).alias("terms"), "context_id", "start", "end"))
    evidence = F.array(F.struct(F.col("doc_id").cast("string").alias("source"), F.struct("start", "end").alias("span"), F.lit(1.0).alias("confidence")))
    return kept.withColumns({"node_id": _named("atomic_", F.col("node_id")), "context_id": _named("context_", F.col("context_id")), "evidence": evidence}).drop("start", "end")


_nodes = _once("nodes", _make_nodes)


def _phrased(nodes: DataFrame, phrase: str) -> DataFrame:
    """Nodes by document; every fourth statement gets the phrase and the first term of the next one."""
    from pyspark.sql import Window

    after = F.lead("terms").over(Window.partitionBy("doc_id").orderBy("ord"))
    tail = F.concat(F.lit(f" {phrase} "), F.coalesce(F.lower(F.get(after, F.lit(0))), F.lit("nothing")))
    told = F.when(F.col("ord") % 4 == 1, F.concat("statement", tail)).otherwise(F.col("statement"))
    return nodes.withColumn("statement", told).withColumnRenamed("doc_id", "scope")


def _weights(nodes: DataFrame, k: int = 3) -> DataFrame:
    units = nodes.select(F.col("doc_id").alias("scope"), "ord", F.unhex(F.substring("node_id", 8, 16)).alias("node_id"), F.col("statement").alias("text"))
    pairs = similarity.similarity_edges(units, k)
    kept = _kept(pairs.select("source", "target", F.round("weight", 9).alias("weight"), (F.col("scope") * 1_000_000_000 + F.col("i") * 10_000 + F.col("j")).alias("edge_ord")))
    return kept.withColumns({"source": _named("atomic_", F.col("source")), "target": _named("atomic_", F.col("target")), "type": F.lit("related_to")})


def _make_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, weights, edges) of the documents' statements and contexts."""
    found = _nodes(spark, d)
    edges = found.select(F.col("node_id").alias("source"), F.col("context_id").alias("target"), F.lit("appears_in").alias("type"), (F.col("doc_id") * 1_000_000 + F.col("ord")).alias("edge_ord"), F.lit(None).cast("double").alias("weight"))
    contexts = _kept(found.groupBy(F.unhex(F.substring("context_id", 9, 16)).alias("key")).agg(F.min("doc_id").alias("doc_id"))).select(_named("context_", F.col("key")).alias("context_id"), "doc_id")
    none = F.lit(None).cast("array<string>")
    nodes = found.select("node_id", F.lit("atomic").alias("node_type"), "statement", F.slice(F.transform("terms", F.lower), 1, 2).alias("topic_labels"), (F.col("doc_id") * 1_000_000 + F.col("ord")).alias("node_ord"), F.lit(None).cast("string").alias("source_file")).union(
        contexts.select("context_id", F.lit("context"), F.lit(None).cast("string"), none, F.col("doc_id") * 1_000_000, F.col("doc_id").cast("string"))
    )
    return nodes, _weights(found), edges


_graph = _once("graph", _make_graph)


def _rejected(spark: SparkSession, d: str) -> DataFrame:
    return _units(spark, d).where(F.size(validate.violations(F.col("unit"))) > 0)


def _echoed(nodes: DataFrame) -> DataFrame:
    """Nodes by document; every fourth statement repeats the one before it and says so."""
    from pyspark.sql import Window

    before = F.lag("statement").over(Window.partitionBy("doc_id").orderBy("ord"))
    told = F.when(F.col("ord") % 4 == 1, F.concat(F.coalesce(before, F.lit("nothing")), F.lit(" is based on it"))).otherwise(F.col("statement"))
    return nodes.withColumn("statement", told).withColumnRenamed("doc_id", "scope")


def _folder(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share."""
    import uuid

    return f"{shared_folder(spark)}/veritloom-queries/{uuid.uuid4().hex}"


def _of_conversation():
    from pyspark.sql import Window

    return Window.partitionBy("conv_id")


def _focus(nodes: DataFrame, weights: DataFrame, edges: DataFrame) -> str:
    return projection.best_focus(nodes, weights, edges).first()["node_id"]


# Text --------------------------------------------------------------------


@query("T1_meta_filter", O.T1)
def _(spark, d):
    return _docs(spark, d).select("doc_id", T.meta_filter(_marked(F.col("text"))).alias("filtered"))


@query("T2_split_sentences", O.T2)
def _(spark, d):
    return _units(spark, d)


@query("T3_extract_bullets", O.T3)
def _(spark, d):
    return _rows(_docs(spark, d).withColumn("text", _marked(F.col("text"))), extract.bullets(F.col("text")))


@query("T4_extract_numbered", O.T4)
def _(spark, d):
    return _rows(_docs(spark, d).withColumn("text", _marked(F.col("text"))), extract.numbered(F.col("text")))


@query("T5_dedup_by_span", O.T5)
def _(spark, d):
    c = F.col("text")
    return _rows(_docs(spark, d).withColumn("text", _marked(c)), extract.drop_overlaps(F.concat(extract.bullets(c), extract.numbered(c), extract.sentences(c))))


@query("T6_remap_spans", O.T6)
def _(spark, d):
    return _rows(_docs(spark, d), extract.remap(extract.sentences(F.col("text")), F.col("text"))).drop("context")


@query("T7_canonical_terms", O.T7)
def _(spark, d):
    return _units(spark, d).select("doc_id", "ord", F.array_join(T.canonical_terms(F.col("unit")), "|").alias("terms"))


@query("T8_parse", O.T8)
def _(spark, d):
    return _rows(_docs(spark, d), extract.parse(F.col("text"))).drop("context")


@query("T8_parse_marked", O.T8_MARKED)
def _(spark, d):
    return _rows(_docs(spark, d).withColumn("text", _marked(F.col("text"))), extract.parse(F.col("text")))


@query("T9_stability_hash", O.T9)
def _(spark, d):
    return _units(spark, d).select("doc_id", "ord", T.node_id(F.col("unit")).alias("node_id"))


@query("T10_content_hash", O.T10)
def _(spark, d):
    return _docs(spark, d).select("doc_id", T.context_id(F.col("text")).alias("node_id"))


@query("T11_suggest_repair", O.T11)
def _(spark, d):
    lines = _docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "statement"))
    return lines.select("doc_id", F.col("line").cast("bigint").alias("line"), F.array_join(validate.suggest_repair(F.col("statement"), F.lit("")), "|").alias("repairs"))


@query("T12_label_parse_batch", O.T12)
def _(spark, d):
    reply = F.array_join(F.transform(F.split("text", "\n"), lambda line, i: F.when(i % 3 == 2, line).otherwise(F.concat((i % 5 + 1).cast("string"), F.lit(": "), line))), "\n")
    parsed = T.parse_label_reply(reply, F.lit(6))
    rows = _docs(spark, d).select("doc_id", F.posexplode(parsed).alias("k", "found"))
    return rows.select("doc_id", F.col("k").cast("bigint").alias("k"), F.array_join("found", "|").alias("labels"))


@query("T13_label_normalise", O.T13)
def _(spark, d):
    return _units(spark, d).select("doc_id", "ord", F.array_join(T.normalise_labels(F.col("unit")), "|").alias("labels"))


@query("T14_build_label_prompt", O.T14)
def _(spark, d):
    return labels.prompts(_scoped(_units(spark, d))).select(F.col("scope").alias("doc_id"), "chunk", "n", F.sha2("prompt", 256).alias("prompt_sha256"))


@query("T15_serialise_nodes", O.T15)
def _(spark, d):
    nodes = _nodes(spark, d)
    return nodes.select("node_id", F.to_json(F.struct("node_id", "statement", F.col("terms").alias("canonical_terms"))).alias("json"))


@query("T16_serialise_projection_nodes", O.T16)
def _(spark, d):
    return _nodes(spark, d).select("node_id", "statement", F.array_join("terms", "|").alias("canonical_terms"), F.lit("atomic").alias("node_type")).orderBy("node_id")


@query("T17_viz_label", O.T17)
def _(spark, d):
    return _units(spark, d).select("doc_id", "ord", T.display_label(F.col("unit"), 40).alias("label_3d"), T.display_label(F.col("unit"), 50, "...").alias("label_html"))


@query("T18_color_map", O.T18)
def _(spark, d):
    kind = F.when(F.col("doc_id") % 3 == 0, "atomic").when(F.col("doc_id") % 3 == 1, "context").otherwise("person")
    return _docs(spark, d).select("doc_id", layout.color(kind, layout.NODE_COLORS, layout.OTHER_NODE).alias("color"))


@query("T19_seed3d", O.T19)
def _(spark, d):
    return _docs(spark, d).select("doc_id", layout.seed_3d(T.context_id(F.col("text")), F.lit(0.2), F.lit(1)).alias("seed"))


@query("T20_seed2d", O.T20)
def _(spark, d):
    return _docs(spark, d).select("doc_id", layout.seed_2d(F.concat(F.lit("projection_"), F.col("doc_id").cast("string"))).alias("seed"))


# Rules -------------------------------------------------------------------


@query("V1_V8_violations", O.V8)
def _(spark, d):
    units = _units(spark, d)
    return units.select("doc_id", "ord", validate.reason(validate.violations(F.col("unit"))).alias("reason"))


@query("V1_pronoun_start", O.V1)
def _(spark, d):
    return _units(spark, d).where(validate.pronoun_start(F.col("unit"))).select("doc_id", "ord")


@query("V2_pronoun_density", O.V2)
def _(spark, d):
    return _units(spark, d).select("doc_id", "ord", validate.pronoun_density(F.col("unit")).alias("density"))


@query("V3_multi_sentence", O.V3)
def _(spark, d):
    lines = _docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "statement"))
    return lines.select("doc_id", F.col("line").cast("bigint").alias("line"), validate.multi_sentence(F.col("statement")).alias("hit"))


@query("V4_multi_claim", O.V4)
def _(spark, d):
    return _units(spark, d).where(validate.multi_claim(F.col("unit"))).select("doc_id", "ord")


@query("V5_embedded_clause", O.V5)
def _(spark, d):
    return _units(spark, d).where(validate.embedded_clause(F.col("unit"))).select("doc_id", "ord")


@query("V6_min_length", O.V6)
def _(spark, d):
    lines = _docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "statement"))
    return lines.where(validate.too_short(F.col("statement"))).select("doc_id", F.col("line").cast("bigint").alias("line"))


@query("V7_meaningful_content", O.V7)
def _(spark, d):
    return _units(spark, d).where(validate.lacks_content(F.col("unit"))).select("doc_id", "ord")


@query("V9_node_guard", O.V9)
def _(spark, d):
    return _units(spark, d).select("doc_id", "ord", validate.node_guard(F.col("unit")).alias("ok"))


@query("V10_edge_weight_guard", O.V10)
def _(spark, d):
    e = _table(spark, d, "events")
    type_ = F.when(F.col("event_id") % 2 == 0, "related_to").otherwise("depends_on")
    weight = F.when(F.col("event_id") % 3 != 0, F.col("value") / 100)
    return e.select("event_id", validate.edge_weight_guard(type_, weight).alias("ok"))


@query("V11_no_containment_guard", O.V11)
def _(spark, d):
    return _table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).select("event_type", "n", validate.containment_guard(F.col("event_type")).alias("ok"))


@query("V12_edge_endpoint_check", O.V12)
def _(spark, d):
    nodes, _, edges = _graph(spark, d)
    odd = edges.select("source", F.when(F.col("edge_ord") % 3 == 0, F.concat("target", F.lit("x"))).otherwise(F.col("target")).alias("target"), F.when(F.col("edge_ord") % 5 == 0, "refines").otherwise(F.col("type")).alias("type"))
    return validate.endpoint_check(odd, nodes).groupBy("type", "valid").agg(F.count("*").alias("n"))


# Similarity --------------------------------------------------------------


def _counting_embedder() -> similarity_embed.Embedder:
    """Stands in for a model: lengths and letter counts."""
    return lambda texts: [[float(len(t)), float(t.count(" ")), float(t.count("e")), float(t.count("a"))] for t in texts]


@query("J1_embed", O.J1)
def _(spark, d):
    vectors = similarity_embed.embed(_scoped(_units(spark, d)), _counting_embedder)
    return vectors.select(F.col("scope").alias("doc_id"), "ord", *(F.get("vector", k).alias(f"v{k}") for k in range(4)))


@query("J2_bow_vector", O.J2)
def _(spark, d):
    vectors = similarity.term_vectors(_scoped(_units(spark, d)))
    return similarity.norms(vectors).select(F.col("scope").alias("doc_id"), "ord", F.col("sq").alias("squared_norm"))


@query("J3_dense_cosine", O.J3)
def _(spark, d):
    v = _table(spark, d, "embeddings").select("vec_id", "embedding")
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(after, "vec_id").select("vec_id", F.round(similarity.dense_cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@query("J4_pair_similarity", O.J4)
def _(spark, d):
    units = _scoped(_units(spark, d))
    return similarity.similarity_of(units.select("scope", F.col("ord").alias("i"), (F.col("ord") + 1).alias("j")), units).where("sim > 0").select(F.col("scope").alias("doc_id"), "i", F.round("sim", 9).alias("sim"))


@query("J5_find_similar", O.J5)
def _(spark, d):
    units = _scoped(_units(spark, d))
    return similarity.find_similar(units, units).select(F.col("scope").alias("doc_id"), "query", "ord", F.round("sim", 9).alias("sim"), "rank")


@query("J6_pairwise_threshold", O.J6)
def _(spark, d):
    return similarity.pairwise_threshold(_scoped(_units(spark, d))).select(F.col("scope").alias("doc_id"), "i", "j", F.round("sim", 9).alias("sim"))


@query("J7_topk_similarity", O.J7)
def _(spark, d):
    return similarity.topk_similarity(_scoped(_units(spark, d)), 10).select(F.col("scope").alias("doc_id"), "i", "j", F.round("sim", 9).alias("sim"))


@query("J8_similarity_edges", O.J8)
def _(spark, d):
    return _weights(_nodes(spark, d)).select("source", "target", "weight")


@query("J9_derived_from", O.J9)
def _(spark, d):
    return relate.derived_from(_echoed(_nodes(spark, d))).withColumnRenamed("scope", "doc_id")


@query("J10_refines", O.J10)
def _(spark, d):
    return relate.refines(_phrased(_nodes(spark, d), "in particular")).withColumnRenamed("scope", "doc_id")


@query("J11_depends_on", O.J11)
def _(spark, d):
    return relate.depends_on(_phrased(_nodes(spark, d), "requires")).withColumnRenamed("scope", "doc_id")


@query("J12_appears_in", O.J12)
def _(spark, d):
    return relate.appears_in(_nodes(spark, d)).select("source", "target", "type")


@query("J14_typed_edges", O.J14)
def _(spark, d):
    nodes = _phrased(_nodes(spark, d), "requires")
    edges = relate.typed_edges(nodes, relate.depends_on(nodes), "depends_on")
    return edges.select("source", "target", "type", F.col("evidence")[0]["span"]["start"].alias("span_start"))


@query("J13_authored_by", O.J13)
def _(spark, d):
    docs = _table(spark, d, "documents")
    contexts = docs.select(T.context_id(F.col("text")).alias("node_id"), F.when(F.col("doc_id") % 3 != 0, F.create_map(F.lit("author"), F.col("source"))).otherwise(F.create_map(F.lit("lang"), F.col("lang"))).alias("metadata"))
    return relate.authored_by(contexts)


@query("J15_fuzzy_dedup", O.J15)
def _(spark, d):
    return similarity.fuzzy_dedup(_scoped(_units(spark, d))).select(F.col("scope").alias("doc_id"), "ord", "text")


@query("J15_fuzzy_dedup_corpus", O.J15_CORPUS)
def _(spark, d):
    units = _nodes(spark, d).select(F.lit(0).alias("scope"), F.struct("doc_id", "ord").alias("ord"), F.col("statement").alias("text"))
    return similarity.fuzzy_dedup(units).select("ord.doc_id", F.col("ord.ord").alias("ord"))


@query("J16_exact_hash_match", O.J16)
def _(spark, d):
    units = _units(spark, d).select(F.concat_ws("_", "doc_id", "ord").alias("query_id"), T.stability_hash(F.col("unit")).alias("stability_hash"))
    nodes = _nodes(spark, d).select("node_id", F.substring("node_id", 8, 16).alias("stability_hash"))
    return similarity.exact_hash_match(units, nodes)


@query("J17_delta_anti", O.J17)
def _(spark, d):
    nodes, weights, edges = _graph(spark, d)
    none = nodes.limit(0)
    now = graph.TruthDelta(nodes, edges, weights, none, none)
    # The earlier state has the English documents only.
    english = _table(spark, d, "documents").where("lang = 'en'").select("doc_id")
    of = lambda rows, place: rows.join(english, F.expr(place) == english["doc_id"], "left_semi")
    before = graph.TruthDelta(of(nodes, "node_ord div 1000000"), of(edges, "edge_ord div 1000000"), of(weights, "edge_ord div 1000000000"), none, none)
    new = graph.delta(now, before)
    return new.nodes.select(F.lit("node").alias("section"), F.col("node_id").alias("key")).union(new.edges.select(F.lit("edge"), F.concat("source", "target"))).union(new.weights.select(F.lit("weight"), F.concat("source", "target"))).groupBy("section").agg(F.count("*").alias("n"), F.min("key").alias("first_key"))


@query("J18_orphans", O.J18)
def _(spark, d):
    nodes, weights, edges = _graph(spark, d)
    return graph.orphans(nodes, edges.unionByName(weights.select("source", "target", "type", "edge_ord", "weight").where("weight > 0.2")), ("appears_in",)).select("node_id")


@query("J19_connectivity", O.J19)
def _(spark, d):
    _, weights, edges = _graph(spark, d)
    return graph.connectivity(edges.select("source", "target").union(weights.select("source", "target"))).groupBy("node").agg(F.count("*").alias("n_neighbours"))


@query("J20_topic_zip", O.J20)
def _(spark, d):
    units = _units(spark, d)
    given = units.select("doc_id", "ord", T.normalise_labels(F.col("unit")).alias("found"))
    return units.join(given, ["doc_id", "ord"]).select("doc_id", "ord", F.get("found", F.lit(0)).alias("label"))


@query("J21_edge_lookup", O.J21)
def _(spark, d):
    _, weights, edges = _graph(spark, d)
    first = weights.orderBy("edge_ord").first()
    return graph.edge_lookup(weights, first["target"], first["source"]).select("source", "target", "weight")


@query("J22_directed_edges_within", O.J22)
def _(spark, d):
    nodes, _, edges = _graph(spark, d)
    return graph.edges_within(edges, nodes.where("node_type = 'context' or size(topic_labels) >= 2")).select("source", "target", "type")


# Statistics --------------------------------------------------------------


@query("A1_edge_type_distribution", O.A1)
def _(spark, d):
    _, weights, edges = _graph(spark, d)
    return graph.edge_type_distribution(edges.select("type").union(weights.select("type")))


@query("A2_graph_stats", O.A2)
def _(spark, d):
    nodes, weights, edges = _graph(spark, d)
    stats = graph.graph_stats(nodes, edges, weights, _rejected(spark, d))
    return stats.withColumns({"mean_weight": F.round("mean_weight", 6), "avg_connectivity": F.round("avg_connectivity", 6), "candidate_ratio": F.round("candidate_ratio", 6)})


@query("A3_engine_statistics", O.A3)
def _(spark, d):
    nodes, weights, edges = _graph(spark, d)
    return graph.engine_statistics(nodes, edges, weights, _rejected(spark, d))


@query("A3_engine_statistics_without_contexts", O.A3_BARE)
def _(spark, d):
    nodes, weights, _ = _graph(spark, d)
    only, kept = layout.without_contexts(nodes, weights.where("weight >= 0.2"))
    phrased = _phrased(_nodes(spark, d), "requires")
    depends = relate.typed_edges(phrased, relate.depends_on(phrased), "depends_on")
    return graph.engine_statistics(only, depends, kept, _rejected(spark, d))


@query("A4_validate_structure", O.A4)
def _(spark, d):
    nodes, weights, edges = _graph(spark, d)
    return graph.validate_structure(graph.graph_stats(nodes, edges, weights, _rejected(spark, d)))


@query("A5_degree", O.A5)
def _(spark, d):
    _, weights, edges = _graph(spark, d)
    return graph.degree(edges.select("source", "target").union(weights.select("source", "target")))


@query("A6_weighted_degree", O.A6)
def _(spark, d):
    _, weights, edges = _graph(spark, d)
    both = edges.select("source", "target", "type", "weight").union(weights.select("source", "target", "type", "weight"))
    return graph.weighted_degree(both).select("node", F.round("importance", 9).alias("importance"))


@query("A7_degree_distribution", O.A7)
def _(spark, d):
    _, weights, _ = _graph(spark, d)
    return graph.degree_distribution(weights)


@query("A8_size_scale", O.A8)
def _(spark, d):
    nodes, weights, _ = _graph(spark, d)
    return layout.styled_nodes(nodes, weights).where("node_type = 'atomic'").select("node_id", "degree", F.round("size", 6).alias("size"), "color", "label")


@query("A9_snapshot_metadata", O.A9)
def _(spark, d):
    nodes, weights, edges = _graph(spark, d)
    only, kept = layout.without_contexts(nodes, weights)
    meta = layout.snapshot_metadata(kept, only)
    return meta.withColumns({"max_importance": F.round("max_importance", 9), "min_importance": F.round("min_importance", 9)})


@query("A10_node_count_per_message", O.A10)
def _(spark, d):
    m = chat.said_by(_table(spark, d, "conversations"))
    return m.select("conv_id", "turn", chat.valid_units(F.col("text")).alias("n_valid"))


def _messages(spark: SparkSession, d: str) -> DataFrame:
    m = chat.said_by(_table(spark, d, "conversations"))
    return m.select(F.col("conv_id").alias("scope"), F.col("turn").alias("ord"), "text", chat.valid_units(F.col("text")).alias("n_valid"))


@query("A11_greedy_batching", O.A11)
def _(spark, d):
    return chat.batch_messages(_messages(spark, d), 5).select(F.col("scope").alias("conv_id"), F.col("ord").alias("turn"), "n_valid", "batch")


@query("T21_message_concat", O.T21)
def _(spark, d):
    return chat.concatenate(chat.batch_messages(_messages(spark, d), 5)).select(F.col("scope").alias("conv_id"), "batch", "n_messages", "content")


@query("A12_chunking", O.A12)
def _(spark, d):
    return _units(spark, d).groupBy("doc_id", labels.chunk_of(F.col("ord")).alias("chunk")).agg(F.count("*").alias("n"))


@query("A13_provenance_seq", O.A13)
def _(spark, d):
    from pyspark.sql import Window

    contexts = _table(spark, d, "conversations").withColumn("seq", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1)
    return graph.provenance(contexts).select("conv_id", "turn", "record_id")


@query("S3_scan_chat_flat", O.S3)
def _(spark, d):
    m = chat.said_by(_table(spark, d, "conversations"))
    return m.select("conv_id", "turn", T.strip(F.col("text")).alias("text")).where(F.length("text") > 0)


# Projections -------------------------------------------------------------


@query("P1_bfs_discover", O.P1)
def _(spark, d):
    nodes, weights, edges = _graph(spark, d)
    found = projection.discover(_focus(nodes, weights, edges), nodes, weights, edges, projection.ProjectionParameters(0.2, 5, 2, 1_000_000_000))
    return found.select("node_id", F.col("depth").cast("bigint").alias("depth"))


@query("P1_bfs_discover_capped", O.P1_CAPPED)
def _(spark, d):
    nodes, weights, edges = _graph(spark, d)
    return projection.discover(_focus(nodes, weights, edges), nodes, weights, edges, projection.ProjectionParameters(0.2, 3, 5, 100)).select("node_id", "rank", F.col("depth").cast("bigint").alias("depth"))


@query("P6_focus_candidates", O.P6)
def _(spark, d):
    return projection.first_atomic(_graph(spark, d)[0])


@query("P2_neighbors", O.P2)
def _(spark, d):
    _, weights, edges = _graph(spark, d)
    return projection.neighbors(weights, edges, 0.2).select("node", "other", "weight", F.col("kind").cast("bigint").alias("kind"))


@query("V13_coherence_filter", O.V13)
def _(spark, d):
    _, weights, _ = _graph(spark, d)
    return projection.coherent(weights, 0.5).select("source", "target", "weight")


@query("V14_topic_filter", O.V14)
def _(spark, d):
    nodes, weights, edges = _graph(spark, d)
    return projection.passes_topics(projection.neighbors(weights, edges, 0.2), nodes).select("node", "other")


@query("V15_context_filter", O.V15)
def _(spark, d):
    nodes, weights, edges = _graph(spark, d)
    only, kept = layout.without_contexts(nodes, edges.select("source", "target").union(weights.select("source", "target")))
    return only.agg(F.count("*").alias("n_nodes")).select("n_nodes", kept.agg(F.count("*")).scalar().alias("n_edges"))


@query("V16_role_filter", O.V16)
def _(spark, d):
    return chat.said_by(_table(spark, d, "conversations")).select("conv_id", "turn")


@query("V17_lod_visibility", O.V17)
def _(spark, d):
    nodes, weights, _ = _graph(spark, d)
    styled = layout.styled_nodes(nodes.where("node_type = 'atomic'"), weights).select("node_id", "degree", F.round("importance", 9).alias("importance"))
    return layout.visible_nodes(styled, 60.0).where("visible").select("node_id")


@query("P3_extract_edges_flat", O.P3)
def _(spark, d):
    nodes, weights, edges = _graph(spark, d)
    return projection.extract_edges_flat(nodes, weights, edges, 0.3)


@query("P4_extract_edges_adaptive", O.P4)
def _(spark, d):
    nodes, weights, edges = _graph(spark, d)
    return projection.extract_edges(nodes, weights, edges, 0.1, 2)


@query("P5_projection_metadata", O.P5)
def _(spark, d):
    nodes, weights, edges = _graph(spark, d)
    return projection.metadata(nodes, weights.select("source").union(edges.select("source")))


@query("P7_project", O.P7)
def _(spark, d):
    nodes, weights, edges = _graph(spark, d)
    return projection.project(_focus(nodes, weights, edges), nodes, weights, edges, projection.ProjectionParameters(0.2, 3, 3, 60)).edges


@query("P8_perspective_suite", O.P8)
def _(spark, d):
    nodes, weights, edges = _graph(spark, d)
    out = None
    for k, p in enumerate(projection.perspective_suite(_focus(nodes, weights, edges), nodes, weights, edges), 1):
        row = p.metadata.withColumn("perspective", F.lit(k).cast("bigint"))
        out = row if out is None else out.unionByName(row)
    return out


@query("P9_best_focus", O.P9)
def _(spark, d):
    nodes, weights, edges = _graph(spark, d)
    return projection.best_focus(nodes, weights, edges)


@query("X2_layout3d")
def _(spark, d):
    nodes, weights, edges = _graph(spark, d)
    p = projection.project(_focus(nodes, weights, edges), nodes, weights, edges, projection.ProjectionParameters(0.2, 5, 2, 40))
    only, kept = layout.without_contexts(p.nodes, p.edges)
    one = F.lit(1).cast("bigint").alias("projection_id")
    return layout.layout_3d(only.select(one, "node_id", "node_ord"), kept.select(one, "source", "target", "weight", F.concat("source", "target").alias("edge_ord")), spark.range(1).select(one, F.lit(7).cast("bigint").alias("seed")))


@query("X3_snapshot", O.X3)
def _(spark, d):
    nodes, weights, edges = _graph(spark, d)
    p = projection.project(_focus(nodes, weights, edges), nodes, weights, edges, projection.ProjectionParameters(0.2, 3, 3, 60))
    points, _, _ = layout.snapshot(p.nodes, p.edges, 7)
    return points.where("x is not null and y is not null and z is not null").select("node_id", "degree", F.round("importance", 9).alias("importance"), F.round("size", 6).alias("size"), "color", "label", "full_statement")


@query("X4_circular_layout", O.X4)
def _(spark, d):
    v = _table(spark, d, "embeddings").select(F.col("label").cast("bigint").alias("projection_id"), F.col("vec_id").cast("string").alias("node_id"), F.col("vec_id").alias("node_ord"))
    return layout.circular_layout(v).select("projection_id", "node_id", (F.round("x", 6) + 0.0).alias("x"), (F.round("y", 6) + 0.0).alias("y"))


@query("X1_topic_label", O.X1)
def _(spark, d):
    return _units(spark, d).select("doc_id", "ord", F.array_join(labels.default_labels(F.col("unit")), "|").alias("labels"))


@query("X1_topic_label_asked", O.X1_ASKED)
def _(spark, d):
    def labeler(prompt: str) -> str:
        """Stands in for a model: the first two words of every statement."""
        lines = prompt.rstrip("\n").split("\n\n", 1)[1].split("\n")
        if not lines[0].startswith("1. "):
            return ", ".join(lines[0].split()[:2])
        return "\n".join(line.split(". ", 1)[0] + ": " + ", ".join(line.split(". ", 1)[1].split()[:2]) for line in lines if ". " in line)

    plain = _nodes(spark, d).where(~F.col("statement").contains("\n")).select(F.col("doc_id").alias("scope"), "ord", F.regexp_replace("statement", r"[^A-Za-z ]", "").alias("text")).where("length(trim(text)) > 0")
    return labels.topic_labels(plain, labeler).select(F.col("scope").alias("doc_id"), F.col("ord_").alias("ord"), F.array_join("labels", "|").alias("labels"))


@query("U1_bag_union", O.U1)
def _(spark, d):
    c = F.col("text")
    marked = _docs(spark, d).withColumn("text", _marked(c))
    return _rows(marked, F.concat(extract.bullets(c), extract.numbered(c))).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("ingest_pipeline", O.INGEST)
def _(spark, d):
    docs = _table(spark, d, "documents").select("doc_id", F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("source_file"), "text")
    out = ingest(docs)
    stats = graph.graph_stats(out.nodes, out.edges, out.weights, out.candidates)
    sources = out.nodes.where("node_type = 'atomic'").agg(F.count_distinct(F.col("evidence")[0]["source"])).scalar()
    return stats.select("atomic_nodes", "context_nodes", "directed_edges", "weighted_edges", "candidates", F.round("mean_weight", 6).alias("mean_weight"), sources.alias("evidence_sources"))


@query("K1_truth_round_trip", O.K1)
def _(spark, d):
    """The graph written as a truth delta, read again and checked as on a reload."""
    from .sources import tables

    nodes, weights, edges = _graph(spark, d)
    none = lambda kind: F.lit(None).cast(kind)
    delta = graph.TruthDelta(
        nodes.select("node_id", "statement", "topic_labels", "node_type", "source_file", none("string").alias("created_at")),
        edges.select("source", "target", "type"), weights.select("source", "target", "type", "weight"), nodes.limit(0).select("statement"), nodes.limit(0).select("node_id"),
    )
    path = f"{_folder(spark)}/truth"
    tables.write_truth(delta, path)
    again = tables.read_sections(spark, path)
    sizes = again.nodes.select(F.lit("nodes").alias("section"), F.col("node_id").alias("key")).union(again.edges.select(F.lit("edges"), F.concat_ws(" ", "source", "target"))).union(again.weights.select(F.lit("weights"), F.concat_ws(" ", "source", "target")))
    return sizes.union(tables.truth_faults(again).select(F.lit("faults"), "key")).groupBy("section").agg(F.count("*").alias("n"), F.min("key").alias("first_key"))


@query("S3_scan_chat_export", O.S3_TREE)
def _(spark, d):
    """Conversations written as export files, then read and walked as trees."""
    from .sources import tables

    turns = _table(spark, d, "conversations")
    node = F.struct(
        F.when(F.col("turn") > F.min("turn").over(_of_conversation()), F.concat(F.lit("n"), F.lag("turn").over(_of_conversation().orderBy("turn")).cast("string"))).alias("parent"),
        F.array_compact(F.array(F.concat(F.lit("n"), F.lead("turn").over(_of_conversation().orderBy("turn")).cast("string")))).alias("children"),
        F.struct(
            F.concat_ws("-", "conv_id", "turn").alias("id"), F.struct("role").alias("author"), (F.col("turn") * 60).cast("string").alias("create_time"), F.struct(F.array("text").alias("parts")).alias("content")
        ).alias("message"),
    )
    keyed = turns.select("conv_id", F.struct(F.concat(F.lit("n"), F.col("turn").cast("string")).alias("key"), node.alias("value")).alias("entry"))
    trees = keyed.groupBy("conv_id").agg(F.map_from_entries(F.collect_list("entry")).alias("mapping"))
    path = f"{_folder(spark)}/chat"
    trees.select(F.col("conv_id").cast("string").alias("id"), F.lit("t").alias("title"), "mapping").write.json(path, ignoreNullFields=False)
    read = tables.read_chat(spark, path, lines=True)
    return tables.walk_messages(read).select(F.col("conversation_id").cast("bigint").alias("conv_id"), "message_id", "ts", "text", "ord")


@query("flagship", O.FLAGSHIP)
def flagship(spark, d):
    """Texts to accepted statements, their contexts and counts."""
    nodes = _nodes(spark, d)
    return nodes.groupBy("doc_id").agg(F.count("*").alias("statements"), F.sum(F.size("terms")).alias("terms"), F.min("node_id").alias("first_node"))
