"""Typed edges inferred from statements and their order.

``nodes``: scope, ord, node_id, statement, terms (array), evidence (array of
source, span, confidence).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .similarity import similarity_of

# Phrases that announce a relation.
DERIVED_PHRASES = ("derived from", "follows from", "based on")
REFINES_PHRASES = ("more specifically", "in particular", "more precisely")
DEPENDS_PHRASES = ("depends on", "requires", "relies on")
WINDOW = 3
CLOSE = 0.7
#: Terms shorter than this relate to nothing.
KEY = 4


def _says(statement: Column, phrases: tuple[str, ...]) -> Column:
    low = F.lower(statement)
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(low, F.lit(p))
    return out


def _evidence(edges: DataFrame) -> DataFrame:
    """Edges carry their source's first evidence and need its span."""
    first = F.get("evidence", F.lit(0))
    return edges.where(first["span"].isNotNull()).withColumn("evidence", F.array(F.struct(first["source"].alias("source"), first["span"].alias("span"), F.lit(1.0).alias("confidence"))))


def derived_from(nodes: DataFrame) -> DataFrame:
    """(scope, i, j): a statement that derives, and the earliest close one among the three before it."""
    units = nodes.select("scope", "ord", F.col("statement").alias("text"))
    says = nodes.where(_says(F.col("statement"), DERIVED_PHRASES)).select("scope", F.col("ord").alias("i"))
    before = says.select("scope", "i", F.explode(F.sequence(F.lit(1), F.lit(WINDOW))).alias("back")).select("scope", "i", (F.col("i") - F.col("back")).alias("j")).where("j >= 0")
    return similarity_of(before, units).where(F.col("sim") > CLOSE).groupBy("scope", "i").agg(F.min("j").alias("j"))


def refines(nodes: DataFrame) -> DataFrame:
    """(scope, i, j): a statement that refines, and the first other one whose terms it has all."""
    says = nodes.where(_says(F.col("statement"), REFINES_PHRASES)).select("scope", F.col("ord").alias("i"), F.col("terms").alias("terms_i"))
    others = nodes.where(F.size("terms") > 0).select("scope", F.col("ord").alias("j"), "terms")
    # A subset shares its first term, so an equi-join on that finds all.
    keyed = others.withColumn("term", F.get("terms", F.lit(0)))
    mine = says.withColumn("term", F.explode(F.array_distinct("terms_i")))
    return mine.join(keyed, ["scope", "term"]).where((F.col("i") != F.col("j")) & (F.size(F.array_except("terms", "terms_i")) == 0)).groupBy("scope", "i").agg(F.min("j").alias("j"))


def depends_on(nodes: DataFrame) -> DataFrame:
    """(scope, i, j): a statement that depends, and every other one with a term named after the phrase."""
    low = F.lower("statement")
    suffix = F.lit(None).cast("string")
    for p in reversed(DEPENDS_PHRASES):
        at = F.instr(low, F.lit(p))
        suffix = F.when(at > 0, F.substring(low, at, F.length(low))).otherwise(suffix)
    says = nodes.select("scope", F.col("ord").alias("i"), suffix.alias("suffix")).where("suffix is not null")
    terms = nodes.select("scope", F.col("ord").alias("j"), F.explode("terms").alias("term")).where(F.length("term") >= KEY).select("scope", "j", F.lower("term").alias("term"))
    # A term that the suffix contains begins where one of the suffix's runs of KEY letters stands.
    places = F.sequence(F.lit(1), F.greatest(F.length("suffix") - KEY + 1, F.lit(1)))
    runs = says.withColumn("key", F.explode(F.array_distinct(F.transform(places, lambda p: F.substring(F.col("suffix"), p, F.lit(KEY))))))
    keyed = terms.withColumn("key", F.substring("term", 1, KEY))
    return runs.join(keyed, ["scope", "key"]).where((F.col("i") != F.col("j")) & F.contains(F.col("suffix"), F.col("term"))).select("scope", "i", "j").distinct()


def typed_edges(nodes: DataFrame, pairs: DataFrame, type_: str) -> DataFrame:
    """(source, target, type, evidence) of ordinal pairs."""
    a = nodes.select("scope", F.col("ord").alias("i"), F.col("node_id").alias("source"), "evidence")
    b = nodes.select("scope", F.col("ord").alias("j"), F.col("node_id").alias("target"))
    return _evidence(pairs.join(a, ["scope", "i"]).join(b, ["scope", "j"]).select("source", "target", F.lit(type_).alias("type"), "evidence"))


def appears_in(nodes: DataFrame) -> DataFrame:
    """An edge from every node to its context (column context_id), with the node's own evidence."""
    return nodes.select(F.col("node_id").alias("source"), F.col("context_id").alias("target"), F.lit("appears_in").alias("type"), "evidence")


def authored_by(contexts: DataFrame) -> DataFrame:
    """An edge from every context whose metadata names an author."""
    author = F.element_at("metadata", F.lit("author"))
    return contexts.where(author.isNotNull()).select(F.col("node_id").alias("source"), F.concat(F.lit("context_"), F.substring(F.sha2(author, 256), 1, 16)).alias("target"), F.lit("authored_by").alias("type"))


def number_within(df: DataFrame, scope: str, *order: str) -> DataFrame:
    """``df`` with ord: the place in its scope, from 0."""
    return df.withColumn("ord", (F.row_number().over(Window.partitionBy(scope).orderBy(*order)) - 1).cast("bigint"))
