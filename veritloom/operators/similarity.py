"""Similarity of statements (sparse term vectors) and of dense vectors.

Statement operators take ``units`` (scope, ord, text): statements are compared
within one scope (a document, or one value for a corpus) and ``ord`` is their
order in it.  Scopes are compared in blocks (``blocks.py``); under a threshold,
large ones pair only statements that share one of their rarest tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import VECTOR_STOPWORDS, words
from ..plans.lineage import cut
from . import blocks

SIMILARITY_METHOD = "cosine"


def tokens(text: Column) -> Column:
    return F.filter(words(F.lower(text)), lambda w: (F.length(w) > 1) & ~w.isin(VECTOR_STOPWORDS))


def term_vectors(units: DataFrame) -> DataFrame:
    """(scope, ord, token, tf): term frequencies of each statement."""
    return units.select("scope", "ord", F.explode(tokens(F.col("text"))).alias("token")).groupBy("scope", "ord", "token").agg(F.count("*").alias("tf"))


def norms(vectors: DataFrame) -> DataFrame:
    """(scope, ord, sq): squared lengths."""
    return vectors.groupBy("scope", "ord").agg(F.sum(F.col("tf") * F.col("tf")).alias("sq"))


def cosine_of(dot: Column, sq_a: Column, sq_b: Column) -> Column:
    """Clamped to [0, 1]; 0 where a vector is zero."""
    size = F.sqrt(sq_a.cast("double")) * F.sqrt(sq_b.cast("double"))
    return F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot.cast("double") / size))).otherwise(F.lit(0.0))


def similarity_of(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """``pairs`` (scope, i, j) with their sim."""
    words_in = units.select("scope", "ord", tokens(F.col("text")).alias("v"))

    def common(x: Column, y: Column) -> Column:
        """The dot product of two statements' term frequencies."""
        return F.aggregate(x, F.lit(0).cast("bigint"), lambda acc, w: acc + F.size(F.filter(y, lambda u: u == w)))

    x, y = F.col("x"), F.col("y")
    both = pairs.join(words_in.select("scope", F.col("ord").alias("i"), F.col("v").alias("x")), ["scope", "i"]).join(words_in.select("scope", F.col("ord").alias("j"), F.col("v").alias("y")), ["scope", "j"])
    return both.select("scope", "i", "j", cosine_of(common(x, y), common(x, x), common(y, y)).alias("sim"))


def close_candidates(vectors: DataFrame, threshold: float) -> DataFrame:
    """(scope, i, j), i < j: the pairs that may reach the threshold, and few others.

    Tokens of a scope rank by frequency.  Where two statements' first common
    token lies beyond a statement's prefix, their dot product is at most the
    length of what follows; so a prefix that leaves less than ``threshold`` of
    the statement's length behind it holds that token, for both statements.
    """
    frequency = vectors.groupBy("scope", "token").agg(F.count("*").alias("df")).where("df > 1")
    ranked = vectors.join(frequency, ["scope", "token"], "left").withColumn("df", F.coalesce("df", F.lit(0)))
    unit = Window.partitionBy("scope", "ord")
    # What follows and includes a token, of the whole: tokens of one statement only come first and pair with nothing.
    rest = F.sum(F.col("tf") * F.col("tf")).over(unit.orderBy("df", "token").rowsBetween(Window.currentRow, Window.unboundedFollowing))
    whole = F.sum(F.col("tf") * F.col("tf")).over(unit)
    # Slack of a millionth: rounding may never shorten a prefix.
    prefix = ranked.withColumn("rest", rest).withColumn("whole", whole).where(F.col("rest") >= F.col("whole") * (threshold * threshold * (1 - 1e-6))).where("df > 0").select("scope", "ord", "token")
    return prefix.select("scope", "token", F.col("ord").alias("i")).join(prefix.select("scope", "token", F.col("ord").alias("j")), ["scope", "token"]).where("i < j").select("scope", "i", "j").distinct()


def pairwise_threshold(units: DataFrame, threshold: float = 0.65) -> DataFrame:
    """(scope, i, j, sim), i < j: pairs of a scope at or above a threshold greater than 0."""
    rows = blocks.sized(units, tokens(F.col("text")))
    few = blocks.pairs_within(rows.where(F.col("n") <= blocks.STATEMENTS), threshold=threshold)
    many = rows.where(F.col("n") > blocks.STATEMENTS).withColumnRenamed("words", "text")
    return few.union(similarity_of(close_candidates(term_vectors(many), threshold), many).where(F.col("sim") >= threshold))


def find_similar(queries: DataFrame, units: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(scope, query, ord, sim, rank): statements of a query's scope at or above the threshold, best first."""
    q, v = queries.select("scope", "ord", "text", F.lit(True).alias("asks")), units.select("scope", "ord", "text", F.lit(False).alias("asks"))
    # Queries and statements are ranked together, so that both have one order of tokens.
    vectors = q.union(v).select("scope", F.struct("asks", "ord").alias("ord"), F.explode(tokens(F.col("text"))).alias("token")).groupBy("scope", "ord", "token").agg(F.count("*").alias("tf"))
    pairs = close_candidates(vectors, threshold).where("not i.asks and j.asks")
    found = similarity_of(pairs, q.union(v).select("scope", F.struct("asks", "ord").alias("ord"), "text")).where(F.col("sim") >= threshold).select("scope", F.col("j.ord").alias("query"), F.col("i.ord").alias("ord"), "sim")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("scope", "query").orderBy(F.desc("sim"), "ord")).cast("bigint"))


def topk_similarity(units: DataFrame, k: int = 10) -> DataFrame:
    """(scope, i, j, sim), i < j: pairs in which one is among the other's k most similar.

    Ties, zero similarities among them, go to the earlier statement.
    """
    rows = blocks.sized(units, tokens(F.col("text")))
    few = blocks.pairs_within(rows.where(F.col("n") <= blocks.STATEMENTS), k)
    return few.union(blocks.best_across(rows.where(F.col("n") > blocks.STATEMENTS), k, blocks.STATEMENTS))


def similarity_edges(nodes: DataFrame, k: int = 10) -> DataFrame:
    """related_to edges among the nodes (scope, ord, node_id, text) of each scope, with their metadata."""
    rows = blocks.sized(nodes, tokens(F.col("text")), "node_id")
    few = blocks.pairs_within(rows.where(F.col("n") <= blocks.STATEMENTS), k, name="node_id").select("scope", "i", "j", "source", "target", "sim")
    many = rows.where(F.col("n") > blocks.STATEMENTS)
    a = many.select("scope", F.col("ord").alias("i"), F.col("node_id").alias("source"))
    b = many.select("scope", F.col("ord").alias("j"), F.col("node_id").alias("target"))
    named = blocks.best_across(many, k, blocks.STATEMENTS).join(a, ["scope", "i"]).join(b, ["scope", "j"]).select("scope", "i", "j", "source", "target", "sim")
    meta = F.struct(F.lit(SIMILARITY_METHOD).alias("similarity_method"), F.lit(k).alias("k"), F.lit("topk").alias("measurement_type"))
    return few.union(named).select("scope", "i", "j", "source", "target", F.lit("related_to").alias("type"), F.col("sim").alias("weight"), meta.alias("metadata"))


def fuzzy_dedup(units: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Statements that stay when each, in order, goes if it is close to one that stayed before.

    Rounds settle what is certain: a statement without undecided or kept earlier
    neighbours stays, one with a kept earlier neighbour goes.  Rounds grow with
    the longest chain of close statements, not with their number.
    """
    links = cut(pairwise_threshold(units, threshold).select("scope", "i", "j"))
    waiting = cut(links.select("scope", F.col("j").alias("ord")).distinct())
    gone = None
    while not waiting.isEmpty():
        open_ = waiting.select("scope", F.col("ord").alias("i"), F.lit(True).alias("open"))
        lost = None if gone is None else gone.select("scope", F.col("ord").alias("i"), F.lit(True).alias("lost"))
        state = links.join(waiting.withColumnRenamed("ord", "j"), ["scope", "j"]).join(open_, ["scope", "i"], "left")
        state = state.withColumn("lost", F.lit(None).cast("boolean")) if lost is None else state.join(lost, ["scope", "i"], "left")
        # An earlier neighbour is open, lost, or else kept.
        judged = state.groupBy("scope", "j").agg(
            F.max(F.col("open").isNull() & F.col("lost").isNull()).alias("near_kept"), F.max(F.col("open").isNotNull()).alias("near_open")
        )
        judged = cut(judged.withColumnRenamed("j", "ord"))
        now_gone = judged.where("near_kept").select("scope", "ord")
        gone = now_gone if gone is None else cut(gone.union(now_gone))
        waiting = cut(judged.where("not near_kept and near_open").select("scope", "ord"))
    return units if gone is None else units.join(gone, ["scope", "ord"], "left_anti")


def dense_cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision, clamped to [0, 1]; 0 for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / size))).otherwise(F.lit(0.0))


def exact_hash_match(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes whose stability hash equals a query's (query_id, stability_hash)."""
    return queries.join(nodes.select("node_id", "stability_hash"), "stability_hash").select("query_id", "node_id")
