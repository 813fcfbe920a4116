"""A training-data pipeline: quality rules, language ID, n-gram Jaccard join, packing.

``run(spark, sf_dir)`` applies the stages to ``documents``; each stage's result
is written as Parquet and read again as the next one's documents.  All stages
but the last return the columns of ``documents``, whatever their names: a row
travels as one struct.  Filters add no shuffle of texts of their own.

Defined results: null and empty texts fail the base rules and go with the first
stage; rows with a null id are judged like others and are never near copies;
rows that share an id are documents of their own in every stage, equal rows
copies of each other; without labels the base rules decide alone; without a
declared language nothing can be told apart and the second stage keeps nothing;
an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritloom.llm.common import table, written

#: SQL cannot express tokenisation (nor 64-bit hashes); a brute-force version tests run().
ORACLE_SQL = None


def _row(docs: DataFrame) -> Column:
    """All columns as one."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood-ratio threshold."""
    from veritloom.llm import quality_rules as op

    judged = op.quality_rules(docs.select(_row(docs), "doc_id", "text"), table(spark, sf_dir, "labels"), carry=("row",))
    return judged.where("kept").select("row.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the known languages, told with confidence.

    The model learns from the lang column, so that column is no evidence here:
    text and source decide.  Only verdicts of rejected documents are joined.
    """
    from veritloom.llm.language_id import document_rows, identify, training_rows

    keyed = docs.select(_row(docs), F.xxhash64("doc_id", "text", "lang", "source").alias("key"))  # equal for equal rows
    rows = document_rows(keyed.select(F.col("key").alias("doc_id"), "row.text", "row.source"))
    gone = identify(rows, training_rows(docs)).where("not kept").select(F.col("id").alias("gone")).distinct()
    return keyed.join(gone, F.col("key") == F.col("gone"), "left_anti").select("row.*")


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): the one with the smallest id.

    Rows with a null id stay.  Rows that share an id get one of their own from
    their content, so that they are near copies of each other only by their texts.
    """
    from veritloom.llm.jaccard_join import jaccard_components

    several = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("several"))
    repeated = not several.isEmpty()
    named = docs.select(_row(docs), F.col("doc_id").alias("id"), "text")
    if repeated:
        named = named.join(several, F.col("id") == F.col("several"), "left").withColumn("id", F.when(F.col("several").isNull(), F.col("id")).otherwise(F.xxhash64("id", "text")))
    found = jaccard_components(named, id_col="id", size=5, percent=80)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    stay = named.join(gone, F.col("id") == F.col("gone"), "left_anti")
    if repeated:
        stay = stay.where("several is null").unionByName(stay.where("several is not null").dropDuplicates(["id"]))
    return stay.select("row.*")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens."""
    import public_tokenizers

    from veritloom.llm.packing import best_fit_packing as pack

    placed = pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("n-gram Jaccard join", jaccard_join),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
