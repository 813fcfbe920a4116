"""The registered queries of the corpus operators, and SQL where it can say the same.

Each query applies its operator with production parameters to a whole table
and derives digest columns from what the operator returns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import best_fit_packing

    placed = best_fit_packing(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import read_token_files, write_token_files

    manifest = write_token_files(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), end_id=2)
    return read_token_files(manifest, with_ids=False)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import license_scan

    return license_scan(table(spark, sf_dir, "documents")).drop("detections")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .itq_dedup import near_duplicate_vectors

    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify, page_rows, training_rows

    pages, docs = table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents")
    return identify(page_rows(pages), training_rows(docs), markup=True).withColumnRenamed("id", "page_id")


def op7_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bloom_lm import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import LAW, shard_documents

    rows = shard_documents(table(spark, sf_dir, "documents"), shards=40)
    return rows.select("doc_id", "size", F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.lit(LAW).alias("law"), "shard", "slot", "grown_shard")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .byte_bpe import encode_documents

    ranks = _vocabulary("byte_bpe_multi_50k.tiktoken")
    coded = encode_documents(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, with_decoded=True)
    return coded.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_token_files,
        op3_license_scan,
        op4_embedding_dedup,
        op5_jaccard_join,
        op6_language_id,
        op7_bloom_lm,
        op8_sharding,
        op9_byte_bpe,
        op10_quality_rules,
    )
}

_REACH = """reach AS (SELECT id, id AS other FROM ids UNION SELECT r.id, e.b FROM reach r JOIN both_ways e ON e.a = r.other)"""

ORACLE_SQL: dict[str, str] = {
    "op4_embedding_dedup": f"""WITH RECURSIVE v AS MATERIALIZED (SELECT row_number() OVER () AS k, vec_id, embedding::DOUBLE[] AS x FROM embeddings),
good AS MATERIALIZED (SELECT * FROM v WHERE len(x) > 0 AND NOT list_contains(list_transform(x, lambda c: c IS NULL OR NOT isfinite(c)), true) AND list_dot_product(x, x) > 0),
links AS MATERIALIZED (SELECT a.k AS ka, a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.k <> b.k AND len(a.x) = len(b.x) WHERE list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= 0.9),
both_ways AS (SELECT a, b FROM links), ids AS (SELECT vec_id AS id FROM v), {_REACH},
least AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT vec_id, (SELECT count(*) FROM links WHERE ka = k) AS n_links, component_id, component_id = vec_id AS kept FROM v JOIN least ON id = vec_id""",
    "op5_jaccard_join": f"""WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i+3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_ FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL) JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * both_ >= 85 * (p.n + q.n - both_)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), ids AS (SELECT doc_id AS id FROM documents), {_REACH},
least AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN least ON id = d.doc_id""",
}
