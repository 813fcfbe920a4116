"""Topic labels through an injected labeler, in chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_terms, normalise_labels, parse_label_reply, strings

CHUNK = 50
#: What a request says before its statements; replies are read by ``parse_label_reply``.
BATCH_PROMPT = """Name the topics of every statement in the list.
Answer with one line for each, in the form "number: first topic, second topic, third topic".
Give two topics, or three at most; write them in lower case with hyphens, and prefer narrow ones to broad ones.
Write nothing else.

"""
#: The same for a chunk of one statement; its reply has no number.
SINGLE_PROMPT = """Name the topics of this statement.
Answer with one line in the form "first topic, second topic, third topic".
Give two topics, or three at most; write them in lower case with hyphens, and prefer narrow ones to broad ones.

"""


def chunk_of(ordinal: Column, size: int = CHUNK) -> Column:
    return F.floor(ordinal / size).cast("bigint")


def prompts(units: DataFrame, size: int = CHUNK) -> DataFrame:
    """(scope, chunk, n, prompt): one request per chunk of a scope's statements, in order; a chunk of one has the simple form."""
    at = Window.partitionBy("scope").orderBy("ord")
    numbered = units.withColumn("_k", F.row_number().over(at) - 1).withColumn("chunk", chunk_of(F.col("_k"), size))
    line = F.struct("_k", F.concat((F.col("_k") % size + 1).cast("string"), F.lit(". "), F.col("text")).alias("line"))
    grouped = numbered.groupBy("scope", "chunk").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(line)).alias("lines"))
    listed = F.concat(F.lit(BATCH_PROMPT), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))
    alone = F.concat(F.lit(SINGLE_PROMPT), F.substring(F.get("lines", F.lit(0))["line"], 4, 1 << 30))
    return grouped.select("scope", "chunk", "n", F.when(F.col("n") > 1, listed).otherwise(alone).alias("prompt"))


def read_replies(replies: DataFrame, size: int = CHUNK) -> DataFrame:
    """(scope, ord_, labels) of every statement of the chunks in (scope, chunk, n, reply); ord_ is its place in the scope."""
    single = F.array(normalise_labels(F.when(F.length("reply") > 0, F.col("reply")).otherwise(F.lit("general"))))
    found = F.when(F.col("n") > 1, parse_label_reply(F.col("reply"), F.col("n").cast("int"))).otherwise(single)
    return replies.select("scope", "chunk", F.posexplode(found).alias("k", "labels")).select("scope", (F.col("chunk") * size + F.col("k")).cast("bigint").alias("ord_"), "labels")


def topic_labels(units: DataFrame, labeler: Callable[[str], str], size: int = CHUNK) -> DataFrame:
    """(scope, ord_, labels) of units (scope, ord, text) by an injected labeler."""
    return read_replies(ask(prompts(units, size), labeler), size)


def default_labels(text: Column) -> Column:
    """Without a labeler: up to three canonical terms, or ``general``."""
    terms = F.slice(F.transform(canonical_terms(text), F.lower), 1, 3)
    return F.when(F.size(terms) > 0, terms).otherwise(strings(["general"]))


def ask(requests: DataFrame, labeler: Callable[[str], str]) -> DataFrame:
    """(scope, chunk, n, reply) for requests from :func:`prompts`; a failed call gives an empty reply."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def reply(prompt: str) -> str:
            try:
                return labeler(prompt)
            except Exception:  # a labeler may fail in any way; every statement then gets `general`
                return ""

        for batch in batches:
            yield batch[["scope", "chunk", "n"]].assign(reply=batch["prompt"].map(reply))

    kind = requests.schema["scope"].dataType.simpleString()
    return requests.select("scope", "chunk", "n", "prompt").mapInPandas(run, f"scope {kind}, chunk bigint, n bigint, reply string")
