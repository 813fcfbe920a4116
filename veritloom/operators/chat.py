"""Batches of chat messages by the number of their statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .extract import parse
from .validate import violations

BATCH_NODES = 50


def said_by(messages: DataFrame, role: str = "assistant") -> DataFrame:
    """The messages of one role."""
    return messages.where(F.col("role") == role)


def valid_units(text: Column, strict: bool = True) -> Column:
    """How many statements of a text are valid."""
    return F.size(F.filter(parse(text), lambda u: F.size(violations(u["text"], strict)) == 0)).cast("bigint")


def greedy_batches(sizes: Column, least: int = BATCH_NODES) -> Column:
    """Batch numbers of sizes in order: a batch closes once it holds ``least`` or more."""
    done = F.aggregate(
        sizes,
        F.struct(F.lit(0).cast("bigint").alias("held"), F.lit(0).cast("bigint").alias("batch"), F.array().cast("array<bigint>").alias("out")),
        lambda acc, n: F.struct(
            F.when(acc["held"] + n >= least, F.lit(0)).otherwise(acc["held"] + n).cast("bigint").alias("held"),
            (acc["batch"] + (acc["held"] + n >= least).cast("int")).cast("bigint").alias("batch"),
            F.concat(acc["out"], F.array(acc["batch"])).alias("out"),
        ),
    )
    return done["out"]


def batch_messages(messages: DataFrame, least: int = BATCH_NODES) -> DataFrame:
    """``messages`` (scope, ord, text, n_valid) with ``batch`` within each scope."""
    packed = messages.groupBy("scope").agg(F.sort_array(F.collect_list(F.struct("ord", "n_valid", "text"))).alias("m"))
    numbered = packed.withColumn("b", greedy_batches(F.transform("m", lambda x: x["n_valid"]), least))
    return numbered.select("scope", F.explode(F.arrays_zip("m", "b")).alias("x")).select("scope", "x.m.ord", "x.m.n_valid", "x.m.text", F.col("x.b").alias("batch"))


def concatenate(batched: DataFrame, separators: bool = True) -> DataFrame:
    """(scope, batch, n_messages, content): the text of each batch."""
    packed = batched.groupBy("scope", "batch").agg(F.sort_array(F.collect_list(F.struct("ord", "text"))).alias("m"), F.count("*").alias("n_messages"))
    head = lambda i: F.concat(F.lit("\n--- Message "), (i + 1).cast("string"), F.lit(" ---\n")) if separators else F.lit("\n")
    return packed.select("scope", "batch", "n_messages", F.array_join(F.transform("m", lambda x, i: F.concat(head(i), x["text"], F.lit("\n"))), "").alias("content"))
