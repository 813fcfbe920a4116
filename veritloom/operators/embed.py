"""Dense vectors of statements from an embedder that the caller injects."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .similarity import dense_cosine

Embedder = Callable[[list[str]], list[list[float]]]
#: Texts given to the embedder at once.
BATCH = 256


def embed(units: DataFrame, make: Callable[[], Embedder], text: str = "text", batch: int = BATCH) -> DataFrame:
    """``units`` with ``vector``; ``make`` builds the embedder once in every task.

    Equal texts are embedded once; a null text has a null vector.
    """
    kind = "key string, text string, vector array<double>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for frame in frames:
            for begin in range(0, len(frame), batch):
                part = frame.iloc[begin : begin + batch]
                yield part.assign(vector=[[float(x) for x in v] for v in model(part["text"].tolist())])

    key: Column = F.sha2(F.col(text), 256)
    distinct = units.where(F.col(text).isNotNull()).select(key.alias("key"), F.col(text).alias("text")).dropDuplicates(["key"])
    found = distinct.mapInPandas(run, kind).select(F.col("key").alias("_key"), "vector")
    return units.join(found, key == F.col("_key"), "left").drop("_key")


def dense_topk(vectors: DataFrame, k: int = 10) -> DataFrame:
    """(scope, i, j, sim), i < j: pairs of a scope (scope, ord, vector) in which one is among the other's k most similar."""
    a = vectors.select("scope", F.col("ord").alias("i"), F.col("vector").alias("x"))
    b = vectors.select("scope", F.col("ord").alias("j"), F.col("vector").alias("y"))
    near = a.join(b, "scope").where("i <> j").select("scope", "i", "j", dense_cosine(F.col("x"), F.col("y")).alias("sim"))
    best = near.withColumn("_r", F.row_number().over(Window.partitionBy("scope", "i").orderBy(F.desc("sim"), "j"))).where(F.col("_r") <= k)
    return best.select("scope", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "sim").dropDuplicates(["scope", "i", "j"])
