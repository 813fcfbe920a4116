"""Cutting lineage for iterative plans, and numbering rows without one task for all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names (a local one only where all runs in one process)."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return (folder or "file:///tmp/checkpoints").rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """``df`` with the place of each row (from 0) in an order of all rows.

    Rows are dealt into ranges and sorted there; a range's first place is the
    prefix sum of the sizes of those before it, one row a range.
    """
    at = F.monotonically_increasing_id()
    sorted_ = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", at.bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = sorted_.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return sorted_.join(F.broadcast(bases), "_part").withColumn(name, F.col("_base") + F.col("_at")).drop("_part", "_at", "_base")
