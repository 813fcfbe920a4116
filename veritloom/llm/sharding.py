"""Two-pass external shuffle of a corpus into shards, with SQL functions only.

*First pass.*  A document goes to the shard whose seeded hash with the
document's id is greatest (so a further shard takes rows only into itself, and
nothing else moves), and within the shard to one of its buckets by another
hash of the row.  The number of buckets follows from the corpus' bytes, so that
a bucket fits in a task's memory.

*Second pass.*  Each bucket is gathered and shuffled by Fisher-Yates
(``shuffle`` of an array does that), and written.  Buckets are dealt to as many
tasks as there are buckets (``MOST_TASKS`` at most), and a task holds ``HELD``
of them at a time: beyond that it sorts its rows by bucket, which may spill.  Places in a shard are
gapless: a bucket begins after the rows of the shard's buckets before it, a
prefix sum over bucket counts that reads no texts.

Equal rows differ in nothing a hash could part them by, so the copies of a row
would meet in one bucket however many there are; the row's place in the input
(split and position) is a further input of the bucket's hash and spreads them.

Defined results: null ids hash like a value of their own and stay together in
one shard; a null text has size 16 and no checksum; rows with equal ids go to
one shard (the law is by id); an empty table gives no rows; further columns
travel along whatever their names, but those named like a result (shard, slot,
size, grown_shard) are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, written

#: Bytes of documents in a bucket, on average.
BUCKET_BYTES = 8 << 20
#: Tasks of the second pass at most, and buckets that one of them gathers at a time.
MOST_TASKS, HELD = 20_000, 2
#: Bytes that count for a row besides its text.
ROW_BYTES = 16
LAW = "key"


def row_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("bigint")


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """The shard with the greatest hash of (seed, key, shard)."""
    draws = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(F.xxhash64(F.lit(seed), key, s).alias("h"), s.alias("s")))
    return F.array_max(draws)["s"]


def _grown(key: Column, shard: Column, shards: int, seed: int) -> Column:
    """The shard when there is one more: the old one, or the new."""
    best = F.xxhash64(F.lit(seed), key, shard)
    last = F.xxhash64(F.lit(seed), key, F.lit(shards))
    return F.when(last > best, F.lit(shards)).otherwise(shard)


@contextmanager
def _few_groups_in_memory(spark: SparkSession) -> Iterator[None]:
    """Aggregation of objects goes over to sorting once a task has met HELD groups."""
    name = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, HELD)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shard_documents(
    docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", seed: int = 20_240_601, bucket_bytes: int = BUCKET_BYTES, path: str | None = None
) -> DataFrame:
    """Write the shuffled shards as Parquet, partitioned by shard; return the table read back.

    It has the columns of ``docs`` and ``shard``, ``slot``, ``grown_shard``, ``size``.
    """
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot", "size", "grown_shard")
    total = docs.agg(F.sum(row_size(F.col(text_col)))).first()[0] or 0
    per_shard = max(1, -(-total // (shards * bucket_bytes)))
    # The columns of docs stand inside one, so that no name of theirs meets one of these.
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    key = F.col("row")[id_col]
    placed = docs.select(row.alias("row")).withColumn("at", F.monotonically_increasing_id())
    sent = placed.select("row", "at", shard_of(key, shards, seed).cast("int").alias("shard"), F.pmod(F.xxhash64(F.lit(seed + 1), key, "at"), F.lit(per_shard)).cast("int").alias("bucket"))
    dealt = sent.repartition(min(MOST_TASKS, shards * per_shard), "shard", "bucket")
    bucket = dealt.groupBy("shard", "bucket").agg(F.sort_array(F.collect_list(F.struct("at", "row"))).alias("rows"))
    mixed = bucket.select("shard", "bucket", F.shuffle(F.transform("rows", lambda r: r["row"]), F.lit(seed)).alias("rows"))
    path = path or fresh_path(spark, "shards")
    laid = mixed.select("shard", "bucket", F.posexplode("rows").alias("place", "row"))
    with _few_groups_in_memory(spark):
        laid.write.parquet(path)
    stored = spark.read.schema(laid.schema).parquet(path)
    counts = written(stored.groupBy("shard", "bucket").agg(F.count("*").alias("n")), "shard-counts")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = [F.col("row")[c].alias(c) for c in docs.columns]
    return stored.join(bases, ["shard", "bucket"]).select(
        *own,
        "shard",
        (F.col("base") + F.col("place")).cast("bigint").alias("slot"),
        row_size(F.col("row")[text_col]).alias("size"),
        _grown(key, F.col("shard"), shards, seed).cast("int").alias("grown_shard"),
    )
