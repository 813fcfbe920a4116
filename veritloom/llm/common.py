"""Helpers that several corpus operators share: the shared folder, tables
written to cut lineage, and a fixed-size id filter."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no folder and all runs in one process (tests, a laptop).
FALLBACK_DIR = "file:///tmp/checkpoints"

#: An id filter has eight to sixteen bits for each id, and 2**MOST_FILTER_BITS (32 MB) at most.
LEAST_FILTER_BITS, MOST_FILTER_BITS = 16, 28


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI without a final slash."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return (found or FALLBACK_DIR).rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/veritloom/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again.

    This cuts the lineage: a lost executor costs no more than the current
    stage, and Python work above it runs once however often it is read.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables from :func:`written` that nothing will read again."""
    for table in tables:
        spark = table.sparkSession
        for name in table.inputFiles()[:1]:
            root = name.rsplit("/", 1)[0]
            if "/veritloom/" in root:
                jvm = spark.sparkContext._jvm
                path = jvm.org.apache.hadoop.fs.Path(root)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more.

    Its cleaner follows the collector of the driver's garbage, which may not run
    for a long time on a driver that does little itself.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(batches: Iterator[pa.RecordBatch], column: int, rows: int = 4096, most: int = 1_000_000) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of at most ``rows`` rows and, but for a longer text, ``most`` bytes, with the texts of a column."""
    for whole in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(whole.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        begin, before = 0, 0
        while begin < whole.num_rows:
            n = min(rows, max(1, int(np.searchsorted(upto, before + most, side="right")) - begin))
            part = whole.slice(begin, n)
            yield part, part.column(column).cast(pa.binary()).to_pylist()
            begin += n
            before = int(upto[begin - 1])


def handing_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which its Python worker returns what it has freed to the system.

    Workers outlive their tasks and serve later operators; what they keep
    counts against the executor's memory beside later stages of the JVM.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # another C library
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return whole


def _filter_slot(col: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(1 << bits))


def keep_possible_ids(rows: DataFrame, col: str, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``rows`` whose ``col`` may be among ``ids`` (no false negatives).

    A bitmap sized by the number of ids is aggregated from them and broadcast.
    It spares the shuffle of rows that the following join would drop, which
    has to be an inner one.  Where there are more ids than half of the bits that
    a filter may have, it would let most rows through and is left out; the
    join decides in any case.
    """
    n = ids.count()
    if 2 * n > 1 << MOST_FILTER_BITS:
        return rows
    size = min(MOST_FILTER_BITS, max(LEAST_FILTER_BITS, (8 * n).bit_length()))
    slot = _filter_slot(F.col(id_col), size)
    bits = ids.groupBy(F.bitmap_bucket_number(slot).alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("_bits")
    )
    mine = _filter_slot(F.col(col), size)
    spot = F.bitmap_bit_position(mine)
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.shiftright(spot, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, (spot % 8).cast("int")) == 1
    return (
        rows.withColumn("_bucket", F.bitmap_bucket_number(mine))
        .join(F.broadcast(bits), "_bucket")
        .where(hit)
        .drop("_bucket", "_bits")
    )
