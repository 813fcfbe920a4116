"""Token ids as flat binary files with 64-bit document offsets.

A part of the corpus, a range of document ids, becomes three files::

    tokens-<part>-<attempt>.bin   ids, unsigned little-endian, 16 bits where the vocabulary allows, else 32
    tokens-<part>-<attempt>.idx   n+1 unsigned 64-bit offsets, in ids from the start of the part
    tokens-<part>-<attempt>.doc   n signed 64-bit document ids

A *manifest* row per part names its files and sizes.  Parts follow each other
in ascending document id; the base of a part is the prefix sum of the sizes of
those before it, so documents are found without any task having seen another
part.  Files are memory-mapped for reading.  Each attempt of a task writes
files of its own and the manifest, itself a written table, names those of the
attempt that succeeded, so lost executors and speculative copies do no harm.

Defined results: a null or empty text is a document of the end token alone;
documents with a null id come first (their number is in the manifest) and keep
the null; rows with equal ids stand next to each other in order of their text's
hash; an empty table gives an empty manifest; columns other than the id and
text are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, written
from .tokenization import encoder

_MANIFEST = "part int, path string, dtype string, n_docs bigint, n_null_ids bigint, n_tokens bigint"
#: Ids kept in memory before they go to the file.
_FLUSH = 1 << 22


def _store(uri: str):
    """(filesystem, path) of a URI; a plain path or file: URI is local."""
    from pyarrow import fs

    where = urlparse(uri)
    if where.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(where.path)
    return fs.FileSystem.from_uri(uri)


def _mapped(uri: str, dtype: str) -> np.ndarray:
    where = urlparse(uri)
    if where.scheme in ("", "file"):
        path = unquote(where.path)
        import os

        return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.empty(0, dtype)
    filesystem, path = _store(uri)
    with filesystem.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype=dtype)


def write_token_files(
    docs: DataFrame, vocabulary: str, end_id: int, directory: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encode every document, write the files, and return the manifest."""
    spark = docs.sparkSession
    directory = directory or fresh_path(spark, "token-files")
    chosen = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tie = F.xxhash64("text")
    ordered = chosen.repartitionByRange(F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        lib = encoder(vocabulary)
        end = np.array([end_id], dtype=lib.dtype).tobytes()
        path = f"{directory}/tokens-{part:06d}-{uuid.uuid4().hex}"
        filesystem, local = _store(path)
        out, lengths, ids, nulls = None, [], [], 0
        waiting: list[bytes] = []
        size = 0
        for whole in batches:
            for begin in range(0, whole.num_rows, 4096):
                batch = whole.slice(begin, 4096)
                for doc, tokens in zip(batch.column(0).to_pylist(), lib.encode(batch.column(1).to_pylist()), strict=True):
                    nulls += doc is None
                    ids.append(0 if doc is None else doc)
                    waiting += (tokens, end)
                    lengths.append((len(tokens) + len(end)) // len(end))
                    size += len(tokens)
                if size > _FLUSH:
                    out = out or _create(filesystem, local)
                    out.write(b"".join(waiting))
                    waiting, size = [], 0
        if not ids:
            return
        out = out or _create(filesystem, local)
        out.write(b"".join(waiting))
        out.close()
        offsets = np.zeros(len(ids) + 1, dtype="<u8")
        np.cumsum(lengths, out=offsets[1:])
        for ending, values in (("idx", offsets), ("doc", np.array(ids, dtype="<i8"))):
            with filesystem.open_output_stream(f"{local}.{ending}") as f:
                f.write(values.tobytes())
        row = [part, path, lib.dtype, len(ids), nulls, int(offsets[-1])]
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=names)

    def _create(filesystem, local: str):
        filesystem.create_dir(local.rsplit("/", 1)[0], recursive=True)
        return filesystem.open_output_stream(f"{local}.bin")

    names = ["part", "path", "dtype", "n_docs", "n_null_ids", "n_tokens"]
    kinds = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    return written(ordered.mapInArrow(write, _MANIFEST), "token-manifest")


def with_bases(manifest: DataFrame) -> DataFrame:
    """The manifest with ``base``: ids in all parts before (a prefix sum over parts, not documents)."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """Every document of the files: doc_id, start, n_tokens, ids_crc32 and, if asked, ids (binary, '<u4')."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                ids = _mapped(f"{part['path']}.bin", part["dtype"])
                offsets = _mapped(f"{part['path']}.idx", "<u8")
                docs = _mapped(f"{part['path']}.doc", "<i8")
                step = 2048
                for k in range(0, len(docs), step):
                    bounds = offsets[k : k + step + 1].astype(np.int64)
                    parts = [ids[a:b].astype("<u4").tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
                    named = [None if k + i < part["n_null_ids"] else d for i, d in enumerate(docs[k : k + step].tolist())]
                    columns = [
                        pa.array(named, pa.int64()),
                        pa.array(bounds[:-1] + part["base"], pa.int64()),
                        pa.array(np.diff(bounds), pa.int64()),
                        pa.array([zlib.crc32(x) for x in parts], pa.int64()),
                    ]
                    if with_ids:
                        columns.append(pa.array(parts, pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, names=names[: len(columns)])

    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    n = max(1, manifest.count())
    return with_bases(manifest).repartitionByRange(n, "part").mapInArrow(read, schema)
