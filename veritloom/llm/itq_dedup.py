"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

1. Equal vectors collapse to one row with a multiplicity.
2. *Rotation.*  On a bounded sample, principal directions are followed by an
   orthogonal rotation that alternates with the binary codes it gives (ITQ), so
   that bits are balanced and quantisation loses little.
3. *Codes.*  Every vector gets a code of several parts.  Each part is the key
   of one hash table; vectors are candidates when any of their parts are equal,
   so codes within a Hamming distance below the number of parts always meet.
4. *Rerank.*  Candidates are compared by the cosine of the original vectors in
   double precision; a pair found in several tables counts in the first only.

A bucket of a table is cut into tiles of bounded size and every pair of tiles
is one task's group, so no bucket has to fit in one task.  Pairs are counted and
tied inside the group: a group returns a row per vector (its links and the
smallest vector it is tied to), never its pairs.

Parameters follow from the angle and the number of vectors.  At cosine 0.9 a bit
differs with probability 0.144 (the angle over pi), so a part of w bits agrees
with 0.856**w and as many tables are made as bring the chance that at least one
agrees to ``RECALL``.  Parts have 8 bits (and 9 tables) up to 2**17 vectors and one more with
every doubling, so a bucket of vectors that have nothing in common keeps its
size: work grows with N**1.22, not with N**2.  ``recall`` in the tests compares
with brute force.

Defined results: vectors that are null, empty, zero, or hold a null or
non-finite component link with nothing; vectors of different length never link
(codes of a length that the sample lacks come from the signs of components);
rows with equal ids are rows of their own that share a node; a null id keeps a
null component and links with nothing; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written
from .components import connected_components

#: Vectors in a bucket of unrelated ones, about; the least bits of a part; the chance to meet at the cosine.
BUCKET, LEAST_BITS, RECALL = 512, 8, 0.95
#: Vectors that the rotation is fitted on (by least hash of their id).
SAMPLE = 4096
ITERATIONS = 30
#: Rows in a tile of a bucket.
TILE = 2048


def plan_tables(n: int, cosine: float = 0.9) -> tuple[int, int]:
    """(bits of a part, tables) for ``n`` vectors."""
    width = min(31, max(LEAST_BITS, math.ceil(math.log2(max(n, 1) / BUCKET))))
    agree = (1 - math.acos(cosine) / math.pi) ** width
    return width, math.ceil(math.log(1 - RECALL) / math.log(1 - agree))


def fit_rotation(sample: np.ndarray, bits: int, iterations: int = ITERATIONS, seed: int = 7) -> np.ndarray:
    """Projection of unit vectors: the sign of ``x @ projection`` is the code.

    Vectors are not centred: the angle between two of them then bounds how many
    bits are likely to differ, also where all lie close together.  With fewer dimensions than bits, further rotations of the same directions
    give the rest.
    """
    rng = np.random.default_rng(seed)
    _, axes = np.linalg.eigh(sample.T @ sample)
    axes = axes[:, ::-1]
    parts, have = [], 0
    while have < bits:
        use = axes[:, : bits - have]
        low = sample @ use
        turn, _ = np.linalg.qr(rng.standard_normal((use.shape[1], use.shape[1])))
        for _ in range(iterations):
            codes = np.where(low @ turn >= 0, 1.0, -1.0)
            u, _, v = np.linalg.svd(codes.T @ low)
            turn = (u @ v).T
        parts.append(use @ turn)
        have += use.shape[1]
    return np.concatenate(parts, axis=1)


def encode(unit: np.ndarray, projection: np.ndarray, width: int) -> np.ndarray:
    """Parts of the codes as 32-bit integers [vector, table]."""
    bits = (unit @ projection >= 0).reshape(len(unit), -1, width)
    return (bits << np.arange(width)).sum(axis=2).astype(np.int32)


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.stack([np.frombuffer(r, np.float64) for r in raw])
    scaled = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow of squares
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _vectors(rows: DataFrame) -> DataFrame:
    """vec_id, raw: the vector's doubles as bytes, or null where it links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = []
            for value in batch.column(1).to_pylist():
                x = None if not value or None in value else np.array(value, np.float64) + 0.0
                raw.append(None if x is None or not np.isfinite(x).all() or not x.any() else x.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["vec_id", "raw"])

    return rows.mapInArrow(run, "vec_id bigint, raw binary")


def _tables(reps: DataFrame, fitted: dict[int, np.ndarray], width: int, tables: int) -> DataFrame:
    """A row for each vector and table: tbl, key (dimension and part of the code), rep, copies, code (all parts), raw."""
    shared = reps.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 2048):
                batch = whole.slice(begin, 2048)
                rep, copies, raw = (batch.column(k).to_pylist() for k in range(3))
                sizes = np.array([len(r) // 8 for r in raw])
                for size in np.unique(sizes).tolist():
                    at = np.flatnonzero(sizes == size)
                    mine = [raw[k] for k in at]
                    unit = _unit(mine)
                    projection = shared.value.get(size)
                    if projection is None:
                        projection = np.eye(size)[:, np.arange(width * tables) % size]
                    codes = encode(unit, projection, width)
                    packed = pa.array([c.tobytes() for c in codes], pa.binary())
                    for t in range(tables):
                        key = codes[:, t].astype(np.int64) | np.int64(size << 32)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([t] * len(at), pa.int32()), pa.array(key), pa.array([rep[k] for k in at], pa.int64()), pa.array([copies[k] for k in at], pa.int64()), packed, pa.array(mine, pa.binary())],
                            names=["tbl", "key", "rep", "copies", "code", "raw"],
                        )

    return reps.select("rep", "copies", "raw").mapInArrow(run, "tbl int, key bigint, rep bigint, copies bigint, code binary, raw binary")


def _first_table(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first table in which two codes (rows) share their part."""
    return (a == b).argmax(axis=1)


def _least_tied(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and links a-b the least node of each one's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if (after == root).all():
            return root
        root = after


def _rerank(tiled: DataFrame, cosine: float) -> DataFrame:
    """Links and the least tied vector of every vector of every group of two tiles."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        t, i, j = int(group["tbl"].iat[0]), int(group["i"].iat[0]), int(group["j"].iat[0])
        group = group.sort_values("rep", kind="stable")
        rep, copies, tile = group["rep"].to_numpy(), group["copies"].to_numpy(), group["tile"].to_numpy()
        code, unit = np.stack([np.frombuffer(c, np.int32) for c in group["code"]]), _unit(group["raw"].tolist())
        left = np.flatnonzero(tile == i)
        right = np.flatnonzero(tile == j)
        links = np.zeros(len(rep), np.int64)
        found = []
        for begin in range(0, len(left), 512):
            rows = left[begin : begin + 512]
            x, y = np.nonzero(unit[rows] @ unit[right].T >= cosine)
            a, b = rows[x], right[y]
            if i == j:
                a, b = a[(keep := a < b)], b[keep]
            keep = _first_table(code[a], code[b]) == t
            a, b = a[keep], b[keep]
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            found.append((a, b))
        a, b = (np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in (0, 1))
        tied = _least_tied(len(rep), a, b)
        hit = links > 0
        return pd.DataFrame({"rep": rep[hit], "links": links[hit], "tied": rep[tied[hit]]})

    return tiled.groupBy("tbl", "key", "i", "j").applyInPandas(run, "rep bigint, links bigint, tied bigint")


def near_duplicate_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, sample: int = SAMPLE
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    plain = written(_vectors(rows), "itq-vectors")
    usable = plain.where("raw is not null and vec_id is not null")
    reps = written(usable.groupBy("raw").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "itq-reps")

    chosen = reps.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("raw").collect()
    by_size: dict[int, list[bytes]] = {}
    for (raw,) in chosen:
        by_size.setdefault(len(raw) // 8, []).append(bytes(raw))
    width, n_tables = plan_tables(reps.count(), cosine)
    fitted = {size: fit_rotation(_unit(found), width * n_tables) for size, found in by_size.items()}

    tables = written(_tables(reps, fitted, width, n_tables), "itq-tables")
    tiles = tables.groupBy("tbl", "key").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    tile = F.pmod(F.xxhash64("rep", "raw"), F.col("tiles")).cast("int")
    spread = tables.join(tiles, ["tbl", "key"]).withColumn("tile", tile)
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    tiled = spread.withColumn("other", other).select("tbl", "key", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "rep", "copies", "code", "raw")
    found = written(_rerank(tiled, cosine), "itq-links")
    discard(tables)

    of_row = plain.join(reps, "raw", "left")
    same_id = usable.join(reps, "raw").where("vec_id <> rep").groupBy("vec_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("a", "b")
    ties = found.where("rep <> tied").select(F.col("rep").alias("a"), F.col("tied").alias("b"))
    groups = connected_components(ties.union(same_id))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    return (
        of_row.join(links, "rep", "left")
        .join(groups, F.col("rep") == F.col("node"), "left")
        .select(
            "vec_id",
            F.expr("if(vec_id is null or rep is null, 0, coalesce(links, 0) + copies - 1)").cast("bigint").alias("n_links"),
            F.expr("if(vec_id is null, null, coalesce(component, rep, vec_id))").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(False)))
    )
