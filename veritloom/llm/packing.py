"""Best-fit packing of token sequences by the linear grouping scheme.

Documents are cut into pieces of at most ``capacity`` tokens and the pieces are
placed in as few sequences as possible:

1. *Histogram.*  Pieces of one length are interchangeable, so only the number
   of pieces of each length (at most ``capacity`` numbers, whatever the corpus)
   reaches the driver.
2. *Linear grouping.*  Large pieces, in order of length, fall into groups of
   equal cardinality; lengths are rounded up to the longest of their group.
3. *Configurations.*  The fractional optimum over these few sizes is found by
   column generation (a knapsack prices new configurations) and rounded down.
4. *Substitution.*  Actual pieces take the places of rounded ones.
5. *Best fit.*  What is left, small pieces above all, goes longest first into
   the fullest sequence that has room.

The plan is a short list of runs: "pieces of length l with ranks r..s go to
sequences from b on, k in each, from offset o".  Every piece finds its place by
its length and its rank among pieces of that length, which come from windows
over salted (length, salt) groups and prefix sums of their counts; no group of
equal lengths meets in one task.

Defined results: a null or empty text is a document of the end token alone;
rows with equal or null ids are separate documents; an empty table gives no
rows; columns other than the id and text are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import handing_back, written
from .tokenization import encoder, forget

#: Above this share of the capacity a piece is large.  The scheme is run for each
#: share over the same histogram and the plan with fewest sequences is taken:
#: where small pieces abound, rounding medium ones up leaves gaps too narrow for
#: them, and a higher share wins; where they are rare, a lower one does.
LARGE = (1 / 8, 1 / 4, 1 / 3, 1 / 2)
#: Groups of equal cardinality among the large pieces.
GROUPS = 64
#: Pieces of one length that are ranked in one group, on average.
SALT_ROWS = 1 << 16
#: More runs than this are joined by a shuffle instead of a broadcast.
MOST_RUNS = 1 << 16


@dataclass
class _Bins:
    """``count`` sequences from number ``first`` on, filled alike up to ``used``."""

    first: int
    count: int
    used: int


@dataclass
class Plan:
    capacity: int
    n_sequences: int = 0
    runs: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)

    def frame(self) -> pd.DataFrame:
        cols = ["length", "rank_from", "rank_to", "first_sequence", "per_sequence", "run_offset"]
        return pd.DataFrame(self.runs, columns=cols, dtype="int64")


def linear_groups(counts: dict[int, int], smallest: int, groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(rounded length, [(length, pieces), ...]) of each group, longest first."""
    large = sorted((x for x in counts.items() if x[0] >= smallest and x[1] > 0), reverse=True)
    total = sum(n for _, n in large)
    size = max(1, -(-total // groups))
    out: list[tuple[int, list[tuple[int, int]]]] = []
    room = 0
    for length, n in large:
        while n:
            if room == 0:
                out.append((length, []))
                room = size
            take = min(n, room)
            out[-1][1].append((length, take))
            n, room = n - take, room - take
    merged: dict[int, list[tuple[int, int]]] = {}
    for rounded, members in out:
        merged.setdefault(rounded, []).extend(members)
    return list(merged.items())


def _best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> np.ndarray:
    """The multiset of sizes within the capacity that is worth most (unbounded knapsack)."""
    best = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    for j in np.argsort(-sizes):
        s, w = int(sizes[j]), float(worth[j])
        if w <= 1e-12:
            continue
        for copies in range(capacity // s):  # a longer chain of the same size each time
            better = best[:-s] + w > best[s:] + 1e-12
            if not better.any():
                break
            best[s:] = np.where(better, best[:-s] + w, best[s:])
            last[s:] = np.where(better, j, last[s:])
    out = np.zeros(len(sizes), dtype=np.int64)
    at = int(np.argmax(best))
    value = best[at]
    while at > 0 and last[at] >= 0 and value > 1e-12:
        j = int(last[at])
        out[j] += 1
        value -= worth[j]
        at -= int(sizes[j])
    return out


def fractional_optimum(sizes: list[int], demand: list[int], capacity: int, rounds: int = 2000) -> list[tuple[np.ndarray, float]]:
    """Configurations with their multiplicities in a fractional optimum.

    Revised simplex on the covering program with generated columns; it stops
    when no configuration prices out (or after ``rounds`` pivots, with the
    feasible solution reached so far).
    """
    s, d = np.array(sizes), np.array(demand, dtype=float)
    basis = np.diag((capacity // s).astype(float))
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        column = _best_configuration(s, inverse.sum(axis=0), capacity).astype(float)
        if inverse.sum(axis=0) @ column <= 1 + 1e-7:
            break
        move, amount = inverse @ column, inverse @ d
        rows = np.flatnonzero(move > 1e-9)
        if not len(rows):
            break
        basis[:, rows[np.argmin(amount[rows] / move[rows])]] = column
    amount = np.linalg.solve(basis, d)
    return [(basis[:, j].round().astype(np.int64), float(amount[j])) for j in range(len(s)) if amount[j] > 1e-9]


class _Packer:
    def __init__(self, counts: dict[int, int], capacity: int):
        self.plan = Plan(capacity)
        self.left = {k: v for k, v in counts.items() if v > 0}
        self.rank = dict.fromkeys(counts, 0)
        self.open: dict[int, list[_Bins]] = {}
        self.frees: list[int] = []

    def _keep(self, bins: _Bins) -> None:
        free = self.plan.capacity - bins.used
        if bins.count and free:
            if free not in self.open:
                self.open[free] = []
                bisect.insort(self.frees, free)
            self.open[free].append(bins)

    def _run(self, length: int, pieces: int, first: int, per: int, offset: int) -> None:
        begin = self.rank[length]
        self.plan.runs.append((length, begin, begin + pieces, first, per, offset))
        self.rank[length] = begin + pieces
        self.left[length] -= pieces

    def new_bins(self, count: int) -> int:
        first = self.plan.n_sequences
        self.plan.n_sequences += count
        return first

    def fill(self, first: int, count: int, used: int, length: int, pieces: int) -> None:
        """Put ``pieces`` of one length into bins that have room for all of them."""
        per = min((self.plan.capacity - used) // length, pieces)
        full, rest = divmod(pieces, per)
        self._run(length, pieces, first, per, used)
        self._keep(_Bins(first, full, used + per * length))
        if rest:
            self._keep(_Bins(first + full, 1, used + rest * length))
        taken = full + (rest > 0)
        self._keep(_Bins(first + taken, count - taken, used))

    def best_fit(self) -> None:
        for length in sorted(self.left, reverse=True):
            while (n := self.left[length]) > 0:
                at = bisect.bisect_left(self.frees, length)
                if at == len(self.frees):
                    per = self.plan.capacity // length
                    count = -(-n // per)
                    self.fill(self.new_bins(count), count, 0, length, n)
                    continue
                free = self.frees[at]
                bins = self.open[free].pop()
                if not self.open[free]:
                    del self.open[free]
                    self.frees.pop(at)
                self.fill(bins.first, bins.count, bins.used, length, min(n, bins.count * (free // length)))

    def substitute(self, classes: list[tuple[int, list[tuple[int, int]]]], config: np.ndarray, times: int, pools: list[list[list[int]]]) -> None:
        """``times`` sequences of one configuration, with actual pieces."""
        slots = [j for j, copies in enumerate(config) for _ in range(copies)]
        first = self.new_bins(times)
        taken: list[list[tuple[int, int]]] = []
        for j in slots:
            need, got = times, []
            while need and pools[j]:
                length, n = pools[j][0]
                use = min(n, need)
                got.append((length, use))
                need -= use
                pools[j][0][1] -= use
                if not pools[j][0][1]:
                    pools[j].pop(0)
            taken.append(got)
        cuts = sorted({0, times}.union(*({sum(n for _, n in got[: k + 1]) for k in range(len(got))} for got in taken)))
        used = dict.fromkeys(cuts[:-1], 0)
        for got in taken:
            at = 0
            for length, n in got:
                inside = [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if at <= a < at + n]
                for a, b in inside:
                    self._run(length, b - a, first + a, 1, used[a])
                    used[a] += length
                at += n
        for a, b in zip(cuts, cuts[1:], strict=False):
            self._keep(_Bins(first + a, b - a, used[a]))


def plan_packing(counts: dict[int, int], capacity: int, large: tuple[float, ...] = LARGE, groups: int = GROUPS) -> Plan:
    """A packing of ``counts[length]`` pieces of each length into sequences."""
    return min((_plan_at(counts, capacity, share, groups) for share in large), key=lambda plan: plan.n_sequences)


def _plan_at(counts: dict[int, int], capacity: int, large: float, groups: int) -> Plan:
    packer = _Packer(counts, capacity)
    whole = packer.left.get(capacity, 0)
    if whole:
        packer._run(capacity, whole, packer.new_bins(whole), 1, 0)
    classes = linear_groups({k: v for k, v in packer.left.items() if k < capacity}, int(capacity * large) + 1, groups)
    if classes:
        demand = [sum(n for _, n in members) for _, members in classes]
        pools = [[list(m) for m in members] for _, members in classes]
        for config, amount in fractional_optimum([size for size, _ in classes], demand, capacity):
            times = int(amount + 1e-9)
            if times:
                packer.substitute(classes, config, times, pools)
    packer.best_fit()
    return packer.plan


def token_pieces(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, capacity: int, end_id: int) -> DataFrame:
    """One row per piece: the id as ``doc_id``, piece, start, length, ids_crc32, ids (binary, '<u4')."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from cut(batches)
        finally:  # a worker that goes on to other operators would keep hundreds of MB
            forget(vocabulary)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = encoder(vocabulary)
        width = np.dtype(lib.dtype).itemsize
        end = np.array([end_id], dtype=lib.dtype).tobytes()
        step = 4096
        for whole in batches:
            for begin in range(0, whole.num_rows, step):
                batch = whole.slice(begin, step)
                rows: list[tuple] = []
                for doc, ids in zip(batch.column(0).to_pylist(), lib.encode(batch.column(1).to_pylist()), strict=True):
                    ids += end
                    n = len(ids) // width
                    for piece, start in enumerate(range(0, n, capacity)):
                        part = np.frombuffer(ids[start * width : (start + capacity) * width], dtype=lib.dtype).astype("<u4").tobytes()
                        rows.append((doc, piece, start, len(part) // 4, zlib.crc32(part), part))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary"
    chosen = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(handing_back(run), schema)


def place_pieces(pieces: DataFrame, capacity: int, large: tuple[float, ...] = LARGE, groups: int = GROUPS) -> DataFrame:
    """``pieces`` (a written table with doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    spark = pieces.sparkSession
    counts = dict(pieces.groupBy("length").agg(F.count("*")).collect())  # at most `capacity` rows
    plan = plan_packing(counts, capacity, large, groups)
    salts = spark.createDataFrame([(k, -(-n // SALT_ROWS)) for k, n in counts.items()], "length bigint, _salts bigint")
    salted = pieces.join(F.broadcast(salts), "length").withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "_salts")).drop("_salts")
    per_salt = written(salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")), "pack-counts")
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_salt.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inner = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = (
        salted.withColumn("_row", F.row_number().over(inner) - 1)
        .join(bases, ["length", "_salt"])
        .withColumn("_rank", F.col("_base") + F.col("_row"))
    )
    runs = spark.createDataFrame(plan.frame(), "length bigint, rank_from bigint, rank_to bigint, first_sequence bigint, per_sequence bigint, run_offset bigint")
    if len(plan.runs) <= MOST_RUNS:
        runs = F.broadcast(runs)
    within = F.col("_rank") - F.col("rank_from")
    placed = ranked.join(runs.withColumnRenamed("length", "_length"), (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("rank_from")) & (F.col("_rank") < F.col("rank_to")))
    return placed.withColumns(
        {
            "sequence_id": F.col("first_sequence") + F.floor(within / F.col("per_sequence")),
            "offset": F.col("run_offset") + (within % F.col("per_sequence")) * F.col("length"),
        }
    ).drop("_length", "_salt", "_row", "_base", "_rank", "rank_from", "rank_to", "first_sequence", "per_sequence", "run_offset")


def best_fit_packing(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, keep_ids: bool = True
) -> DataFrame:
    """Pack whole documents; one row per piece with its ids and its place.

    ``keep_ids=False`` leaves the token ids out of the written table, for uses
    that need places and checksums only.
    """
    pieces = token_pieces(docs, id_col, text_col, vocabulary, capacity, end_id)
    if not keep_ids:
        pieces = pieces.drop("ids")
    return place_pieces(written(pieces, "pack-pieces"), capacity)
