"""Similarities of all statements of a scope, block by block, in Arrow batches.

A scope's statements meet in one task as texts of tokens, so pairs are never
shuffled, and a task holds at most ``MOST`` cells of its pairs at once.  Scopes
of more than ``STATEMENTS`` are dealt into blocks, a task each, past which the
other statements of the scope stream.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Statements of a scope, or of a block of it, that a task holds.
STATEMENTS = 4096
#: Cells of a dense matrix (32 MB).
MOST = 1 << 22
#: Pairs of one Arrow batch, about.
_BATCH = 1 << 16


def sized(units: DataFrame, words, *carry: str) -> DataFrame:
    """(scope, ord, words, n): tokens put together by spaces, and how many statements the scope has; ``carry`` goes with them."""
    every = Window.partitionBy("scope").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known = units.where("scope is not null and ord is not null")
    return known.select("scope", "ord", *carry, F.coalesce(F.array_join(words, " "), F.lit("")).alias("words")).withColumn("n", F.count("*").over(every))


class _Vectors:
    """Term frequencies of statements in sparse form; ``words`` gives each token its column."""

    def __init__(self, texts: list[str], words: dict[str, int], grow: bool = True):
        rows, cols, tf = [], [], []
        self.n, squared = len(texts), [0] * len(texts)
        for r, text in enumerate(texts):
            if text:
                found = Counter(text.split(" "))
                squared[r] = sum(v * v for v in found.values())
                for token, v in found.items():
                    at = words.setdefault(token, len(words)) if grow else words.get(token)
                    if at is not None:
                        rows.append(r)
                        cols.append(at)
                        tf.append(v)
        self.size = np.sqrt(np.array(squared, np.float64))
        order = np.argsort(np.array(cols, np.int64), kind="stable")
        self.rows, self.cols, self.tf = (np.array(x, np.int64)[order] for x in (rows, cols, tf))

    def only(self, keep: np.ndarray) -> None:
        """Columns that are kept, numbered anew."""
        mine = keep[self.cols]
        place = np.cumsum(keep) - 1
        self.rows, self.cols, self.tf = self.rows[mine], place[self.cols[mine]], self.tf[mine]

    def dense(self, first: int, last: int) -> np.ndarray:
        """Columns first..last of all rows."""
        a, b = np.searchsorted(self.cols, (first, last))
        out = np.zeros((self.n, last - first))
        out[self.rows[a:b], self.cols[a:b] - first] = self.tf[a:b]
        return out


def _similarities(one: _Vectors, other: _Vectors, columns: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, similarities of some rows of ``one`` with all of ``other``)."""
    step = max(1, MOST // max(1, other.n))
    wide = max(1, min(columns, MOST // max(1, one.n, other.n)))
    whole = (one.dense(0, columns), other.dense(0, columns)) if wide >= columns else None
    for begin in range(0, one.n, step):
        dots = np.zeros((min(step, one.n - begin), other.n))
        for first in range(0, columns, wide):
            x, y = whole or (one.dense(first, min(columns, first + wide)), other.dense(first, min(columns, first + wide)))
            dots += x[begin : begin + step] @ y.T  # whole numbers, exact
        size = one.size[begin : begin + step, None] * other.size[None, :]
        yield begin, np.clip(np.divide(dots, size, out=np.zeros_like(dots), where=size > 0), 0.0, 1.0)


def _best(sim: np.ndarray, k: int) -> np.ndarray:
    """Marks each row's k greatest, the first of equals."""
    if sim.shape[1] <= k:
        return np.ones(sim.shape, bool)
    edge = np.partition(sim, sim.shape[1] - k, axis=1)[:, -k][:, None]
    more, same = sim > edge, sim == edge
    return more | (same & (np.cumsum(same, axis=1) <= k - more.sum(axis=1, keepdims=True)))


def _merged(ords: list, texts: list[str]) -> tuple[list, list[str]]:
    """Rows of one place are one statement."""
    if all(a != b for a, b in zip(ords, ords[1:], strict=False)):
        return ords, texts
    places, put = [], []
    for o, t in zip(ords, texts, strict=True):
        if places and places[-1] == o:
            put[-1] = " ".join(filter(None, (put[-1], t)))
        else:
            places.append(o)
            put.append(t)
    return places, put


def _within(texts: list[str], k: int | None, threshold: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, sim), i < j, of a scope's statements: pairs among the k best of either, or those at the threshold."""
    words: dict[str, int] = {}
    v = _Vectors(texts, words)
    keep = np.bincount(v.cols, minlength=len(words)) > 1
    v.only(keep)
    n, found = v.n, []
    for begin, sim in _similarities(v, v, int(keep.sum())):
        own = np.arange(begin, begin + len(sim))
        if k is None:
            i, j = np.nonzero(sim >= threshold)
            mine = i + begin < j
            i, j = i[mine], j[mine]
        else:
            sim[np.arange(len(sim)), own] = -1.0
            marked = _best(sim, min(k, n - 1)) if n > 1 else np.zeros(sim.shape, bool)
            marked[np.arange(len(sim)), own] = False
            i, j = np.nonzero(marked)
        found.append((np.minimum(i + begin, j) * n + np.maximum(i + begin, j), sim[i, j]))
    code, sims = (np.concatenate(x) for x in zip(*found, strict=True))
    code, first = np.unique(code, return_index=True)
    return code // n, code % n, sims[first]


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Rows of sorted batches by their first columns."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    return groupby(rows, key=lambda r: r[:keys])


def _schema(rows: DataFrame) -> str:
    kind = {c: rows.schema[c].dataType.simpleString() for c in ("scope", "ord")}
    return f"scope {kind['scope']}, i {kind['ord']}, j {kind['ord']}, sim double"


def _arrow(rows: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_type

    scope, ord_ = (to_arrow_type(rows.schema[c].dataType) for c in ("scope", "ord"))
    return pa.schema([("scope", scope), ("i", ord_), ("j", ord_), ("sim", pa.float64())])


def pairs_within(rows: DataFrame, k: int | None = None, threshold: float | None = None, name: str | None = None) -> DataFrame:
    """(scope, i, j, sim), i < j, of scopes of at most STATEMENTS from :func:`sized`.

    With ``name``, a column of strings or bytes, also source and target: the names of i and j
    (a row for each two names where rows of one place have several).
    """
    schema = _arrow(rows)
    kind = _schema(rows)
    if name:
        from pyspark.sql.pandas.types import to_arrow_type

        named = rows.schema[name].dataType
        schema = pa.schema([*schema, ("source", to_arrow_type(named)), ("target", to_arrow_type(named))])
        kind += f", source {named.simpleString()}, target {named.simpleString()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scopes: list = []
        ords: list = []
        names: list[list] = []
        parts: list[tuple] = []
        held = 0

        def put() -> pa.RecordBatch:
            i, j, sim = (np.concatenate(x) for x in zip(*parts, strict=True))
            place = pa.array(ords, schema.field("i").type)
            ends = []
            if name:
                counts = np.array([len(x) for x in names], np.int64)
                if (counts > 1).any():
                    every = [(p, a, b) for p, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)) for a in range(counts[x]) for b in range(counts[y])]
                    p, a, b = (np.array(x, np.int64) for x in zip(*every, strict=True))
                    i, j, sim = i[p], j[p], sim[p]
                else:
                    a = b = np.zeros(len(i), np.int64)
                flat, begin = pa.array([n for x in names for n in x], schema.field("source").type), np.cumsum(counts) - counts
                ends = [flat.take(pa.array(begin[i] + a)), flat.take(pa.array(begin[j] + b))]
            return pa.RecordBatch.from_arrays([pa.array(scopes, schema.field("scope").type).take(pa.array(i)), place.take(pa.array(i)), place.take(pa.array(j)), pa.array(sim), *ends], schema=schema)

        for (scope,), members in _groups(batches, 1):
            _, mine, texts, *called = zip(*members, strict=True)
            places, put_together = _merged(list(mine), list(texts))
            i, j, sim = _within(put_together, k, threshold)
            if len(i):
                parts.append((i + len(ords), j + len(ords), sim))
                scopes += [scope] * len(places)
                ords += places
                held += len(i)
                if name:
                    if len(places) == len(mine):
                        names += [[x] for x in called[0]]
                    else:
                        names += [[x for _, x in g] for _, g in groupby(zip(mine, called[0], strict=True), key=lambda r: r[0])]
            if held >= _BATCH:
                yield put()
                scopes, ords, names, parts, held = [], [], [], [], 0
        if parts:
            yield put()

    return rows.select("scope", "ord", "words", *([name] if name else [])).sortWithinPartitions("scope", "ord").mapInArrow(run, kind)


def best_across(rows: DataFrame, k: int, most: int) -> DataFrame:
    """(scope, i, j, sim), i < j, of scopes of more than ``most`` statements whose ord is a whole number."""
    blocks = F.ceil(F.col("n") / most)
    own = F.pmod(F.xxhash64("ord"), blocks)
    dealt = rows.select("scope", "ord", "words", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)).alias("block"))
    dealt = dealt.select("scope", "block", F.when(F.col("own") == F.col("block"), 0).otherwise(1).alias("passes"), F.col("ord").cast("bigint").alias("ord"), "words")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema([_arrow(rows).field("scope"), ("i", pa.int64()), ("j", pa.int64()), ("sim", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (scope, _), members in _groups(batches, 2):
            words: dict[str, int] = {}
            mine: _Vectors | None = None
            ords = np.zeros(0, np.int64)
            best, who = np.zeros((0, k)), np.zeros((0, k), np.int64)
            for passes, some in _chunks(members, most):
                places, texts = _merged([r[3] for r in some], [r[4] for r in some])
                if not passes:
                    mine, ords = _Vectors(texts, words), np.array(places, np.int64)
                    best, who = np.full((len(ords), k), -1.0), np.full((len(ords), k), -1, np.int64)
                if mine is None:  # nothing of the scope is in this block
                    continue
                others, at = _Vectors(texts, words, grow=False), np.array(places, np.int64)
                for begin, sim in _similarities(mine, others, len(words)):
                    part = slice(begin, begin + len(sim))
                    sim[ords[part, None] == at[None, :]] = -1.0
                    width = min(k, sim.shape[1])
                    _, j = np.nonzero(_best(sim, width))
                    j = j.reshape(len(sim), width)
                    sims, names = np.hstack([best[part], np.take_along_axis(sim, j, 1)]), np.hstack([who[part], at[j]])
                    order = np.lexsort((names, -sims), axis=1)[:, :k]
                    best[part], who[part] = np.take_along_axis(sims, order, 1), np.take_along_axis(names, order, 1)
            r, c = np.nonzero(best >= 0)
            for begin in range(0, len(r), _BATCH):
                i, j, sim = ords[r[begin : begin + _BATCH]], who[r, c][begin : begin + _BATCH], best[r, c][begin : begin + _BATCH]
                yield pa.RecordBatch.from_arrays([pa.array([scope] * len(i), schema.field("scope").type), pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j)), pa.array(sim)], schema=schema)

    kind = f"scope {rows.schema['scope'].dataType.simpleString()}, i bigint, j bigint, sim double"
    sorted_ = dealt.repartition(n, "scope", "block").sortWithinPartitions("scope", "block", "passes", "ord")
    return sorted_.mapInArrow(run, kind).dropDuplicates(["scope", "i", "j"])


def _chunks(rows: Iterator[tuple], most: int) -> Iterator[tuple[int, list[tuple]]]:
    """The block's own rows at once, then those that pass, some at a time; rows of one place stay together."""
    some: list[tuple] = []
    for r in rows:
        if some and (r[2] != some[-1][2] or (r[2] and len(some) >= most and r[3] != some[-1][3])):
            yield some[-1][2], some
            some = []
        some.append(r)
    if some:
        yield some[-1][2], some
