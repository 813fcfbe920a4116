"""Byte-level BPE with a rank queue, for pre-tokens of any length.

Symbols stand in a doubly linked list.  Positions whose pair merges at rank r
wait in bucket r; a hierarchical bitmap (three levels of 64-bit words) marks
the buckets that hold any, and find-first-set yields the lowest rank in
constant time.  An entry is stale when its position has died or its pair has
changed since; it is skipped when met.  Every merge costs constant time, so a
pre-token of n bytes takes O(n) steps plus sorting within buckets, where
rescanning all pairs for the lowest rank takes O(n^2).

Many pre-tokens share one queue: no pair crosses the border of a pre-token, and
within each the merges happen in the order of their ranks, leftmost first.

A worker's memory follows its batch and the longest pre-token, not the table:
pairs that merge are a fixed table, the cache of pre-tokens is bounded in number
and bytes, texts are split into ROUND_TOKENS pre-tokens at a time, and a queue gets
MERGE_BYTES bytes at most, or one longer pre-token (with several Python objects for
each of its bytes).

Defined results: a null or empty text has no ids; equal texts have equal ids;
bytes that no merge covers stay single-byte ids, so decoding gives the text's
bytes back; null and repeated document ids are kept as they are; an empty table
gives no rows; columns other than the id and text are ignored, whatever their
names.
"""

from __future__ import annotations

import base64
import sys
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches

#: Pre-tokens kept per worker with their ids, and the bytes that both may take.
CACHE_TOKENS = 400_000
CACHE_BYTES = 48 << 20
LONGEST_KEPT = 40
#: Pre-tokens looked up together, and bytes of unknown ones merged together.
ROUND_TOKENS = 100_000
MERGE_BYTES = 4096
_NONE = -1


class RankQueue:
    """Positions by rank; :meth:`pop` gives those of the lowest rank in use."""

    def __init__(self, ranks: int):
        self.buckets: dict[int, list[int]] = {}
        self.low = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0

    def push(self, rank: int, positions: list[int]) -> None:
        bucket = self.buckets.get(rank)
        if bucket:
            bucket.extend(positions)
            return
        self.buckets[rank] = positions
        a = rank >> 6
        self.low[a] |= 1 << (rank & 63)
        self.mid[a >> 6] |= 1 << (a & 63)
        self.top |= 1 << (a >> 6)

    def pop(self) -> tuple[int, list[int]] | None:
        top = self.top
        if not top:
            return None
        b = (top & -top).bit_length() - 1
        word = self.mid[b]
        a = (b << 6) + (word & -word).bit_length() - 1
        word = self.low[a]
        rank = (a << 6) + (word & -word).bit_length() - 1
        word &= word - 1
        self.low[a] = word
        if not word:
            self.mid[b] &= ~(1 << (a & 63))
            if not self.mid[b]:
                self.top &= ~(1 << b)
        return rank, self.buckets.pop(rank)


class ByteBpe:
    """Encoder and decoder for a table of byte strings and their ranks (= ids)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, capacity: int = CACHE_TOKENS):
        import regex

        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.text = [b""] * self.size
        for token, rank in ranks.items():
            self.text[rank] = token
        self.byte = [ranks[bytes([b])] for b in range(256)]
        self.pattern = regex.compile(pattern)
        #: Ranks of all pairs of symbols that make a token.
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    self.pairs[left * self.size + right] = rank
        self.kept: dict[str, bytes] = {}
        self.kept_bytes = 0
        self.capacity = capacity

    def merge(self, pretokens: list[bytes]) -> list[list[int]]:
        """Ids of each pre-token."""
        byte, size, known = self.byte, self.size, self.pairs
        symbol: list[int] = []
        starts: list[int] = []
        for token in pretokens:
            starts.append(len(symbol))
            symbol.extend([byte[b] for b in token])
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for start in starts:
            if start < n:
                before[start] = _NONE
            if start:
                after[start - 1] = _NONE
        if n:
            after[n - 1] = _NONE
        rank_at = [_NONE] * n
        queue = RankQueue(size)
        first: dict[int, list[int]] = {}
        for i in range(n):
            if after[i] != _NONE:
                rank = known.get(symbol[i] * size + symbol[i + 1], _NONE)
                if rank != _NONE:
                    rank_at[i] = rank
                    first.setdefault(rank, []).append(i)
        for rank, positions in first.items():
            queue.push(rank, positions)
        while (found := queue.pop()) is not None:
            rank, positions = found
            positions.sort()
            for k, i in enumerate(positions):
                if rank_at[i] != rank:  # stale
                    continue
                j = after[i]
                beyond = after[j]
                symbol[i] = rank
                after[i] = beyond
                rank_at[j] = _NONE
                symbol[j] = _NONE
                lower = False
                if beyond != _NONE:
                    before[beyond] = i
                    new = known.get(rank * size + symbol[beyond], _NONE)
                    rank_at[i] = new
                    if new != _NONE:
                        queue.push(new, [i])
                        lower = new < rank
                else:
                    rank_at[i] = _NONE
                p = before[i]
                if p != _NONE:
                    new = known.get(symbol[p] * size + rank, _NONE)
                    rank_at[p] = new
                    if new != _NONE:
                        queue.push(new, [p])
                        lower = lower or new < rank
                if lower and k + 1 < len(positions):  # a lower rank goes first
                    queue.push(rank, positions[k + 1 :])
                    break
        out: list[list[int]] = []
        for start, token in zip(starts, pretokens, strict=True):
            ids = []
            i = start if token else _NONE
            while i != _NONE:
                ids.append(symbol[i])
                i = after[i]
            out.append(ids)
        return out

    def _split(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a text, ROUND_TOKENS at a time."""
        if len(text) <= ROUND_TOKENS:
            yield self.pattern.findall(text)
            return
        found = self.pattern.finditer(text)
        while tokens := [m[0] for m in islice(found, ROUND_TOKENS)]:
            yield tokens

    def _ids(self, split: list[list[str]]) -> list[bytes]:
        """The ids of each list of pre-tokens; new ones are kept while there is room."""
        kept = self.kept
        fresh: dict[str, bytes] = {}
        todo: list[tuple[str, bytes]] = []
        size = 0

        def merge() -> None:
            for (token, _), ids in zip(todo, self.merge([raw for _, raw in todo]), strict=True):
                fresh[token] = np.array(ids, dtype="<u4").tobytes()
            todo.clear()

        for token in set().union(*split).difference(kept):
            raw = token.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                fresh[token] = whole.to_bytes(4, "little")
                continue
            if todo and size + len(raw) > MERGE_BYTES:
                merge()
                size = 0
            todo.append((token, raw))
            size += len(raw)
        merge()
        out = [b"".join(map(fresh.get, tokens, map(kept.get, tokens))) for tokens in split]
        for token, ids in fresh.items():
            if len(kept) >= self.capacity or self.kept_bytes >= CACHE_BYTES:
                break
            if len(token) <= LONGEST_KEPT:
                kept[token] = ids
                self.kept_bytes += sys.getsizeof(token) + sys.getsizeof(ids)
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        at: list[int] = []
        split: list[list[str]] = []
        size = 0

        def look_up() -> None:
            for k, ids in zip(at, self._ids(split), strict=True):
                out[k].append(ids)
            at.clear()
            split.clear()

        for k, text in enumerate(texts):
            for tokens in self._split(text or ""):
                at.append(k)
                split.append(tokens)
                size += len(tokens)
                if size >= ROUND_TOKENS:
                    look_up()
                    size = 0
        look_up()
        return [b"".join(parts) for parts in out]

    def decode(self, ids: bytes) -> bytes:
        found, text = np.frombuffer(ids, dtype="<u4"), self.text.__getitem__
        return b"".join(b"".join(map(text, found[k : k + ROUND_TOKENS].tolist())) for k in range(0, len(found), ROUND_TOKENS))


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}


_CODECS: dict[tuple[str, str], ByteBpe] = {}


def codec(path: str, pattern: str) -> ByteBpe:
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = ByteBpe(load_ranks(path), pattern)
    return _CODECS[path, pattern]


def encode_documents(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_decoded: bool = False
) -> DataFrame:
    """doc_id, ids (binary, '<u4') of every document's whole text.

    ``with_decoded`` adds the column of :func:`decode_documents` in the same
    Python worker: a worker of its own would hold the codec and batches again.
    """
    names = ["doc_id", "ids", "decoded"] if with_decoded else ["doc_id", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(ranks_path, pattern)
        for batch, texts in text_batches(batches, 1):
            ids = bpe.encode([None if x is None else x.decode() for x in texts])
            columns = [batch.column(0), pa.array(ids, pa.binary())]
            if with_decoded:
                columns.append(pa.array([bpe.decode(x) for x in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id bigint, ids binary" + ", decoded binary" * with_decoded
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` (doc_id, ids) with ``decoded``, the bytes its ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(ranks_path, pattern)
        for batch, ids in text_batches(batches, 1):
            decoded = pa.array([None if x is None else bpe.decode(x) for x in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id bigint, ids binary, decoded binary")


