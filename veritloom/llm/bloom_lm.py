"""Language-model scores from a log-frequency Bloom filter.

A count c is quantised to the number of thresholds 1, 2, 3, ... (growing by a
quarter once they can) that it reaches, and an n-gram of level q is put into
a Bloom filter q times, with levels 1 to q.  A lookup probes level after
level until one is absent: false positives can only raise a level, and grow
rarer with each.

* All training documents are counted in full: words, and pairs of neighbouring
  words (after the end mark of the document before, for a first word).  Every
  n-gram enters the filter, those seen once as well.
* The filter grows with the corpus.  It is divided by key into parts of about
  ``PART_KEYS`` n-grams, each with ``ENTRY_BITS`` bits for every level put in.
  No task holds more than a part at a time, and nothing of it is broadcast.
* Documents are dealt into slices of about a megabyte.  A slice sends each part the
  distinct n-grams it has there with their counts in training; the part sums
  the counts, builds its filter and sends the levels back.  Pairs are told apart
  within a part by ``PAIR_BYTES`` bytes of their hashes, words by all 8.
* Word probability: ``(c + 0.5) / (N + 0.5 (V + 1))``; a word after another:
  ``weight * min(1, c(pair) / c(first)) + (1 - weight) * word probability``,
  with c from probes.

The *base score* needs exact word counts, which come back beside the levels.
Words are told apart by 64-bit hashes that no simple construction makes meet; two
unequal words of a corpus do by chance with 2**-64.

Defined results: a null or empty text is one end mark; a null id is in training
and keeps its null; rows with equal ids are documents of their own; without
training documents N and V are 0; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, text_batches, written
from .hashing import find_words, hash_words, mix

PROBES = 5
#: Bits of the filter for each level of each n-gram: 0.14 % of probes of an absent one succeed.
ENTRY_BITS = 16
#: N-grams of all slices that a part of the filter takes on average, and the least number of parts.
PART_KEYS, LEAST_PARTS = 1 << 20, 64
#: Bytes of a pair's key that are sent; within a part of that size one pair in a million shares them with another.
PAIR_BYTES = 5
#: Share of the pair estimate.
WEIGHT = 0.3
_U = np.uint64
_LEFT, _RIGHT, _LEVEL, _PROBE = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9), _U(0xD6E8FEB86659FD93)


def thresholds() -> np.ndarray:
    """Counts at which the level rises, up to 2**60."""
    out = [1]
    while out[-1] < 1 << 60:
        out.append(max(out[-1] + 1, -(-out[-1] * 5 // 4)))
    return np.array(out, dtype=np.int64)


def representatives() -> np.ndarray:
    """The count that stands for each level (0 for level 0)."""
    t = thresholds().astype(float)
    return np.concatenate([[0.0], (t[:-1] + t[1:] - 1) / 2, t[-1:]])


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * _LEFT + right * _RIGHT + _U(1))


def _cells(keys: np.ndarray, level: int, probe: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(byte, bit) in a filter of ``size`` bytes of one probe of a level."""
    shift = np.array([level], np.uint64) * _LEVEL + np.array([probe + 1], np.uint64) * _PROBE
    spot = mix(keys + shift) % _U(8 * size)
    return (spot >> _U(3)).astype(np.int64), (spot & _U(7)).astype(np.uint8)


def filter_of(keys: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The bits (uint8) of a filter sized for these n-grams, with all their levels."""
    bits = np.zeros(8 + int(level.sum(dtype=np.int64)) * ENTRY_BITS // 8, np.uint8)
    at, now = np.arange(len(keys)), 1
    while len(at := at[level[at] >= now]):
        for probe in range(PROBES):
            byte, bit = _cells(keys[at], now, probe, len(bits))
            np.bitwise_or.at(bits, byte, np.left_shift(np.uint8(1), bit))
        now += 1
    return bits


def levels(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The level of each key, by probes of level 1, 2, ... until one is absent."""
    out = np.zeros(len(keys), dtype=np.int16)
    at = np.arange(len(keys))
    level, most = 0, len(thresholds())
    while len(at) and level < most:
        level += 1
        for probe in range(PROBES):
            byte, bit = _cells(keys[at], level, probe, len(bits))
            at = at[(bits[byte] >> bit) & 1 == 1]
        out[at] = level
    return out


def build_filter(words: DataFrame, pairs: DataFrame) -> np.ndarray:
    """One filter of small tables with key and level, without pairs of level 1; score_documents divides its own and leaves out none."""
    rows = words.select("key", "level").union(pairs.where("level >= 2").select("key", "level")).toPandas()
    return filter_of(rows["key"].to_numpy(np.int64).view(np.uint64), rows["level"].to_numpy(np.int64))


def held_out(doc_id: Column, folds: int = 5, fold: int = 1) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def _tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of some texts, each with its end mark, and the number of each text's."""
    joined = b"\n".join([(text or b"").lower() for text in texts])
    raw, starts, ends = find_words(joined)
    words = np.searchsorted(starts, np.cumsum([len(text or b"") + 1 for text in texts]))
    sizes = np.diff(words, prepend=0)
    out = np.insert(hash_words(raw, starts, ends), words, _END)
    return out, sizes + 1


#: The end mark's hash.
_END = np.uint64(0x5851F42D4C957F2D)


def _before(hashes: np.ndarray) -> np.ndarray:
    """The token before each; the end mark before a first one."""
    out = np.empty_like(hashes)
    out[1:] = hashes[:-1]
    out[0] = _END
    return out  # the last token of every text is the end mark itself


def _slices(docs: DataFrame) -> DataFrame:
    """Slices of documents: their ids, the lengths of their texts, all texts in one compressed buffer, and the numbers of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 36
        for batch, texts in text_batches(batches, 2):
            lengths = [len(text or b"") for text in texts]
            starts = find_words(b"\n".join([text or b"" for text in texts]))[1]
            sizes = np.diff(np.searchsorted(starts, np.cumsum(np.array(lengths) + 1)), prepend=0) + 1
            held = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            row += 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row]),
                    pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())),
                    pa.array([held.tolist()], pa.list_(pa.bool_())),
                    pa.array([lengths], pa.list_(pa.int64())),
                    pa.array([pa.compress(b"".join([text or b"" for text in texts]), "zstd", asbytes=True)], pa.binary()),
                    pa.array([int(sizes[~held].sum())]),
                    pa.array([int(sizes.sum())]),
                ],
                names=names,
            )

    names = ["slice", "doc_id", "held_out", "lengths", "texts", "n_train", "n_tokens"]
    return docs.mapInArrow(run, "slice bigint, doc_id array<bigint>, held_out array<boolean>, lengths array<bigint>, texts binary, n_train bigint, n_tokens bigint")


def _ngrams(lengths: list[int], texts: bytes) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Tokens of each document of a slice; (place of every token, distinct keys) of its words, and of its pairs."""
    ends = np.cumsum(lengths).tolist()
    whole = pa.decompress(texts, ends[-1], "zstd", asbytes=True)
    hashes, sizes = _tokens([whole[end - n : end] for n, end in zip(lengths, ends)])
    return sizes, pd.factorize(hashes), pd.factorize(pair_keys(_before(hashes), hashes))


def _dealt(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys by part, and the places where each part begins and ends."""
    part = ((keys >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)
    return np.argsort(part, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(part, minlength=parts))])


def _packed(keys: np.ndarray, pair: bool) -> bytes:
    return (keys.view(np.uint8).reshape(-1, 8)[:, :PAIR_BYTES] if pair else keys).tobytes()


def _unpacked(sent: bytes, pair: bool) -> np.ndarray:
    if not pair:
        return np.frombuffer(sent, np.uint64)
    out = np.zeros((len(sent) // PAIR_BYTES, 8), np.uint8)
    out[:, :PAIR_BYTES] = np.frombuffer(sent, np.uint8).reshape(-1, PAIR_BYTES)
    return out.view(np.uint64).ravel()


def _packed_counts(n: np.ndarray) -> bytes:
    """One byte each, or four if one needs more; as many as there are keys, which tells them apart."""
    return n.astype(np.uint8 if n.max() < 256 else np.uint32).tobytes()


def _unpacked_counts(sent: bytes, n: int) -> np.ndarray:
    return np.frombuffer(sent, np.uint8 if len(sent) == n else np.uint32)


def _asked(slices: DataFrame, parts: int) -> DataFrame:
    """What each slice asks of each part: keys of its words (pair false) or pairs, and their counts in the slice's training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                sizes, *kinds = _ngrams(x["lengths"], x["texts"])
                train = np.repeat(~np.array(x["held_out"], bool), sizes)
                found: list[tuple[int, int, bool, bytes, bytes]] = []
                for kind, (back, keys) in enumerate(kinds):
                    n = np.bincount(back[train], minlength=len(keys))
                    order, cuts = _dealt(keys, parts)
                    keys, n = keys[order], n[order]
                    found += [(p, x["slice"], kind == 1, _packed(keys[a:b], kind == 1), _packed_counts(n[a:b])) for p, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=names)

    names, types = ["part", "slice", "pair", "keys", "n"], [pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
    return slices.select("slice", "held_out", "lengths", "texts").mapInArrow(run, "part int, slice bigint, pair boolean, keys binary, n binary")


def _answered(asked: DataFrame) -> DataFrame:
    """Per slice, part and kind the levels of the keys and, of words, the exact counts; per part (slice null) its number of training words."""

    def run(rows: pa.Table) -> pa.Table:
        part = rows.column("part")[0].as_py()
        pair = rows.column("pair").to_numpy()
        keys = [_unpacked(x, p) for x, p in zip(rows.column("keys").to_pylist(), pair)]
        n = [_unpacked_counts(x, len(k)) for x, k in zip(rows.column("n").to_pylist(), keys)]
        kinds, distinct = [], 0
        for kind in (False, True):
            at = np.flatnonzero(pair == kind)
            if len(at):
                back, own = pd.factorize(np.concatenate([keys[k] for k in at]))
                total = np.zeros(len(own), np.int64)
                np.add.at(total, back, np.concatenate([n[k] for k in at]))
                kinds.append((at, back, own, total))
                distinct += 0 if kind else int((total > 0).sum())
        bits = filter_of(np.concatenate([k[2] for k in kinds]), np.concatenate([np.searchsorted(thresholds(), k[3], side="right") for k in kinds]))
        found: list[tuple[int | None, int, bool, bytes | None, bytes | None, int]] = [(None, part, False, None, None, distinct)]
        slices = rows.column("slice").to_pylist()
        for at, back, own, total in kinds:
            level, begin = levels(own, bits).astype(np.uint8), 0
            for k in at:
                mine = back[begin : begin + len(keys[k])]
                begin += len(mine)
                found.append((slices[k], part, bool(pair[k]), level[mine].tobytes(), None if pair[k] else total[mine].tobytes(), 0))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*found), types)], names=names)

    names, types = ["slice", "part", "pair", "levels", "counts", "distinct"], [pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.int64()]
    return asked.groupBy("part").applyInArrow(run, "slice bigint, part int, pair boolean, levels binary, counts binary, distinct bigint")


def _scored(slices: DataFrame, answers: DataFrame, parts: int, total: int, distinct: int, weight: float) -> DataFrame:
    """The scores of the documents of each slice."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        stands = representatives()
        below = total + 0.5 * (distinct + 1)
        x = left.to_pylist()[0]
        sizes, (back, keys), (pair_back, pairs) = _ngrams(x["lengths"], x["texts"])
        answers = sorted(right.to_pylist(), key=lambda r: r["part"])

        def told(kind: bool, field: str, dtype: type, of: np.ndarray) -> np.ndarray:
            out = np.empty(len(of), dtype)
            out[_dealt(of, parts)[0]] = np.frombuffer(b"".join(r[field] for r in answers if r["pair"] == kind), dtype)
            return out

        count = stands[told(False, "levels", np.uint8, keys)]
        exact = told(False, "counts", np.int64, keys)
        together = stands[told(True, "levels", np.uint8, pairs)][pair_back]
        alone = ((count + 0.5) / below)[back]
        # A first word follows the end mark, which every text ends with.
        first_count = np.roll(count[back], 1)
        ratio = np.minimum(1.0, together / np.maximum(first_count, 1.0))
        mixed = np.where(first_count > 0, weight * ratio + (1 - weight) * alone, alone)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        columns = [
            pa.array(x["doc_id"], pa.int64()),
            pa.array(x["held_out"], pa.bool_()),
            pa.array(sizes, pa.int64()),
            pa.array(np.add.reduceat((exact > 0).astype(np.int64)[back], starts)),
            pa.array(np.full(len(sizes), total, np.int64)),
            pa.array(np.add.reduceat(np.log10((exact + 0.5) / below)[back], starts)),
            pa.array(np.add.reduceat(np.log10(mixed), starts)),
        ]
        return pa.table(columns, names=names)

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    texts = slices.select("slice", "doc_id", "held_out", "lengths", "texts").groupBy("slice")
    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return texts.cogroup(answers.where("slice is not null").groupBy("slice")).applyInArrow(run, schema)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, fold: int = 1, weight: float = WEIGHT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    The model learns from documents outside the held-out fold and scores all.
    """
    spark = docs.sparkSession
    docs = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        held_out(F.col(id_col).cast("bigint"), folds, fold).alias("held_out"),
        F.col(text_col).cast("string").alias("text"),
    )
    slices = written(_slices(docs), "lm-slices")
    total, tokens = slices.agg(F.coalesce(F.sum("n_train"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    parts = max(LEAST_PARTS, -(-tokens // PART_KEYS))
    answers = written(_answered(_asked(slices, parts)), "lm-answers")
    distinct = answers.agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0]
    release(spark)  # after another query, as the last one's plan still holds its shuffles
    return _scored(slices, answers, parts, total, distinct, weight)
