"""Packing, token files, byte BPE and sharding on a fixture with every odd row, against brute force."""

from __future__ import annotations

import collections
import random
import shutil
import sys
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from veritloom.llm import byte_bpe
from veritloom.llm.byte_bpe import ByteBpe, decode_documents, encode_documents, load_ranks
from veritloom.llm.packing import best_fit_packing, fractional_optimum, plan_packing
from veritloom.llm.queries import QUERIES
from veritloom.llm.sharding import shard_documents
from veritloom.llm.token_files import read_token_files, write_token_files
from veritloom.llm.tokenization import ChunkEncoder

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id bigint, text string, shard string, slot string, piece string, length string"

ROWS = [
    (5, "The quick brown fox; it's 12 o'clock."), (3, None), (4, ""), (None, "no id here"), (9, "same"), (9, "same"), (9, "other text, same id"),
    (1, "Ünïcödé ça l'été ÀÉ İstanbul ΑΣ 中文  x y"), (2, "word " * 5000), (7, "a" * 3000), (8, " \n\t "), (6, "don't stop <|endoftext|> 😂 now"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "s", "t", "p", "l") for i, t in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(WORDS)
    t.encode_special_tokens = True
    return t


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_chunk_encoder_equals_the_library(library):
    rng = random.Random(5)
    pool = [chr(x) for x in [*range(1, 0x250), *range(0x2000, 0x2070), 0x3A3, 0x3C3, 0x130, 0x301, 0x212A, 0x4E00, 0x1F602, 0xFEFF, 0x180E]]
    texts = ["".join(rng.choice(pool) if rng.random() < 0.3 else rng.choice(" abcABCéÉ'sS1.,") for _ in range(60)) for _ in range(500)]
    small = ChunkEncoder(WORDS, capacity=10)
    assert small.by_chunk
    for found, text in zip(small.encode(texts + [None, ""]), [*texts, "", ""], strict=True):
        assert np.frombuffer(found, small.dtype).tolist() == ids_of(library, text)


def thue_morse(n):
    """A word over a, b and its complement; a polynomial modulo a power of two takes them for equal."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


@pytest.mark.parametrize("n", [64, 1024, 2048, 4096, 8192])
def test_words_made_to_collide(library, n):
    encoder = ChunkEncoder(WORDS)
    words = [*thue_morse(n), "x" + thue_morse(n)[0], "x" + thue_morse(n)[1]]
    texts = [*words, " ".join(words), words[1] + " and " + words[0]]
    for _ in range(2):
        for found, text in zip(encoder.encode(texts), texts, strict=True):
            assert np.frombuffer(found, encoder.dtype).tolist() == ids_of(library, text)


def test_words_that_share_a_hash(library, monkeypatch):
    from veritloom.llm import tokenization

    monkeypatch.setattr(tokenization, "hash_words", lambda raw, starts, ends: np.full(len(starts), 7, np.uint64) + (ends - starts).astype(np.uint64) % np.uint64(2))
    encoder = ChunkEncoder(WORDS)
    texts = ["one two three four five six", "six five one! wonderful, " + "w" * 70 + " " + "w" * 69 + "v", "seven one two " + "w" * 70, ""]
    for _ in range(2):
        for found, text in zip(encoder.encode(texts), texts, strict=True):
            assert np.frombuffer(found, encoder.dtype).tolist() == ids_of(library, text)


def test_packing(docs, library):
    rows = best_fit_packing(docs, WORDS, capacity=64).collect()
    whole = collections.Counter()
    for i, t in ROWS:
        ids = ids_of(library, t) + [0]
        for piece, start in enumerate(range(0, len(ids), 64)):
            part = ids[start : start + 64]
            whole[i, piece, start, len(part), crc(part)] += 1
    assert whole == collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) == -(-sum(r.length for r in rows) // 64)


def test_packing_of_nothing(empty):
    assert best_fit_packing(empty, WORDS).count() == 0


def test_packing_leaves_no_encoder_in_the_workers(spark, docs, tmp_path):
    own = shutil.copy(WORDS, tmp_path)

    def held(batches):
        import pyarrow as pa

        from veritloom.llm import tokenization

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"held": pa.array([own in tokenization._ENCODERS] * batch.num_rows, pa.bool_())})

    assert best_fit_packing(docs, own).count() >= len(ROWS)
    assert not any(r.held for r in spark.range(0, 64, 1, 16).mapInArrow(held, "held boolean").collect())


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    counts = dict(collections.Counter(rng.integers(1, 2049, [1, 30, 400, 3000][seed]).tolist()))
    plan = plan_packing(counts, 2048)
    used, seen = collections.defaultdict(list), collections.Counter()
    for length, a, b, first, per, offset in plan.runs:
        for r in range(a, b):
            used[first + (r - a) // per].append((offset + (r - a) % per * length, length))
            seen[length] += 1
    assert seen == collections.Counter(counts)
    assert set(used) == set(range(plan.n_sequences))
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert plan.n_sequences >= -(-sum(k * v for k, v in counts.items()) // 2048)


def test_configurations_beat_first_fit_on_thirds():
    """Sizes of a third and two thirds: the fractional optimum is the exact one."""
    found = fractional_optimum([1300, 700], [100, 100], 2048)
    assert abs(sum(x for _, x in found) - 100) < 1e-6


def test_token_files(docs, library):
    manifest = write_token_files(docs, WORDS, end_id=2)
    rows = read_token_files(manifest).orderBy("start").collect()
    assert len(rows) == len(ROWS)
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32
    named = [r.doc_id for r in rows]
    assert named[0] is None and named[1:] == sorted(named[1:])
    expected = collections.Counter((i, len(ids_of(library, t)) + 1, crc([*ids_of(library, t), 2])) for i, t in ROWS)
    assert expected == collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows)


def test_token_files_of_nothing(empty):
    assert read_token_files(write_token_files(empty, WORDS, end_id=2)).count() == 0


@pytest.fixture(scope="module")
def exact():
    return tiktoken.Encoding("exact", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(RANKS), special_tokens={})


def test_byte_bpe_round_trip(docs, exact):
    encoded = encode_documents(docs, RANKS, public_tokenizers.PATTERN)
    rows = decode_documents(encoded, RANKS, public_tokenizers.PATTERN).collect()
    found = collections.Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist()), bytes(r.decoded)) for r in rows)
    assert found == collections.Counter((i, tuple(exact.encode_ordinary(t or "")), (t or "").encode()) for i, t in ROWS)


def test_byte_bpe_ties_and_long_pretokens(exact):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += ["".join(rng.choice("etaoinshr \n1é,") for _ in range(80)) for _ in range(400)] + ["a" * 20_000, "the" * 9_000, " " * 500 + "x"]
    bpe = ByteBpe(load_ranks(RANKS), public_tokenizers.PATTERN, capacity=50)
    for found, text in zip(bpe.encode(texts), texts, strict=True):
        assert np.frombuffer(found, "<u4").tolist() == exact.encode_ordinary(text)
        assert bpe.decode(found) == text.encode()


def test_rank_queue_lower_rank_goes_first():
    """ABA outranks AB: after the first AB merges, (AB, A) goes before the second AB."""
    ranks = {bytes([b]): b for b in range(256)} | {b"ABA": 256, b"AB": 257}
    assert ByteBpe(ranks, r"[^ ]+").merge([b"ABAB"]) == [[256, ord("B")]]


def test_byte_bpe_memory_is_bounded(exact, monkeypatch):
    """Beside a text and its ids: neither many unknown words nor one long text make more than bounded rounds."""
    rng = random.Random(8)
    words = " ".join("".join(rng.choices("abcdefghijklmnopé", k=10)) for _ in range(40_000))
    for text in (words, "a bc " * 300_000):
        bpe = ByteBpe(load_ranks(RANKS), public_tokenizers.PATTERN, capacity=50)
        tracemalloc.start()
        (found,) = bpe.encode([text])
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 24e6
        assert np.frombuffer(found, "<u4").tolist() == exact.encode_ordinary(text)
        assert bpe.decode(found) == text.encode()
    monkeypatch.setattr(byte_bpe, "CACHE_BYTES", 10_000)
    bpe = ByteBpe(load_ranks(RANKS), public_tokenizers.PATTERN)
    texts = [words[k : k + 3000] for k in range(0, 60_000, 3000)] + [words[:3000]]
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.encode(texts)] == [exact.encode_ordinary(x) for x in texts]
    assert 0 < sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in bpe.kept.items()) < 10_200


def test_byte_bpe_round_trip_in_one_worker(spark, docs, empty, exact, small):
    """A worker for each of encoding and decoding would hold the codec, the cache and the batches of a task twice."""
    both = encode_documents(docs, RANKS, public_tokenizers.PATTERN, with_decoded=True)
    found = collections.Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist()), bytes(r.decoded)) for r in both.collect())
    assert found == collections.Counter((i, tuple(exact.encode_ordinary(t or "")), (t or "").encode()) for i, t in ROWS)
    assert encode_documents(empty, RANKS, public_tokenizers.PATTERN, with_decoded=True).count() == 0
    query = QUERIES["op9_byte_bpe"](spark, small)
    assert query._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_shards(docs):
    rows = shard_documents(docs, shards=4, bucket_bytes=4096).collect()
    assert collections.Counter((r.doc_id, r.text) for r in rows) == collections.Counter(ROWS)
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.size == len((r.text or "").encode()) + 16
        assert r.grown_shard in (r.shard, 4)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert len({r.shard for r in rows if r.doc_id == 9}) == 1
    grown = {(r.doc_id, r.text): r.shard for r in shard_documents(docs, shards=5, bucket_bytes=4096).collect()}
    assert all(grown[r.doc_id, r.text] == r.grown_shard for r in rows)


def test_shards_of_columns_named_like_its_own(spark):
    names = ["doc_id", "text", "at", "_at", "row", "rows", "place", "bucket", "base", "a.b"]
    docs = spark.createDataFrame([tuple([k, f"text {k}", *(f"{n}{k}" for n in names[2:])]) for k in range(50)], names)
    rows = shard_documents(docs, shards=3, bucket_bytes=200)
    assert rows.columns == [*names, "shard", "slot", "size", "grown_shard"]
    assert sorted(tuple(r)[:10] for r in rows.collect()) == sorted(map(tuple, docs.collect()))


def test_shards_of_nothing(empty):
    assert shard_documents(empty).count() == 0


def test_shards_scatter_copies(spark):
    """Copies of one row share a shard (the law is by id) but not a bucket, and are not left in order."""
    rows = shard_documents(spark.range(4000).selectExpr("id % 400 as doc_id", "cast(id as string) as text"), shards=2, bucket_bytes=20_000).collect()
    assert len(rows) == 4000
    order = [int(r.text) for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert order != sorted(order) and abs(np.corrcoef(order, range(4000))[0, 1]) < 0.1
