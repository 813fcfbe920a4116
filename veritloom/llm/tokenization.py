"""Whole-text encoding with a `tokenizers` vocabulary, memoised by chunk.

The library spends most of its time on offsets and on words it has met before.
Where a pre-tokenizer never matches across white space, the ids of a text are
the ids of its white-space chunks one after another, so every distinct chunk is
given to the library once and its ids are kept.  Chunks are looked up by hash
and then compared, so those that share a hash keep ids of their own.  Texts with characters outside
a plain range (for which normalisation could look beyond a chunk) go to the
library whole.
"""

from __future__ import annotations

import os
import re

import numpy as np

from .hashing import LONG, MASKS, find_words, hash_words, lanes

# Spark runs one worker a core already.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Chunks a worker keeps before it starts anew.
CACHE_CHUNKS = 1_500_000
#: Bytes of such chunks, and ids of them.
CACHE_BYTES = 1 << 26
_U = np.uint64
#: Characters a text may have to be split into chunks: none of them composes
#: with a neighbour, folds by context, or is white space to only one library.
_UNUSUAL = re.compile("[^\t\n\r\x20-\x7e¡-¬®-įı-ɏ‐-‧‰-⁞€]")
#: Punctuation at a chunk's end is a match of its own when letters precede it.
_ENDING = ".,;:!?*&%$#|"
#: Stands between chunks; outside the plain range, so no chunk holds it.
_MARK = "\U0001f602"


class ChunkEncoder:
    """Encodes lists of texts to little-endian ids of ``dtype`` ('<u2' or '<u4')."""

    def __init__(self, path: str, capacity: int = CACHE_CHUNKS):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.dtype = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        self.capacity = capacity
        self.words = _WordTable(self.dtype)
        self.mark = self._ids(_MARK)
        self.bare, self.ends = self._bare(path)
        self.by_chunk = self._splits_on_space() and len(self.mark) == 1

    def _ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _splits_on_space(self) -> bool:
        """White space has to be dropped, and case folded by the library."""
        return self._ids("Ab cd") == self._ids("ab") + self._ids("cd") and self._ids(" ab\n\tcd ") == self._ids("ab cd")

    def _bare(self, path: str):
        """The library without its normaliser and pattern, for lower-case words, and which ids end a word.

        (None, None) where ids do not tell, or where it would give other ids.
        """
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        vocabulary = self.library.get_vocab()
        ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        bare = Tokenizer.from_file(path)
        bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        bare.normalizer = normalizers.Sequence([])
        words = ["ab", "thing", "über", "çà", "ñandú"]
        found = bare.encode(words, is_pretokenized=True, add_special_tokens=False).ids
        same = found == [i for w in words for i in self._ids(w)] and int(ends[found].sum()) == len(words)
        return (bare, ends) if same else (None, None)

    def _encode_words(self, words: list[str], out: dict[str, np.ndarray]) -> None:
        """Lower-case words of letters only."""
        step = 1024
        for k, found in enumerate(self.bare.encode_batch_fast([words[i : i + step] for i in range(0, len(words), step)], is_pretokenized=True, add_special_tokens=False)):
            ids, begin = np.array(found.ids, dtype=self.dtype), 0
            for word, last in zip(words[k * step : (k + 1) * step], np.flatnonzero(self.ends[ids]).tolist(), strict=True):
                out[word] = ids[begin : last + 1]
                begin = last + 1

    def _encode_chunks(self, chunks: list[str], out: dict[str, np.ndarray]) -> None:
        step = 512
        joined = [f" {_MARK} ".join(chunks[i : i + step]) for i in range(0, len(chunks), step)]
        for k, found in enumerate(self.library.encode_batch_fast(joined, add_special_tokens=False)):
            ids, begin = np.array(found.ids, dtype=self.dtype), 0
            ends = np.flatnonzero(ids == self.mark[0]).tolist() + [len(ids)]
            for chunk, end in zip(chunks[k * step : (k + 1) * step], ends, strict=True):
                out[chunk] = ids[begin:end]
                begin = end + 1

    def _ids_of(self, chunks: list[str]) -> list[np.ndarray]:
        """The ids of some chunks, from the library."""
        parts = {}
        for chunk in chunks:
            word = chunk.rstrip(_ENDING)
            if len(word) < len(chunk) and word.isalpha():
                parts[chunk] = word, chunk[len(word) :]
        units = set(chunks).difference(parts).union(*parts.values())
        plain = [u for u in units if u.isalpha()] if self.bare else []
        known: dict[str, np.ndarray] = {}
        if plain:
            self._encode_words(plain, known)
        self._encode_chunks(list(units.difference(plain)), known)
        return [known[c] if c not in parts else np.concatenate([known[p] for p in parts[c]]) for c in chunks]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text (None: empty) without special tokens."""
        out: list[bytes] = [b""] * len(texts)
        plain, size = [], 0
        for i, text in enumerate(texts):
            if not text:
                continue
            if not self.by_chunk or _UNUSUAL.search(text):
                out[i] = np.array(self._ids(text), dtype=self.dtype).tobytes()
                continue
            plain.append(i)
            size += len(text)
            if size > 1_000_000:
                self._encode_plain(texts, plain, out)
                plain, size = [], 0
        if plain:
            self._encode_plain(texts, plain, out)
        return out

    def _encode_plain(self, texts: list[str | None], at: list[int], out: list[bytes]) -> None:
        parts = [texts[i].lower().encode() for i in at]
        ends = np.cumsum([len(p) + 1 for p in parts])
        text = b" ".join(parts)
        raw, starts, stops = find_words(text)
        hashes = hash_words(raw, starts, stops)
        if self.words.full(self.capacity):
            self.words = _WordTable(self.dtype)
        found = self.words.find(hashes)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new, first = np.unique(hashes[missing], return_index=True)
            first = missing[first]
            words = [text[a:b] for a, b in zip(starts[first].tolist(), stops[first].tolist(), strict=True)]
            self.words.add(new, words, self._ids_of([w.decode() for w in words]))
            found[missing] = self.words.find(hashes[missing])
        other = np.flatnonzero(~self.words.same(found, raw, starts, stops))
        if len(other):  # their hash is that of another chunk
            words = [text[a:b] for a, b in zip(starts[other].tolist(), stops[other].tolist(), strict=True)]
            distinct = list(dict.fromkeys(words))
            number = dict(zip(distinct, self.words.append(distinct, self._ids_of([w.decode() for w in distinct])).tolist(), strict=True))
            found[other] = [number[w] for w in words]
        sizes, ids = self.words.gather(found)
        upto = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(starts, ends)]
        begin = 0
        for i, end in zip(at, upto.tolist(), strict=True):
            out[i] = ids[begin:end].tobytes()
            begin = end


class _WordTable:
    """Ids by word hash: open addressing in flat arrays, looked up for many words at once."""

    def __init__(self, dtype: str):
        self.count = 0
        self.keys = np.zeros(1 << 16, np.uint64)
        self.slots = np.full(1 << 16, -1, np.int32)
        self.hashes = np.empty(1 << 15, np.uint64)
        self.offsets = np.zeros((1 << 15) + 1, np.int64)
        self.ids = np.empty(1 << 17, dtype)
        self.places = np.zeros((1 << 15) + 1, np.int64)
        self.text = np.zeros(1 << 18, np.uint8)
        self.findable = np.empty(0, np.int32)

    def full(self, capacity: int) -> bool:
        return self.count > capacity or max(self.places[self.count], self.offsets[self.count]) > CACHE_BYTES

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, -1 where it is new."""
        mask = len(self.keys) - 1
        spot = (hashes & _U(mask)).astype(np.int64)
        out = self.slots[spot]
        at = np.flatnonzero((out >= 0) & (self.keys[spot] != hashes))
        spot = spot[at]
        while len(at):
            spot = (spot + 1) & mask
            number = self.slots[spot]
            done = (number < 0) | (self.keys[spot] == hashes[at])
            out[at[done]] = number[done]
            at, spot = at[~done], spot[~done]
        return out

    def _place(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        mask = len(self.keys) - 1
        spot = (hashes & _U(mask)).astype(np.int64)
        while len(hashes):
            free = self.slots[spot] < 0
            self.slots[spot[free]] = numbers[free]  # the last of equal spots stays
            won = free & (self.slots[spot] == numbers)
            self.keys[spot[won]] = hashes[won]
            hashes, numbers, spot = hashes[~won], numbers[~won], (spot[~won] + 1) & mask

    def same(self, numbers: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether each word of a buffer is the very word of that number."""
        left, begin = ends - starts, self.places[numbers]
        out = self.places[numbers + 1] - begin == left
        yours = lanes(raw)
        mine = np.ndarray((len(self.text) - 7,), "<u8", self.text, strides=(1,))
        out &= (yours[starts] ^ mine[begin]) & MASKS[np.minimum(left, 8)] == 0
        at, done = np.flatnonzero(out & (left > 8) & (left <= LONG)), 8
        while len(at):
            good = (yours[starts[at] + done] ^ mine[begin[at] + done]) & MASKS[np.minimum(left[at] - done, 8)] == 0
            out[at] = good
            done += 8
            at = at[good & (left[at] > done)]
        for k in np.flatnonzero(out & (left > LONG)).tolist():
            out[k] = np.array_equal(raw[starts[k] : ends[k]], self.text[begin[k] : begin[k] + left[k]])
        return out

    def append(self, words: list[bytes], ids: list[np.ndarray]) -> np.ndarray:
        """Keep words with their ids, not to be found by hash; their numbers."""
        n = len(words)
        while len(self.hashes) < self.count + n:
            self.hashes = np.concatenate([self.hashes, np.empty_like(self.hashes)])
            self.offsets = np.concatenate([self.offsets, np.zeros(len(self.offsets) - 1, np.int64)])
            self.places = np.concatenate([self.places, np.zeros(len(self.places) - 1, np.int64)])
        upto = slice(self.count + 1, self.count + n + 1)
        begin, first = int(self.offsets[self.count]), int(self.places[self.count])
        self.offsets[upto] = begin + np.cumsum([len(i) for i in ids], dtype=np.int64)
        self.places[upto] = first + np.cumsum([len(w) for w in words], dtype=np.int64)
        flat, text = np.concatenate(ids), np.frombuffer(b"".join(words), np.uint8)
        while len(self.ids) < begin + len(flat):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while len(self.text) < first + len(text) + 8:
            self.text = np.concatenate([self.text, np.zeros_like(self.text)])
        self.ids[begin : begin + len(flat)] = flat
        self.text[first : first + len(text)] = text
        self.hashes[self.count : self.count + n] = 0
        self.count += n
        return np.arange(self.count - n, self.count, dtype=np.int32)

    def add(self, hashes: np.ndarray, words: list[bytes], ids: list[np.ndarray]) -> None:
        """Words (of distinct and new hashes) with their ids."""
        numbers = self.append(words, ids)
        self.hashes[numbers] = hashes
        self.findable = np.concatenate([self.findable, numbers])
        if 2 * len(self.findable) > len(self.keys):
            size = len(self.keys)
            while 2 * len(self.findable) > size:
                size *= 2
            self.keys, self.slots = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
            numbers = self.findable
        self._place(self.hashes[numbers], numbers)

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(how many ids each word has, the ids of all words one after another)."""
        begin = self.offsets[numbers]
        sizes = self.offsets[numbers + 1] - begin
        upto = np.cumsum(sizes)
        return sizes, self.ids[np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat(begin - upto + sizes, sizes)]


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder per worker process and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def forget(path: str) -> None:
    """Drop the encoder of a vocabulary file with the chunks it knows."""
    _ENCODERS.pop(path, None)
