"""64-bit hashes of words, by NumPy over whole buffers of text."""

from __future__ import annotations

import numpy as np

#: Longer words go to a library's hash one by one.
LONG = 64
_U = np.uint64
_LANE, _SIZE = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)
#: The bytes of a lane of eight that belong to a word with so many left.
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``x`` (a bijection)."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def find_words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, starts, ends) of the words of a text: runs of bytes other than ASCII white space."""
    raw = np.frombuffer(text, np.uint8)
    gap = np.ones(len(raw) + 2, dtype=bool)
    gap[1:-1] = _SPACE[raw]
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    return raw, edges[::2], edges[1::2]


def lanes(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from every place of a buffer on, as an unsigned integer (zeros beyond its end)."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    return np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))


def hash_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word; equal words have equal hashes wherever they stand.

    Eight bytes at a time go through a mixing bijection that also takes the
    state so far, so words that differ in one lane only never meet; words of
    more than LONG bytes are hashed by xxh3.  Unequal words meet by chance
    alone, with probability 2**-64 a pair; callers that need words told apart
    for certain compare them.
    """
    if not len(starts):
        return np.empty(0, np.uint64)
    view = lanes(raw)
    left = ends - starts
    out = mix((left.astype(np.uint64) * _SIZE) ^ (view[starts] & MASKS[np.minimum(left, 8)]))
    at = np.flatnonzero((left > 8) & (left <= LONG))
    done = 8
    while len(at):
        out[at] = mix((out[at] * _LANE) ^ (view[starts[at] + done] & MASKS[np.minimum(left[at] - done, 8)]))
        done += 8
        at = at[left[at] > done]
    long = np.flatnonzero(left > LONG)
    if len(long):
        import xxhash

        out[long] = [xxhash.xxh3_64_intdigest(raw[a:b].tobytes()) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    return out


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words of a text, in order."""
    return hash_words(*find_words(text))
