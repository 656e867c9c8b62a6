"""Sets of hashed word shingles of whole texts, computed for many texts at once in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from corpusflow.llm.common import utf8

WORDS = 5


def splitmix(n: int, seed: int) -> np.ndarray:
    """``n`` well mixed 64-bit numbers."""
    with np.errstate(over="ignore"):
        z = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


_PLACES = splitmix(1 << 16, 11) | np.uint64(1)
_STEPS = splitmix(64, 29) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lower-cased and cut at ASCII white space, and n+1 offsets of the texts' words."""
    raw, at = utf8(column)
    inside = np.flatnonzero(~_SPACE[raw])
    if not len(inside):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    fresh = np.zeros(len(raw) + 1, dtype=bool)
    fresh[at] = True  # a text's first byte starts a word
    start = np.empty(len(inside), dtype=bool)
    start[0], start[1:] = True, (np.diff(inside) > 1) | fresh[inside[1:]]
    first = np.flatnonzero(start)
    length = np.diff(np.append(first, len(inside)))
    place = np.arange(len(inside)) - np.repeat(first, length)
    with np.errstate(over="ignore"):
        value = (_LOWER[raw[inside]].astype(np.uint64) + np.uint64(1)) * _PLACES[place & 0xFFFF]
        if length.max() > 0x10000:
            value *= (2 * (place >> 16) + 1).astype(np.uint64)
        words = mixed(np.add.reduceat(value, first))
    return words, np.searchsorted(inside[first], at)


def shingle_sets(column: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's ``words``-word shingles; of a shorter text its words as one; none without words."""
    hashed, at = word_hashes(column)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(hashed) - words + 1), dtype=np.uint64)
        for k in range(words):
            rolled += hashed[k : k + len(rolled)] * _STEPS[k]
        rolled = mixed(rolled + np.uint64(words))
        out = []
        for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if j - i >= words:
                out.append(np.unique(rolled[i : j - words + 1]))
            elif j > i:
                out.append(mixed((hashed[i:j] * _STEPS[: j - i]).sum(keepdims=True) + np.uint64(j - i)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out
