"""Word shingles of whole texts as sorted 64-bit hashes, computed column-wise on Arrow batches.

Words are maximal runs of other than space and \\t..\\r; A-Z are lower-cased. A set holds the distinct windows of `k`
words, or the whole sequence where there are fewer words, or nothing without words. Two shingles get one hash with
probability 2^-64 for a pair; a set's digest is a 128-bit digest of its sorted hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_RANDOM = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**64 - 1, size=256 + 64, dtype=np.uint64)
_BYTES, _PLACES = _RANDOM[:256], _RANDOM[256:] | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _stir(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word in data (bytes of several texts, cut at bounds), and how many words each text has."""
    n = len(data)
    solid = ~_SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[bounds] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:n]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(bounds) - 1, np.int64)
    at = np.flatnonzero(solid)
    lengths = np.diff(np.append(np.searchsorted(at, starts), len(at)))
    place = np.arange(len(at)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    powers = np.ones(int(lengths.max()), dtype=np.uint64)
    powers[1:] = _BASE
    powers = np.multiply.accumulate(powers)
    terms = _BYTES[_LOWER[data[at]]] * powers[place]
    sums = np.add.reduceat(terms, np.cumsum(lengths) - lengths)
    words = _stir(sums + lengths.astype(np.uint64) * _PLACES[-1])
    return words, np.diff(np.searchsorted(starts, bounds))


def sets_of(texts: pa.Array, k: int = 5, most_bytes: int = 1 << 20) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a few texts at a time are expanded to columns."""
    texts = texts.cast(pa.large_string()) if texts.type != pa.large_string() else texts
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most_bytes, "right")) - 1)
        bounds = offsets[i : j + 1]
        words, counts = word_hashes(data[bounds[0] : bounds[-1]], bounds - bounds[0])
        rolled = np.zeros(max(0, len(words) - k + 1), dtype=np.uint64)
        for p in range(k):
            rolled += words[p : p + len(rolled)] * _PLACES[p]
        rolled = _stir(rolled)
        at = 0
        for c in counts.tolist():
            if c >= k:
                yield np.unique(rolled[at : at + c - k + 1])
            elif c:
                whole = (words[at : at + c] * _PLACES[8 : 8 + c]).sum(dtype=np.uint64, keepdims=True)
                yield _stir(whole + np.uint64(c))
            else:
                yield np.zeros(0, np.uint64)
            at += c
        i = j


def digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def lists(values: list[np.ndarray]) -> pa.Array:
    """Arrow list<int64> of the hashes, which keep their order as unsigned numbers within each list."""
    ends = np.cumsum([0, *map(len, values)])
    flat = np.concatenate(values) if values else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.view(np.int64)))
