"""Words and word shingles of many UTF-8 texts at once, as 64-bit hashes in numpy.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Word hashes come from one polynomial
prefix sum over all bytes of a batch; a shingle's hash combines those of its words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_powers: dict[str, np.ndarray] = {}

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: close inputs give unrelated outputs."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE and its inverse to the powers 0 to n, modulo 2**64."""
    if not _powers or len(_powers["up"]) <= n:
        size = 1 << max(16, int(n).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins (with the end as last entry); null is empty."""
    texts = pa.array(texts, pa.large_string()) if not isinstance(texts, pa.Array) else texts.cast(pa.large_string())
    texts = texts.fill_null("") if texts.null_count else texts
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word, A-Z lower-cased, and for each text the index of its first word (and the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    low = _LOWER[data]
    inside = ~_SPACE[data]
    first = np.zeros(n, bool)
    first[bounds[:-1][bounds[:-1] < n]] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:]
    at, to = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    up, down = _power(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    hashes = mix((total[to] - total[at]) * down[at] + (to - at).astype(np.uint64))
    return hashes, np.searchsorted(at, bounds)


def shingles(hashes: np.ndarray, index: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of size words, and each text's first; a shorter text with words is one shingle."""
    count = np.diff(index)
    many = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    out = np.zeros(len(many) + 1, np.int64)
    np.cumsum(many, out=out[1:])
    if not out[-1]:
        return np.zeros(0, np.uint64), out
    text = np.repeat(np.arange(len(many)), many)
    at = np.arange(out[-1]) - out[:-1][text] + index[:-1][text]
    length = np.minimum(count[text], size)
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    made = length.astype(np.uint64)
    for k in range(size):
        made = mix(made * np.uint64(0xD6E8FEB86659FD93) + np.where(k < length, padded[at + k], np.uint64(0)) + np.uint64(k + 1))
    return made, out


def sequence_keys(hashes: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each text's whole word sequence, to find copies."""
    place = np.arange(len(hashes)) - np.repeat(index[:-1], np.diff(index))
    keys = []
    for seed in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB):
        each = mix(hashes ^ mix(place.astype(np.uint64) + np.uint64(seed)))
        total = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(each, out=total[1:])
        keys.append(mix(total[index[1:]] - total[index[:-1]] + np.diff(index).astype(np.uint64)).view(np.int64))
    return keys[0], keys[1]
