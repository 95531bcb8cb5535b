"""Vectorised words and word shingles of many texts at once (numpy, inside tasks).

A word is a run of bytes other than space and \\t..\\r; a shingle is five words in a
row, or all words of a text that has fewer. Hashes have 64 bits.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

SHINGLE_WORDS = 5
_CHUNK_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=None)
def constants(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


@lru_cache(maxsize=None)
def _space() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[32, *range(9, 14)]] = True
    return table


_powers = np.ones(1, dtype=np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, 0xD6E8FEB86659FD93, np.uint64)]))
    return _powers


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some texts in order, and how many each text has."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    inside = ~_space()[buf]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.concatenate([[0], np.searchsorted(starts, text_ends)]))
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    where = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    letters = constants(256, 11)[buf[inside]] * _power(int(sizes.max()))[where]
    return mix(np.add.reduceat(letters, first) + sizes.astype(np.uint64)), counts


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some texts in order, and how many each text has."""
    with np.errstate(over="ignore"):
        return _words(texts)


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts in order, and how many each text has (0 without a word)."""
    out, sizes, group, size = [], [], [], 0
    for t in [*texts, None]:
        if t is None or size > _CHUNK_BYTES:
            if group:
                hashes, counts = _shingles(group)
                out.append(hashes)
                sizes.append(counts)
            group, size = [], 0
        if t is not None:
            group.append(t)
            size += len(t) + 1
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(sizes)


def _shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        words, counts = _words(texts)
        n = SHINGLE_WORDS
        scale = constants(n, 23)
        got = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
        if not len(words):
            return np.zeros(0, np.uint64), got
        first = np.cumsum(counts) - counts
        at = np.repeat(first, got) + np.arange(int(got.sum())) - np.repeat(np.cumsum(got) - got, got)
        padded = np.concatenate([words, np.zeros(n, np.uint64)])
        left = np.repeat(first + counts, got)
        total = np.zeros(len(at), np.uint64)
        for j in range(n):
            total += np.where(at + j < left, padded[at + j], np.uint64(0)) * scale[j]
        return mix(total), got
