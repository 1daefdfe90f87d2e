"""64-bit hashes of all words and word shingles of a block of texts, by array operations."""

from __future__ import annotations

import functools

import numpy as np

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


@functools.cache
def byte_values() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@functools.cache
def word_bytes() -> np.ndarray:
    """Bytes of words: letters and digits of ASCII, and all of longer encodings."""
    out = np.zeros(256, bool)
    out[[c for c in range(256) if c >= 128 or chr(c).isalnum()]] = True
    return out


@functools.lru_cache(8)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, INVERSE):
        x = np.full(1 << bits, base, np.uint64)
        x[0] = 1
        out.append(np.cumprod(x))
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over the whole (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each lower-cased word of all texts in order, and the index of each text's first word (the number of words at last)."""
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    inside = word_bytes()[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    powers, inverse = _powers(max(16, (len(data) + 1).bit_length()))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte_values()[data] * powers[: len(data)], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * inverse[starts])
    begin = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raw])))
    return hashes, np.searchsorted(starts, begin)


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each run of ``k`` words within a text, and the index of each text's first one. Texts of fewer words have none."""
    counts = np.maximum(np.diff(first) - (k - 1), 0)
    at = np.concatenate(([0], np.cumsum(counts)))
    if len(words) < k:
        return np.empty(0, np.uint64), at
    every = np.zeros(len(words) - k + 1, np.uint64)
    factor = 1
    for i in range(k):
        factor = factor * 0xD6E8FEB86659FD93 & ((1 << 64) - 1)
        every += words[i : len(words) - k + 1 + i] * np.uint64(factor)
    every = mix(every)
    keep = np.repeat(first[:-1] - at[:-1], counts) + np.arange(at[-1])
    return every[keep], at
