"""64-bit hashes of words and word shingles, by numpy over whole batches of bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .langid import utf8

_rng = np.random.default_rng(20_240_601)
BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
BYTE[65:91] = BYTE[97:123]  # A to Z count as a to z
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
BASE = 0x9E3779B97F4A7C15
CHUNK = 1 << 20

_powers = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse modulo 2**64, raised to 0 .. n-1."""
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, pow(BASE, -1, 2**64))):
            factors = np.full(n, base, np.uint64)
            factors[0] = 1
            _powers[k] = np.cumprod(factors, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_chunk(data: np.ndarray) -> np.ndarray:
    space = np.concatenate([[True], SPACE[data], [True]])
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = powers(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[data] * up, dtype=np.uint64)])
    return mix((sums[ends] - sums[starts]) * down[starts])


def word_hashes(data: np.ndarray) -> np.ndarray:
    """One hash for each word of a text's bytes, in order; long texts go in chunks cut at spaces."""
    parts, a = [], 0
    while a < len(data):
        b = min(len(data), a + CHUNK)
        if b < len(data):
            gaps = np.flatnonzero(SPACE[data[a:b]])
            if len(gaps):
                b = a + int(gaps[-1]) + 1
            else:
                ahead = np.flatnonzero(SPACE[data[b:]])
                b = b + int(ahead[0]) if len(ahead) else len(data)
        parts.append(_hash_chunk(data[a:b]))
        a = b
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """The distinct hashes of all runs of `width` words, ascending; with fewer words, of the whole sequence."""
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    total = np.full(n, width, np.uint64)
    for k in range(width):
        total = mix(total * np.uint64(BASE) + words[k : k + n])
    return np.unique(total)


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    flat, lengths = utf8(texts)
    ends = np.cumsum(lengths)
    for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True):
        yield shingle_set(word_hashes(flat[a:b]), width)
