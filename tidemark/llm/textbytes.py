"""Texts as the bytes of an Arrow array, and hashes of the words in them, without an object for each word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of words hashed at once.
HASHED_BYTES = 1 << 18

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A fixed scrambling of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(salt) * _M[0] + _M[0]
        x = (x ^ (x >> np.uint64(30))) * _M[1]
        x = (x ^ (x >> np.uint64(27))) * _M[2]
        return x ^ (x >> np.uint64(31))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins and the last one ends; nulls have none."""
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, places, raw = texts.buffers()
    if not n or raw is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    places = np.frombuffer(places, wide)[texts.offset : texts.offset + n + 1].astype(np.int64)
    return np.frombuffer(raw, np.uint8)[places[0] : places[-1]], places - places[0]


_AT = mix(np.arange(4096, dtype=np.uint64), 3) | np.uint64(1)


def _at(first: int, last: int) -> np.ndarray:
    """The factors of a word's bytes from the place ``first`` to ``last``."""
    return _AT[first:last] if last <= len(_AT) else mix(np.arange(first, last, dtype=np.uint64), 3) | np.uint64(1)


def _long_word(data: np.ndarray, value: np.ndarray) -> np.uint64:
    total = np.uint64(0)
    with np.errstate(over="ignore"):
        for a in range(0, len(data), HASHED_BYTES):
            piece = data[a : a + HASHED_BYTES]
            total += (value[piece] * _at(a, a + len(piece))).sum(dtype=np.uint64)
    return total


def hashes(data: np.ndarray, begins: np.ndarray, value: np.ndarray) -> np.ndarray:
    """A hash of each word, from its place in ``begins`` to the next one's: the sum of its bytes' values, each
    times a factor of its place. Blanks after a word have the value 0, all other bytes another."""
    sums = np.zeros(len(begins), np.uint64)
    edges = np.append(begins, len(data))
    a = 0
    with np.errstate(over="ignore"):
        while a < len(begins):
            b = max(a + 1, int(np.searchsorted(edges, edges[a] + HASHED_BYTES, "right")) - 1)
            own = data[edges[a] : edges[b]]
            if len(own) > HASHED_BYTES:
                sums[a] = _long_word(own, value)
            else:
                gaps = np.diff(edges[a : b + 1])
                place = np.arange(len(own), dtype=np.int32) - np.repeat((edges[a:b] - edges[a]).astype(np.int32), gaps)
                sums[a:b] = np.add.reduceat(value[own] * _at(0, int(gaps.max()))[place], edges[a:b] - edges[a])
            a = b
    return mix(sums, 2)


def byte_values(inside: bytes) -> np.ndarray:
    """A value for each byte that belongs to words, the same for A-Z and a-z, and 0 for all others."""
    value = np.zeros(256, np.uint64)
    for b in inside:
        value[b] = b + (33 if 65 <= b <= 90 else 1)
    return value


def words(texts: pa.Array, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of all texts, one text after the other, and how many each has. Words are runs of bytes
    with a value, and none goes from one text into the next."""
    data, places = flat(texts)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    begins = (value != 0)[data]
    heads = places[:-1][places[:-1] < len(data)]
    at_head = begins[heads]
    begins[1:] &= ~begins[:-1].copy()
    begins[heads] = at_head
    begins = np.flatnonzero(begins)
    return hashes(data, begins, value), np.diff(np.searchsorted(begins, places))
