"""Vectorised hashing of words and word n-grams.

Words are maximal runs of bytes other than space and \\t \\n \\v \\f \\r. Hashes are the same on
every machine and in every run.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
SEGMENT = 1 << 18
#: Words of more bytes are hashed one by one: the sums below could be made to agree for words much longer.
LONG_WORD = 24
ODD = 0x9E3779B97F4A7C15
STEP = np.uint64(0xC2B2AE3D27D4EB4F)
MIX = np.uint64(0xD6E8FEB86659FD93)
HALF = np.uint64(32)

_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ODD and of its inverse modulo 2**64, at least ``n`` of them."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(19, (n - 1).bit_length())
        both = []
        for base in (ODD, pow(ODD, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps, dtype=np.uint64))
        _powers[:] = both
    return _powers[0], _powers[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits; one to one."""
    h = h ^ (h >> HALF)
    h *= MIX
    h ^= h >> HALF
    h *= MIX
    h ^= h >> HALF
    return h


def hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, first bytes and end bytes of the words of ``data``."""
    whole = np.frombuffer(data, np.uint8)
    hashes, starts, ends = [], [], []
    at = 0
    while at < len(whole):
        to = min(at + SEGMENT, len(whole))
        while to < len(whole) and not SPACE[whole[to]]:  # to the end of the word
            nearby = np.flatnonzero(SPACE[whole[to : to + 4096]])
            to = to + int(nearby[0]) if len(nearby) else min(to + 4096, len(whole))
        b = whole[at:to]
        up, down = _tables(len(b) + 1)
        edge = np.empty(len(b) + 2, np.int8)
        edge[0] = edge[-1] = 1
        edge[1:-1] = SPACE[b]
        turn = np.diff(edge)
        s, e = np.flatnonzero(turn == -1), np.flatnonzero(turn == 1)
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=sums[1:])
        h = mixed((sums[e] - sums[s]) * down[s])
        for i in np.flatnonzero(e - s > LONG_WORD).tolist():
            h[i] = xxhash.xxh3_64_intdigest(data[at + s[i] : at + e[i]])
        hashes.append(h)
        starts.append(s + at)
        ends.append(e + at)
        at = to
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends)


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` consecutive words, by its first word; empty if there are fewer.

    A polynomial in the words' hashes, put together from those of powers of two of words.
    """
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out, done, part, size = None, 0, words, 1
    while True:
        if n & size:
            out = part[:count].copy() if out is None else out * _step(size) + part[done : done + count]
            done += size
        if done == n:
            return mixed(out)
        part = part[:-size] * _step(size) + part[size:]
        size *= 2


def _step(n: int) -> np.uint64:
    return np.uint64(pow(int(STEP), n, 1 << 64))


def trim() -> None:
    """Give freed memory back to the system, Arrow's and, where it can, the C library's: workers live on between steps."""
    pa.default_memory_pool().release_unused()
    free = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if free:
        free(0)


def batches(texts: list[bytes], limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``limit`` bytes together, one text at least."""
    lo = total = 0
    for i, text in enumerate(texts):
        if i > lo and total + len(text) > limit:
            yield lo, i
            lo, total = i, 0
        total += len(text) + 1
    if lo < len(texts):
        yield lo, len(texts)


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Words of several texts at once: hashes, starts, ends, the first word of each text (with a closing entry), and the joined bytes."""
    data = b"\n".join(texts)
    h, s, e = hash_words(data)
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=first[1:])
    return h, s, e, np.searchsorted(s, first), data


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column; nulls are empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def signed(h: np.ndarray) -> pa.Array:
    """64-bit hashes as a bigint column."""
    return pa.array(np.ascontiguousarray(h).view(np.int64))
