"""Vectorised text kernels for Arrow batches: words, hashes, shingle sets. No Spark in here.

Word and shingle hashes are 64 bits wide; sets are sorted arrays of distinct shingle hashes.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACES = bytes(c in (32, 9, 10, 11, 12, 13) for c in range(256))
_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], U64)
_STEPS = np.array([(0x9E3779B97F4A7C15 * (2 * i + 3)) & ((1 << 64) - 1) | 1 for i in range(64)], U64)
#: Bytes of text that one kernel call works on, if no single text is longer.
BLOCK = 4 << 20


def tidy(run: Callable) -> Callable:
    """A batch function that gives memory back when its partition ends: Python workers are used again and again."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()  # each task brings its functions along, in modules that refer to themselves
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):
                pass  # another C library, which keeps its own house

    return wrapped


def texts(col: pa.Array, step: int = 256) -> Iterator[str]:
    """The strings of a column, nulls as empty, a few at a time as Python objects."""
    for i in range(0, len(col), step):
        for t in col.slice(i, step).to_pylist():
            yield t or ""


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U64(30))  # a new array, which the rest changes in place
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def blocks(col: pa.Array) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows of a string column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    offs = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, 8 * col.offset) if len(col) else np.zeros(1, np.int64)
    data = memoryview(col.buffers()[2]) if len(col) and col.buffers()[2] is not None else memoryview(b"")
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + BLOCK, "right")) - 1)
        yield i, j, bytes(data[offs[i] : offs[j]]), offs[i : j + 1] - offs[i]
        i = j


def word_bounds(data: bytes, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words before each text and in all) of the words of texts that lie end to end."""
    space = np.frombuffer(data.translate(_SPACES), bool)
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    prev = np.ones(len(data), bool)
    prev[1:] = space[:-1]
    nxt = np.ones(len(data), bool)
    nxt[:-1] = space[1:]
    starts = np.flatnonzero(~space & (prev | edge[:-1]))
    ends = np.flatnonzero(~space & (nxt | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word, eight bytes at a time; the few very long words are hashed one by one."""
    padded = data + b"\0" * 8
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = ends - starts
    h = mix(size.astype(U64) + U64(0x51ED270B7F4A7C15))
    h = mix(h ^ (eight[starts] & _MASKS[np.minimum(size, 8)]))  # most words end here
    todo = np.flatnonzero((size > 8) & (size <= 64))
    k = 1
    while len(todo):
        left = size[todo] - 8 * k
        h[todo] = mix(h[todo] ^ (eight[starts[todo] + 8 * k] & _MASKS[np.minimum(left, 8)]))
        k += 1
        todo = todo[left > 8]
    for i in np.flatnonzero(size > 64):
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return h


def shingle_sets(data: bytes, offs: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles of ``size`` words (all its words, if fewer)."""
    starts, ends, first = word_bounds(data, offs)
    h = word_hashes(data, starts, ends)
    n = len(h)
    s = np.zeros(max(n - size + 1, 0), U64)
    for i in range(size):
        s += h[i : n - size + 1 + i] * _STEPS[i]
    s = mix(s)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            x = s[a : b - size + 1].copy()  # a copy, as sets outlive their block
            x.sort()
            new = x[1:] != x[:-1]
            out.append(x if new.all() else x[np.concatenate([[True], new])])
        elif b > a:
            out.append(mix(np.array([(h[a:b] * _STEPS[: b - a]).sum(dtype=U64)], U64) ^ U64(b - a)))
        else:
            out.append(np.zeros(0, U64))
    return out


def set_digest(s: np.ndarray) -> bytes:
    """16 bytes that name a set."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def prefix_length(n: int, num: int = 3, den: int = 4) -> int:
    """Tokens of a set of n, in an order common to all sets, of which a set with a Jaccard of num/den shares one."""
    return n - -(-num * n // den) + 1


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of runs of equal values in a sorted array."""
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.flatnonzero(x[1:] != x[:-1]) + 1
    return np.concatenate([[0], cut]), np.concatenate([cut, [len(x)]])
