"""Vectorised words, shingles and hashes over Arrow string columns.

Words are runs of bytes other than 0x20 and 0x09-0x0D. These bytes never occur inside a longer UTF-8 sequence,
so all work is on the column's own byte buffer and no Python string is made.
Hashes have 64 bits; equal sequences always have equal hashes.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE_LOWER = _BYTE[LOWER]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = _rng.integers(1, 1 << 63, 512, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= 2 * SLICE_BYTES:  # a longer text has a table of its own, which goes with it
            _powers[int(base)] = have
    return have[:n]


Batches = Iterable[pa.RecordBatch]


def tidy(run: Callable[[Batches], Iterator[pa.RecordBatch]]) -> Callable[[Batches], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` that gives freed memory back to the machine at a task's end: workers outlive tasks, and several share an executor's memory."""

    def tidied(batches: Batches) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch with about ``limit`` bytes of text; a longer text comes alone and whole."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


@dataclass
class Words:
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    """Index of each row's first word, and at the end the number of words."""

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, lower: bool = False) -> np.ndarray:
        n = len(self.data)
        values = (_BYTE_LOWER if lower else _BYTE)[self.data]
        values *= _power(_BASE, n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(values, out=total[1:])
        h = (total[self.ends] - total[self.starts]) * _power(_BASE_INVERSE, n + 1)[self.starts]
        return mix(h + (self.ends - self.starts).astype(np.uint64))

    def whole(self, n: int) -> np.ndarray:
        """For each word: do ``n`` words of the same row begin with it?"""
        left = np.repeat(self.first[1:], self.counts) - np.arange(self.first[-1])
        return left >= n


def words(column: pa.Array, space: np.ndarray = SPACE, prepare=None) -> Words:
    """``space``: which bytes part words. ``prepare``: changes bytes first, one for one."""
    data, offsets = utf8(column)
    if prepare is not None and len(data):
        data = prepare(data)
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(offsets), np.int64))
    space = space[data]
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    before[offsets[:-1][offsets[:-1] < len(data)]] = True
    ends_at = offsets[1:][offsets[1:] > 0] - 1
    after[ends_at] = True
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each position on; the last ``n - 1`` positions of the array have none."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - n + 1] * _STEP[0]
    for i in range(1, n):
        out += h[i : len(h) - n + 1 + i] * _STEP[i]
    return mix(out + np.uint64(n))


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """As ``ngrams``, with a cost that doesn't grow with ``n``."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _power(_BASE, len(h)), out=total[1:])
    return mix((total[n:] - total[:m]) * _power(_BASE_INVERSE, m) + np.uint64(n))


def shingle_sets(column: pa.Array, size: int = 5, lower: bool = True) -> Iterator[np.ndarray]:
    """Each row's sorted distinct shingle hashes; a shorter sequence of words is one shingle, no word gives none."""
    w = words(column)
    h = w.hashes(lower)
    g = ngrams(h, size)
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= size:
            yield np.unique(g[a : b - size + 1])
        elif b > a:
            yield ngrams(h[a:b], b - a)
        else:
            yield np.zeros(0, np.uint64)
