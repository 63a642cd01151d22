"""Vectorised text helpers for Arrow batches: words, lines and hashes of many documents at once, on their UTF-8 bytes.

A batch is cut into chunks of whole documents of about CHUNK bytes, so that memory follows the chunk, not the batch. Words are
maximal runs of bytes other than space and 0x09-0x0D; as these are ASCII, runs of bytes and of characters are the same. Hashes are
64 bits: a polynomial over a random byte table, taken from prefix sums, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 19
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets, from 0; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


class Chunk:
    """Documents first to last of a batch: data, and offsets of its documents in it."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first = data, offsets, first
        self.n = len(offsets) - 1
        self._sums: np.ndarray | None = None

    @property
    def rows(self) -> slice:
        return slice(self.first, self.first + self.n)

    def lowered(self) -> Chunk:
        return Chunk(LOWER[self.data], self.offsets, self.first)

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        """The document, counted in the chunk, that holds each byte position."""
        return np.searchsorted(self.offsets, positions, "right") - 1

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sums of a value per byte over each document."""
        sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """First byte of each document that has one, and the last."""
        full = self.offsets[1:] > self.offsets[:-1]
        return self.offsets[:-1][full], self.offsets[1:][full] - 1

    def runs(self, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of maximal runs of set flags within documents."""
        begin, end = flags.copy(), flags.copy()
        begin[1:] &= ~flags[:-1]
        end[:-1] &= ~flags[1:]
        first, last = self.edges()
        begin[first], end[last] = flags[first], flags[last]
        return np.flatnonzero(begin), np.flatnonzero(end) + 1

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        return self.runs(~IS_SPACE[self.data])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the bytes from each start to each end."""
        size = 1 << max(int(len(self.data)), 1 << 16).bit_length()
        up, down = _powers(size)
        if self._sums is None:
            self._sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_TABLE[self.data] * up[: len(self.data)], out=self._sums[1:])
        value = (self._sums[ends] - self._sums[starts]) * down[starts]
        return mix(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[Chunk]:
    """Whole documents of about size bytes at a time; a longer one comes alone."""
    data, offsets = utf8(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        last = min(last, first + 65536, n)
        yield Chunk(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], first)
        first = last


def windows(values: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each run of width values of one owner, and its first index."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(owner[: n] == owner[width - 1 :])
    total = np.zeros(len(at), np.uint64)
    for k in range(width):
        total = total * _BASE + values[at + k]
        if k % 4 == 3:
            total = mix(total)
    return mix(total + np.uint64(width)), at


def in_doc(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes that differ between documents of a chunk."""
    return mix(hashes + doc.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def covered(starts: np.ndarray, width: int, size: int) -> np.ndarray:
    """Flags of the size items that a run of width items from one of the starts covers."""
    steps = np.bincount(starts, minlength=size + 1).astype(np.int64)
    steps[: size + 1] -= np.bincount(np.minimum(starts + width, size), minlength=size + 1)
    return np.cumsum(steps[:size]) > 0


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
