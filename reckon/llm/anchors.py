"""Anchored segments of texts: where two texts share a string of LENGTH bytes, both anchor it at the same place.

Every window of LENGTH bytes is anchored at the least hashed gram of GRAM bytes in it, the leftmost of equal ones; that depends on the
window's bytes alone. Neighbouring windows of one anchor make a segment: a run of windows that starts `offset` bytes before the anchor.
Equal windows have equal anchors at equal offsets, so only segments of the same gram need to be compared.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from reckon.llm.textbytes import Chunk, mix

LENGTH = 400
GRAM = 200


@dataclass
class Segments:
    """doc: in the chunk; start, end: bytes in the chunk; offset: of the anchor from the start; gram, segment: hashes."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    offset: np.ndarray
    gram: np.ndarray
    segment: np.ndarray


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of width values: of the end of one block and the beginning of the next."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    table = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def segments(chunk: Chunk, length: int = LENGTH, gram: int = GRAM) -> Segments:
    """All segments of the chunk's documents, in order."""
    size = len(chunk.data)
    none = np.zeros(0, np.int64)
    if size < length:
        return Segments(none, none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    begin = np.arange(size - gram + 1)
    hashed = chunk.hashes(begin, begin + gram)
    bits = np.uint64(size.bit_length())
    anchor = _least((hashed >> bits << bits) | begin.astype(np.uint64), length - gram + 1)
    anchor = (anchor & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    sizes = chunk.offsets[1:] - chunk.offsets[:-1]
    room = np.zeros(size + 1, np.int64)  # a window that starts here ends within its document
    long = np.flatnonzero(sizes >= length)
    np.add.at(room, chunk.offsets[long], 1)
    np.add.at(room, chunk.offsets[long + 1] - length + 1, -1)
    windows = np.flatnonzero(np.cumsum(room)[: len(anchor)] > 0)
    if not len(windows):
        return Segments(none, none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    own = anchor[windows]
    first = np.ones(len(windows), bool)
    first[1:] = (own[1:] != own[:-1]) | (windows[1:] != windows[:-1] + 1)
    first = np.flatnonzero(first)
    last = np.append(first[1:], len(windows)) - 1
    start, end, at = windows[first], windows[last] + length, own[first]
    found = hashed[at]
    named = mix(chunk.hashes(start, end) ^ mix(found + (at - start).astype(np.uint64)))
    return Segments(chunk.doc_of(start), start, end, at - start, found, named)
