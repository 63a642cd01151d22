"""Shingle sets of documents and their parity sketches, vectorised over chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from reckon.llm.textbytes import Chunk, mix, windows

WORDS = 5
SMALL = 64  # sets below this size get so many blocks that nearly every shingle has its own
SMALL_BLOCKS = 1 << 16
LOAD = 1.5  # most shingles a block, on average
KEY_BITS = np.uint64(0xFFFFFFFFFFFF0000)  # of a key, 48: keys that agree by chance are tested like others, and less is shuffled
OVER, UNDER = 100, 75  # similar: OVER * intersection >= UNDER * union


def shingle_sets(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of A-Z-lower-cased words, as hashes, sorted by document and hash; and their documents."""
    low = chunk.lowered()
    starts, ends = low.words()
    doc, words = low.doc_of(starts), low.hashes(starts, ends)
    found, at = windows(words, doc, WORDS)
    owner = doc[at]
    n_words = np.bincount(doc, minlength=chunk.n)
    few = np.flatnonzero((n_words > 0) & (n_words < WORDS))
    if len(few):  # the whole sequence is the only shingle
        first = np.searchsorted(doc, few)
        total = np.zeros(len(few), np.uint64)
        for k in range(WORDS - 1):
            has = n_words[few] > k
            total[has] = mix(total[has] + words[first[has] + k])
        found = np.concatenate((found, mix(total + n_words[few].astype(np.uint64))))
        owner = np.concatenate((owner, few))
    order = sorted_by(owner, found)
    found, owner = found[order], owner[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    return found[new], owner[new]


def sorted_by(*columns: np.ndarray) -> np.ndarray:
    """Order by the columns, the first one foremost; all but the last are below 65536, which sorts in linear time."""
    order = np.argsort(columns[-1])
    for small in columns[-2::-1]:
        order = order[np.argsort(small[order].astype(np.uint16), kind="stable")]
    return order


def digests(found: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size of each set and two 64-bit digests of it."""
    size = np.bincount(owner, minlength=n)
    begin = np.concatenate(([0], np.cumsum(size)))
    one = np.concatenate(([np.uint64(0)], np.cumsum(mix(found))))
    two = np.concatenate(([np.uint64(0)], np.cumsum(mix(found ^ np.uint64(0x5851F42D4C957F2D)))))
    sums = [mix(s[begin[1:]] - s[begin[:-1]] + size.astype(np.uint64)) for s in (one, two)]
    return size, *sums


def handles(one: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A digest of each set whose last byte is the size: floor(8 * log2(size))."""
    code = np.minimum(np.floor(8 * np.log2(np.maximum(size, 1))), 255).astype(np.uint64)
    return one & np.uint64(0xFFFFFFFFFFFFFF00) | code


def sizes_allow(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Flags of the pairs of handles whose sizes may be within OVER / UNDER, which is 3.32 of the steps of the last byte."""
    return np.abs((a & 255) - (b & 255)) <= 4


def band(size: np.ndarray) -> np.ndarray:
    """floor(log2(size)) of sizes from 1."""
    return np.frexp(size.astype(float))[1] - 1


def blocks_of(bands: np.ndarray, load: float = LOAD) -> np.ndarray:
    """Number of blocks of the sketches that are compared in a band."""
    blocks = np.maximum(np.exp2(bands + 1) // load, 1).astype(np.int64)
    return np.where(np.exp2(bands + 1) <= SMALL, min(SMALL_BLOCKS, int(SMALL_BLOCKS * LOAD / load)), blocks)


def _spaces(found: np.ndarray, owner: np.ndarray, size: np.ndarray, load: float) -> Iterator[tuple[np.ndarray, ...]]:
    """For the own band of every set, then for the next band where a set can have larger partners: the non-empty blocks' keys, their
    documents, the documents that take part, and the most shingles d that a partner can differ by."""
    own = band(np.maximum(size, 1))
    for guest in (0, 1):
        bands = own + guest
        top = np.exp2(bands + 1).astype(np.int64) - 1
        most = np.minimum(size * OVER // UNDER, top)
        joins = (size > 0) & (most >= np.exp2(bands).astype(np.int64))
        differ = (size + most) * (OVER - UNDER) // (OVER + UNDER)
        here = joins[owner]
        s, o = found[here], owner[here]
        k = blocks_of(bands, load)[o].astype(np.uint64)
        block = (s >> np.uint64(32)) * k >> np.uint64(32)  # grows with s, so equal blocks lie together
        begin = np.ones(len(s), bool)
        begin[1:] = (block[1:] != block[:-1]) | (o[1:] != o[:-1])
        begin = np.flatnonzero(begin)
        word = np.bitwise_xor.reduceat(mix(s), begin) if len(s) else s
        o, block = o[begin], block[begin]
        place = mix(block + (bands[o].astype(np.uint64) << np.uint64(40)))
        yield mix(word ^ place) & KEY_BITS, o, joins, differ


def unsure(found: np.ndarray, owner: np.ndarray, size: np.ndarray, load: float = LOAD) -> np.ndarray:
    """Flags of the documents with too few non-empty blocks to be sure to share one with every partner."""
    short = np.zeros(len(size), bool)
    for _, o, joins, differ in _spaces(found, owner, size, load):
        short |= joins & (np.bincount(o, minlength=len(size)) <= differ)
    return short


def keys(
    found: np.ndarray, owner: np.ndarray, size: np.ndarray, hot: np.ndarray, heat: np.ndarray, whole: bool = False, load: float = LOAD
) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the sets' blocks and their documents; sets of size 0 are left out.

    In each band where a set can have partners its shingles are dealt to blocks by hash and XORed: a sketch in which the number of
    differing blocks is at most the symmetric difference. Partners differ by d = (a + b) / 7 shingles at most, so of the non-empty
    blocks, in any common order, the first d + 1 of both hold an equal one. The order is by frequency: keys in hot (sorted, with
    heat) come after all others. With whole, all keys come out.
    """
    out_keys, out_docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for key, o, _, differ in _spaces(found, owner, size, load):
        if not whole and len(key):
            at = np.minimum(np.searchsorted(hot, key), max(len(hot) - 1, 0))
            warm = np.where(hot[at] == key, heat[at], 0) if len(hot) else np.zeros(len(key), np.int64)
            order = sorted_by(o, np.minimum(warm, 65535), key)
            counts = np.bincount(o, minlength=len(size))
            rank = np.arange(len(order)) - (np.cumsum(counts) - counts)[o[order]]
            order = order[rank <= differ[o[order]]]
            key, o = key[order], o[order]
        out_keys.append(key)
        out_docs.append(o)
    return np.concatenate(out_keys), np.concatenate(out_docs)


def odd_sketch(found: np.ndarray, owner: np.ndarray, size: np.ndarray) -> list[bytes]:
    """A bit string for each set, of one to two bits a shingle; every shingle flips one bit."""
    bits = np.exp2(np.maximum(band(np.maximum(size, 1)), 4) + 1).astype(np.int64)
    begin = np.concatenate(([0], np.cumsum(bits)))
    flat = np.bincount(begin[owner] + (found.astype(np.int64) & (bits[owner] - 1)), minlength=begin[-1]).astype(np.uint8) & 1
    packed = np.packbits(flat, bitorder="little").tobytes()
    return [packed[a // 8 : b // 8] for a, b in zip(begin[:-1], begin[1:], strict=True)]


def fold(sketches: np.ndarray, width: int) -> np.ndarray:
    """Sketches, one a row, folded to width bytes: those of the same sets with fewer bits."""
    while sketches.shape[1] > width:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def probable(sketches: list[bytes], size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Flags of the pairs (a, b) of sets that sizes and odd sketches allow to be similar.

    The Hamming distance of two odd sketches, the longer folded to the shorter, is never above the symmetric difference.
    """
    most, least = np.maximum(size[a], size[b]), np.minimum(size[a], size[b])
    good = OVER * least >= UNDER * most
    width = np.array([len(s) for s in sketches])
    swap = width[a] < width[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    row = np.zeros(len(sketches), np.int64)
    tables = {}
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        row[own] = np.arange(len(own))
        tables[w] = np.frombuffer(b"".join(sketches[i] for i in own), np.uint8).reshape(len(own), w)
    for w in tables:
        for narrow in tables:
            todo = np.flatnonzero(good & (width[a] == w) & (width[b] == narrow))
            if len(todo):
                folded = fold(tables[w], narrow)
                for part in np.array_split(todo, 1 + len(todo) * narrow // (16 << 20)):
                    apart = np.bitwise_count(folded[row[a[part]]] ^ tables[narrow][row[b[part]]]).sum(1, dtype=np.int64)
                    good[part] = apart * (OVER + UNDER) <= (size[a[part]] + size[b[part]]) * (OVER - UNDER)
    return good
