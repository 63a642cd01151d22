"""Byte-level BPE by merge replay.

Each task gathers the distinct pre-tokens of its documents and replays the merges over all of them at once: an inverted index maps
a pair's rank to every position that holds the pair, ranks are taken in order, and a merge only looks at its two neighbours again.
Documents are then put together from their pre-tokens by one gather. There is no shuffle; memory is a chunk of text plus a bounded
cache of pre-tokens. Pre-tokens are found by 64-bit hashes, and every encoding is proven by decoding it: should two pre-tokens ever
share a hash, the document differs and is encoded again word by word.

Null and empty texts have no ids. The text may be of any length up to what a task can hold (about 60 bytes of memory a byte).
Repeated rows give repeated results. Columns other than those kept and the text are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from reckon.llm.shared import arrow
from reckon.llm.textbytes import Chunk, chunks, column

RANKS = "byte_bpe_multi_50k.tiktoken"
CACHED_WORDS = 300_000
TEXT_AT_ONCE = 1_000_000
NEVER = 1 << 40
OTHER, LETTER, NUMBER, WHITE = range(4)
# The characters with the property White_Space.
WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    table[WHITE_SPACE] = WHITE
    return table


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


@lru_cache(maxsize=2)
def _vocabulary(path: str) -> tuple[np.ndarray, np.ndarray]:
    """All tokens' bytes by id, concatenated, and their offsets."""
    ranks = load_ranks(path)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum([0, *map(len, tokens)])


def pre_tokens(chunk: Chunk) -> np.ndarray:
    """Byte positions at which public_tokenizers.PATTERN begins a match, over all documents of the chunk."""
    data = chunk.data
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.int32)
    code = lead.copy()
    for least, tail, bits in ((0xC0, 1, 0x1F), (0xE0, 2, 0x0F), (0xF0, 3, 0x07)):
        wide = np.flatnonzero((lead >= least) & (lead < (least | least >> 1 | 0x80) + (least == 0xF0) * 256))
        value = lead[wide] & bits
        for k in range(1, tail + 1):
            value = value << 6 | (data[at[wide] + k] & 0x3F)
        code[wide] = value
    kind = _classes()[code]
    n = len(at)
    first = np.zeros(n + 1, bool)  # first character of a document; one more as the end
    first[np.searchsorted(at, chunk.offsets)] = True
    same = np.zeros(n + 1, bool)  # goes on with the class of the character before, in the same document
    same[1:n] = (kind[1:] == kind[:-1]) & ~first[1:n]
    begins = ~same[:n]
    white, blank = kind == WHITE, code == 0x20
    after_blank = np.zeros(n, bool)
    after_blank[1:] = blank[:-1]
    begins &= white | first[:n] | ~after_blank
    begins |= white & ~same[1:] & ~first[1:]  # the last of white space before a word stands alone or joins the word
    apostrophe = np.flatnonzero(begins & (code == 0x27))
    if len(apostrophe):
        padded = np.concatenate((code, [0, 0, 0]))
        one, two = padded[apostrophe + 1], padded[apostrophe + 2]
        inside = ~first[np.minimum(apostrophe + 1, n)]
        short = inside & np.isin(one, [ord(c) for c in "stmd"])
        pairs = [(ord(a), ord(b)) for a, b in ("re", "ve", "ll")]
        long = inside & ~first[np.minimum(apostrophe + 2, n)] & np.logical_or.reduce([(one == a) & (two == b) for a, b in pairs])
        for which, width in ((short, 2), (long, 3)):
            here = apostrophe[which]
            begins[here + 1] = False
            after = here + width
            begins[after[after < n]] = True
    return at[begins]


@lru_cache(maxsize=2)
def _pairs(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Every pair of ids whose bytes make up a token, as left << 32 | right, sorted, and the rank of that token."""
    ranks = load_ranks(path)
    found = {
        ranks[token[:k]] << 32 | ranks[token[k:]]: rank
        for token, rank in ranks.items()
        for k in range(1, len(token))
        if token[:k] in ranks and token[k:] in ranks
    }
    keys = np.fromiter(found.keys(), np.int64, len(found))
    order = np.argsort(keys)
    return np.append(keys[order], np.int64(1) << 62), np.append(np.fromiter(found.values(), np.int64, len(found))[order], NEVER)


def _pair_ranks(path: str, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    keys, ranks = _pairs(path)
    wanted = left << 32 | right
    at = np.searchsorted(keys, wanted)
    return np.where(keys[at] == wanted, ranks[at], NEVER)


def replay(words: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, joined, and the offsets of each word in them. All merges of all words are applied in rank order through an index from pair rank to positions.

    Words that are tokens are taken whole. The merges of a rank are applied at once, the leftmost of an overlapping run first. A merge
    that brings up a pair of lower rank than its own must let that pair go first: such a word is done again by itself.
    """
    ranks = load_ranks(path)
    byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
    whole = [ranks.get(word, -1) for word in words]
    todo = [k for k, rank in enumerate(whole) if rank < 0 and words[k]]
    raw = np.frombuffer(b"".join(words[k] for k in todo), np.uint8)
    ends = np.cumsum([len(words[k]) for k in todo], dtype=np.int64)
    size = len(raw)
    token = byte_ids[raw]
    right, left = np.arange(1, size + 1), np.arange(-1, size - 1)
    right[ends - 1] = -1
    left[np.concatenate(([0], ends[:-1])) if size else ends] = -1
    pair = np.full(size, NEVER)  # rank of the pair that begins here
    inner = np.flatnonzero(right >= 0)
    pair[inner] = _pair_ranks(path, token[inner], token[inner + 1])
    alive = np.ones(size, bool)
    index: dict[int, list[np.ndarray]] = {}

    def enter(places: np.ndarray) -> None:
        order = np.argsort(pair[places], kind="stable")
        places = places[order]
        found = pair[places]
        cuts = np.flatnonzero(found[1:] != found[:-1]) + 1
        for rank, own in zip(found[np.concatenate(([0], cuts))].tolist(), np.split(places, cuts), strict=True):
            if rank not in index:
                index[rank] = []
                heapq.heappush(heap, rank)
            index[rank].append(own)

    heap: list[int] = []
    odd = []
    if len(first := inner[pair[inner] < NEVER]):
        enter(first)
    while heap:
        rank = heapq.heappop(heap)
        lists = index.pop(rank)
        places = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        places = places[pair[places] == rank]
        if not len(places):
            continue
        overlap = np.zeros(len(places), bool)
        overlap[1:] = right[places[:-1]] == places[1:]
        if overlap.any():  # of a run, every second one
            head = np.flatnonzero(~overlap)
            place_in_run = np.arange(len(places)) - head[np.cumsum(~overlap) - 1]
            places = places[place_in_run % 2 == 0]
        gone = right[places]
        after = right[gone]
        token[places], right[places], pair[gone], alive[gone] = rank, after, NEVER, False
        left[after[after >= 0]] = places[after >= 0]
        before = left[places]
        changed = np.unique(np.concatenate((places, before[before >= 0])))
        follow = right[changed]
        pair[changed] = np.where(follow >= 0, _pair_ranks(path, token[changed], token[follow]), NEVER)
        lower = changed[pair[changed] < rank]
        if len(lower):
            odd.append(np.searchsorted(ends, lower, "right"))
            changed = changed[pair[changed] >= rank]
        if len(changed := changed[pair[changed] < NEVER]):
            enter(changed)
    redo = {todo[int(n)]: _one_by_one(words[todo[int(n)]], ranks) for places in odd for n in np.unique(places)}
    kept = np.flatnonzero(alive)
    counts = np.array([rank >= 0 for rank in whole], np.int64)
    counts[todo] = np.diff(np.searchsorted(kept, np.concatenate(([0], ends))))
    offsets = np.concatenate(([0], np.cumsum(counts)))
    ids = np.empty(offsets[-1], np.int64)
    direct = np.ones(len(words), bool)
    direct[todo] = False
    from_replay = np.repeat(~direct, counts)
    ids[from_replay] = token[kept]
    ids[~from_replay] = np.array([rank for rank in whole if rank >= 0], np.int64)
    if redo:
        lists = [redo.get(k, ids[offsets[k] : offsets[k + 1]]) for k in range(len(words))]
        return np.concatenate(lists), np.cumsum([0, *map(len, lists)])
    return ids, offsets


def _one_by_one(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The merges of one word, always the lowest rank first and of equal ones the leftmost."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        rank, i = min((ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank == NEVER:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[part] for part in parts]


def _gather(flat: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces flat[offsets[w]:offsets[w + 1]] for each w of which, joined, and their lengths."""
    sizes = offsets[which + 1] - offsets[which]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(offsets[which] - (ends - sizes), sizes) + np.arange(total)], sizes


class Encoder:
    """Encodes chunks; keeps the ids of the pre-tokens it has met, up to CACHED_WORDS."""

    def __init__(self, path: str):
        self.path, self.ranks = path, load_ranks(path)
        self.tokens, self.token_offsets = _vocabulary(path)
        self.known: dict[int, bytes] = {}

    def encode(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the chunk and the offsets of its documents in them."""
        starts = pre_tokens(chunk)
        ends = np.append(starts[1:], len(chunk.data)) if len(starts) else starts
        codes, distinct = pd.factorize(chunk.hashes(starts, ends))
        keys = distinct.tolist()
        if len(self.known) > CACHED_WORDS:
            self.known = {}
        fresh = [k for k, key in enumerate(keys) if key not in self.known]
        if fresh:
            where = np.zeros(len(keys), np.int64)
            where[codes[::-1]] = np.arange(len(codes))[::-1]
            raw = chunk.data.tobytes()
            words = [raw[starts[i] : ends[i]] for i in where[fresh]]
            ids, bounds = replay(words, self.path)
            packed, bounds = ids.astype("<u4").tobytes(), (4 * bounds).tolist()
            self.known.update((keys[k], packed[bounds[n] : bounds[n + 1]]) for n, k in enumerate(fresh))
        pieces = [self.known[key] for key in keys]
        flat = np.frombuffer(b"".join(pieces), "<u4")
        offsets = np.cumsum([0, *map(len, pieces)]) // 4
        ids, sizes = _gather(flat, offsets, codes)
        return ids, np.concatenate(([0], np.cumsum(sizes)))[np.searchsorted(starts, chunk.offsets)]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return _gather(self.tokens, self.token_offsets, ids.astype(np.int64))[0]

    def documents(self, chunk: Chunk) -> Iterator[tuple[np.ndarray, bytes]]:
        """(ids, decoded bytes) of each document, proven by the round trip."""
        ids, offsets = self.encode(chunk)
        decoded = self.decode(ids)
        ends = self.token_offsets[1:] - self.token_offsets[:-1]
        bounds = np.concatenate(([0], np.cumsum(ends[ids.astype(np.int64)])))[offsets]
        sound = np.array_equal(bounds, chunk.offsets) and np.array_equal(decoded, chunk.data)
        for k in range(chunk.n):
            text = decoded[bounds[k] : bounds[k + 1]]
            own = ids[offsets[k] : offsets[k + 1]]
            if not sound and not np.array_equal(text, chunk.data[chunk.offsets[k] : chunk.offsets[k + 1]]):
                own = self._alone(chunk.data[chunk.offsets[k] : chunk.offsets[k + 1]])
                text = self.decode(own)
            yield own, text.tobytes()

    def _alone(self, data: np.ndarray) -> np.ndarray:
        one = Chunk(data, np.array([0, len(data)]), 0)
        starts = pre_tokens(one)
        raw = data.tobytes()
        words = [raw[a:b] for a, b in zip(starts, [*starts[1:], len(raw)], strict=True)]
        return replay(words, self.path)[0].astype("<u4")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(
    documents: DataFrame, path: str | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = True
) -> DataFrame:
    """The kept columns, n_tokens, ids_sha256 and decoded_sha256 of every document, and with ids the ids themselves.

    ids_sha256 is over the ids as little-endian unsigned 32-bit integers, decoded_sha256 over the bytes decoded from them.
    """
    path = path or public_tokenizers.path(RANKS)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*keep).schema.fields)
    schema = f"{fields}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for chunk in chunks(column(batch, "_text"), TEXT_AT_ONCE):
                n, of_ids, of_text, lists = [], [], [], []
                for found, decoded in own.documents(chunk):
                    n.append(len(found))
                    of_ids.append(hashlib.sha256(found.astype("<u4").tobytes()).hexdigest())
                    of_text.append(hashlib.sha256(decoded).hexdigest())
                    lists.append(found)
                kept = [column(batch, name).slice(chunk.first, chunk.n) for name in keep]
                names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256"]
                columns = [*kept, pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
                if ids:
                    flat = np.concatenate([*lists, np.zeros(0, "<u4")]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), pa.array(flat)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return arrow(documents.select(*keep, documents[text].alias("_text")), run, schema)


def decode(encoded: DataFrame, path: str | None = None, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and the text of ids; null ids give null, bytes that are no UTF-8 become U+FFFD."""
    path = path or public_tokenizers.path(RANKS)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*keep).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            texts = [
                None if v is None else own.decode(np.array(v, np.int64)).tobytes().decode("utf-8", "replace")
                for v in column(batch, "_ids").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*(column(batch, k) for k in keep), pa.array(texts, pa.string())], names=[*keep, "text"])

    return arrow(encoded.select(*keep, encoded[ids].alias("_ids")), run, f"{fields}, text string")


def op2_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return encode(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"), ids=False)
