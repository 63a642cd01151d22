"""Groups of spelling variants: words one edit apart, by asymmetric q-chunks, and the frequent form that each word follows.

1. Words are counted in the tasks (distinct ones of a piece of text at a time), then over the corpus.
2. Of two words one edit apart the longer one (of equal ones the smaller) is cut into two disjoint chunks of half its length; the edit
   leaves one of them whole, at the front or, shifted by one at most, at the end of the other word. So the longer word contributes its two chunks and the other
   one its positional grams of that length within shift one: those at its ends, as the longer word's length fixes the shift.
3. What a shared chunk leaves over differs by one edit again and is cut in the same way until at most REST characters are
   left, or LEVELS times. A key so holds most of both words, and its group does not grow with the corpus: of words of up to
   REST * 2 ** LEVELS characters it has at most as many members as there are strings of REST characters.
4. Pairs that meet in a key are verified by edit distance. Roots are found by pointer jumping: a form is at least RATIO times as frequent as its
   word, so chains have logarithmic length.

Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, of which A-Z are lower-cased. Null and empty texts have none; a text or a run may
have any length; repeated rows count again; a null doc_id counts as an empty one. Only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reckon.llm.shared import arrow, written
from reckon.llm.textbytes import Chunk, chunks, column, in_doc

LEAST_POINTS = 6
LEAST_COUNT = 5
RATIO = 5
SPOILT = 199
REST = 3
LEVELS = 4
WORDS_AT_ONCE = 200_000
STEPS = 48  # bytes of a run that are taken for all runs at once


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """zlib's crc32 of the bytes from each start to each end, continued from the crc32 of what comes before."""
    size = ends - starts
    order = np.argsort(size)[::-1]
    rising = size[order[::-1]]
    state = ~before[order].astype(np.uint32)
    first = starts[order]
    for k in range(min(int(size.max(initial=0)), STEPS)):
        active = len(size) - int(np.searchsorted(rising, k, "right"))
        part = state[:active]
        state[:active] = _CRC[(part ^ data[first[:active] + k]) & 255] ^ (part >> np.uint32(8))
    out = np.empty(len(size), np.uint32)
    out[order] = ~state
    for k in np.flatnonzero(size > STEPS):
        out[k] = zlib.crc32(data[starts[k] : ends[k]].tobytes(), int(before[k]))
    return out


def _count(chunk: Chunk, ids: list[str], spoilt: int | None, least: int, held: dict[bytes, int]) -> None:
    low = chunk.lowered()
    data = low.data
    lead = data == 0xC3
    letter = ((data >= 97) & (data <= 122)) | lead
    letter[1:] |= lead[:-1]
    starts, ends = low.runs(letter)
    more = np.concatenate(([0], np.cumsum((data & 0xC0) == 0x80)))
    long = ends - starts - (more[ends] - more[starts]) >= least
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return
    doc, hashes = low.doc_of(starts), low.hashes(starts, ends)
    raw = data.tobytes()
    if spoilt:
        _, first, n = np.unique(in_doc(hashes, doc), return_index=True, return_counts=True)
        starts, ends, hashes = starts[first], ends[first], hashes[first]
        before = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
        crc = crc32(data, starts, ends, before[doc[first]])
        hit = crc % np.uint32(spoilt) == 0
        for k in np.flatnonzero(hit):
            run = raw[starts[k] : ends[k]].decode()
            at = int(crc[k]) % len(run)
            if len(run) > least:
                word = (run[:at] + run[at + 1 :]).encode()
                held[word] = held.get(word, 0) + int(n[k])
        starts, ends, hashes, n = starts[~hit], ends[~hit], hashes[~hit], n[~hit]
    else:
        n = np.ones(len(starts), np.int64)
    _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
    total = np.bincount(group, weights=n, minlength=len(first)).astype(np.int64)
    for a, b, k in zip(starts[first].tolist(), ends[first].tolist(), total.tolist(), strict=True):
        word = raw[a:b]
        held[word] = held.get(word, 0) + k


def counted(documents: DataFrame, spoilt: int | None = None, least: int = LEAST_POINTS) -> DataFrame:
    """word, n: the words of at least `least` code points and their occurrences in all documents.

    With spoilt a run whose crc32 (of `<doc_id>:<run>`) it divides loses the code point at that crc32 modulo its length: made-up errors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def flush() -> pa.RecordBatch:
            columns = [pa.array(held.keys(), pa.binary()).cast(pa.string()), pa.array(held.values(), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["word", "n"])

        for batch in batches:
            ids = column(batch, "id").to_pylist()
            for chunk in chunks(column(batch, "text")):
                _count(chunk, ids[chunk.rows], spoilt, least, held)
                if len(held) > WORDS_AT_ONCE:
                    yield flush()
                    held.clear()
        if held:
            yield flush()

    named = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text")
    return arrow(named, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _cut(rows: DataFrame) -> DataFrame:
    """One level: each row with a rest of more than REST characters becomes two, one for each chunk that an edit may leave whole.

    size is the rest's length in the longer word, which both words go by; lo and hi bound the rest in the own word.
    """
    side = F.col("side")
    half = F.expr("size div 2")
    chunk = F.when(side == 0, F.col("word").substr(F.col("lo") + 1, half)).otherwise(F.col("word").substr(F.col("hi") - half + 1, half))
    cut = side >= 0
    rows = rows.withColumn("side", F.explode(F.when(F.col("size") > REST, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(-1)))))
    return rows.select(
        "word",
        "n",
        "shorter",
        F.when(cut, F.xxhash64("key", "size", "side", chunk)).otherwise(F.col("key")).alias("key"),
        F.when(side == 0, F.col("lo") + half).otherwise(F.col("lo")).alias("lo"),
        F.when(side == 1, F.col("hi") - half).otherwise(F.col("hi")).alias("hi"),
        F.when(cut, F.col("size") - half).otherwise(F.col("size")).alias("size"),
    )


def _keyed(words: DataFrame, shorter: Column) -> DataFrame:
    """key, word, n, shorter: the keys of every word; shorter, an array, has by how much the word is shorter than its partner."""
    length = F.length("word")
    rows = words.select("word", "n", F.explode(shorter).alias("shorter"))
    size = length + F.col("shorter")
    rows = rows.withColumns({"key": size.cast("long"), "lo": F.lit(0), "hi": length, "size": size})
    for _ in range(LEVELS):
        rows = _cut(rows)
    return rows.select("key", "word", "n", "shorter")


def near_words(words: DataFrame) -> DataFrame:
    """a, a_n, b, b_n: every pair of words (word, n) that are exactly one inserted, deleted or replaced code point apart, once."""
    chunked = _keyed(words, F.array(F.lit(0))).select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    grams = _keyed(words, F.array(F.lit(0), F.lit(1))).select("key", F.col("word").alias("b"), F.col("n").alias("b_n"), "shorter")
    met = chunked.join(grams, "key").where("shorter = 1 OR a < b").where(F.levenshtein("a", "b", 1) == 1)
    return met.groupBy("a", "b").agg(F.first("a_n").alias("a_n"), F.first("b_n").alias("b_n"))


def roots(forms: DataFrame, most_rounds: int = 64) -> DataFrame:
    """word, root: the last word that following forms (word, form) leads to; no word is its own form, directly or by others."""
    found = written(forms.select("word", F.col("form").alias("root")))
    for _ in range(most_rounds):
        step = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ahead = written(found.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        found = ahead.select("word", "root")
        if ahead.where("moved").isEmpty():
            return found
    raise RuntimeError("forms lead round in a ring")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word (word, n).

    The form is the near word of largest n, of equal ones the smallest in code-point order, if that n is at least ratio times the
    word's, else null; the root is what forms lead to, the word itself if it has none.
    """
    pairs = written(near_words(words))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n"))
    both = both.union(pairs.select("b", "a", "a_n"))
    of_word = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    chosen = words.join(of_word, "word", "left")
    follows = -F.col("best.less") >= ratio * F.col("n")
    chosen = written(
        chosen.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(follows, F.col("best.near")).alias("form"),
            F.when(follows, -F.col("best.less")).alias("form_n"),
        )
    )
    last = roots(chosen.where("form IS NOT NULL"))
    chosen = chosen.join(last, "word", "left")
    return chosen.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, folder: str) -> DataFrame:
    words = counted(spark.read.parquet(f"{folder}/documents.parquet"), SPOILT)
    return variants(written(words.where(F.col("n") >= LEAST_COUNT)))
