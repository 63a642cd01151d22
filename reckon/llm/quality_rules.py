"""Quality rules: counted rules on words and lines, then a hashed n-gram log-likelihood ratio.

Words and pairs of neighbouring words are hashed into BUCKETS buckets, as many for every corpus. Their counts over a trusted target and over
the raw corpus make two multinomials; a document's ratio is the sum of log(target / raw) over its n-grams divided by their number, so
long and short texts compare. Its own n-grams are taken out of the counts that judge it, so no trusted document vouches for itself. Every document is
judged against one fixed threshold: no draw, no quantile, no dependence on the other documents' verdicts.

The raw counts cover all documents, the target all trusted ones; tasks add them up, one row a bucket. Which documents are trusted is told by two
bitmaps of a fixed size: one of the trusted ids, one of the other ids that the first lets through. Only documents that both let through are
joined; the texts of all others are not shuffled.

Null and empty texts have no words, fail the base rules and score 0. Repeated rows give repeated results. Without any trusted document
the target equals the raw corpus and every score is 0. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reckon.llm.shared import arrow, bitmap, in_bitmap
from reckon.llm.textbytes import IS_SPACE, Chunk, chunks, column, covered, in_doc, mix, windows

BUCKETS = 1 << 18
FILTER_BITS = 25
THRESHOLD = -0.15
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
REPEAT_WIDTH = 8
SMOOTHING = 1.0
IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(b"#*$%&|<>")] = True


def base_counts(chunk: Chunk) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each document."""
    starts, ends = chunk.words()
    doc = chunk.doc_of(starts)
    in_word = ~IS_SPACE[chunk.data]
    line_starts, line_ends = chunk.runs(chunk.data != 10)
    words_before = np.concatenate(([0], np.cumsum(in_word)))
    has_word = words_before[line_ends] > words_before[line_starts]
    line_starts, line_ends = line_starts[has_word], line_ends[has_word]
    line_doc = chunk.doc_of(line_starts)
    _, first = np.unique(in_doc(chunk.hashes(line_starts, line_ends), line_doc), return_index=True)
    found, at = windows(chunk.hashes(starts, ends), doc, REPEAT_WIDTH)
    _, which, counts = np.unique(in_doc(found, doc[at]), return_inverse=True, return_counts=True)
    repeated = covered(at[counts[which] > 1], REPEAT_WIDTH, len(starts))
    count = lambda of: np.bincount(of, minlength=chunk.n)
    return {
        "n_words": count(doc),
        "word_chars": chunk.per_doc(in_word & ((chunk.data & 0xC0) != 0x80)),
        "n_symbols": chunk.per_doc(IS_SYMBOL[chunk.data]),
        "n_dup_lines": count(line_doc) - count(line_doc[first]),
        "n_repeat_words": count(doc[repeated]),
    }


def ngrams(chunk: Chunk, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and pairs of words, and their documents."""
    starts, ends = chunk.words()
    doc, words = chunk.doc_of(starts), chunk.hashes(starts, ends)
    pairs, at = windows(words, doc, 2)
    hashed = np.concatenate((mix(words), pairs))
    return (hashed % np.uint64(buckets)).astype(np.int64), np.concatenate((doc, doc[at]))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of all rows of quality 1."""
    return labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()


def gram_counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """How many n-grams of all texts fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for chunk in chunks(column(batch, "text")):
                total += np.bincount(ngrams(chunk, buckets)[0], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    rows = arrow(texts.select("text"), count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)  # one row a bucket at most
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def told_apart(documents: DataFrame, trusted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, text, trusted of all documents, in two parts: those that the bitmaps decide, and the others, joined with the trusted ids."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    ids = trusted.select(F.col("doc_id").cast(kind)).where("doc_id IS NOT NULL").distinct()  # equal ids have equal hashes only in one type
    one, two = F.xxhash64("doc_id"), F.xxhash64(F.lit(1), "doc_id")
    inside = bitmap(ids.select(one), FILTER_BITS)

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = in_bitmap(inside, column(batch, "one").to_numpy())
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id").filter(pa.array(hit))], names=["doc_id"])

    named = documents.where("doc_id IS NOT NULL").select("doc_id", one.alias("one"))
    outside = bitmap(arrow(named, passed, f"doc_id {kind}").join(ids, "doc_id", "left_anti").select(two), FILTER_BITS)
    rows = documents.select("doc_id", "text", one.alias("one"), two.alias("two"), F.col("doc_id").isNotNull().alias("named"))

    def part(sure: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = in_bitmap(inside, column(batch, "one").to_numpy()) & column(batch, "named").to_numpy(zero_copy_only=False)
                doubt = hit & in_bitmap(outside, column(batch, "two").to_numpy())
                wanted = pa.array(doubt != sure)
                columns = [column(batch, "doc_id"), column(batch, "text"), pa.array(hit & ~doubt)]
                yield pa.RecordBatch.from_arrays([c.filter(wanted) for c in columns], names=["doc_id", "text", "trusted"])

        return arrow(rows, run, f"doc_id {kind}, text string, trusted boolean")

    joined = part(False).drop("trusted").join(ids.withColumn("trusted", F.lit(True)), "doc_id", "left")
    return part(True), joined.withColumn("trusted", F.coalesce("trusted", F.lit(False)))


@dataclass
class Counts:
    """How many n-grams of all and of the trusted documents fall into each bucket."""

    raw: np.ndarray
    target: np.ndarray

    def ratios(self, found: np.ndarray, own: np.ndarray, in_target: np.ndarray, n: np.ndarray) -> np.ndarray:
        """log(target / raw) of buckets without `own` n-grams of a document that has n, which is in the target or not."""
        if not self.target.any():
            return np.zeros(len(found))
        out_of_target, n_out = np.where(in_target, own, 0), np.where(in_target, n, 0)
        smooth = SMOOTHING * len(self.raw)
        target = (self.target[found] - out_of_target + SMOOTHING) / (self.target.sum() - n_out + smooth)
        return np.log(target) - np.log((self.raw[found] - own + SMOOTHING) / (self.raw.sum() - n + smooth))


def fit(documents: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> Counts:
    """The counts of all documents and of the trusted ones."""
    told, joined = told_apart(documents, trusted.select("doc_id"))
    return Counts(gram_counts(documents, buckets), gram_counts(told.unionByName(joined).where("trusted"), buckets))


def score(documents: DataFrame, trusted: DataFrame, counts: Counts, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the base counts, base_failed, score (mean log ratio of the n-grams) and kept, for every document."""
    buckets = len(counts.raw)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = column(batch, "trusted").to_numpy(zero_copy_only=False)
            for chunk in chunks(column(batch, "text")):
                base = base_counts(chunk)
                found, doc = ngrams(chunk, buckets)
                number = np.bincount(doc, minlength=chunk.n)
                pairs, own = np.unique(doc * buckets + found, return_counts=True)
                doc, found = pairs // buckets, pairs % buckets
                ratios = counts.ratios(found, own, flags[chunk.rows][doc], number[doc])
                mean = np.bincount(doc, weights=own * ratios, minlength=chunk.n) / np.maximum(number, 1)
                words = base["n_words"]
                failed = (words < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEATED_PERCENT * words)
                yield pa.RecordBatch.from_arrays(
                    [
                        column(batch, "doc_id").slice(chunk.first, chunk.n),
                        *(pa.array(v, pa.int64()) for v in base.values()),
                        pa.array(failed),
                        pa.array(mean),
                        pa.array(~failed & (mean >= threshold)),
                    ],
                    names=["doc_id", *base, "base_failed", "score", "kept"],
                )

    kind = documents.schema["doc_id"].dataType.simpleString()
    names = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    schema = f"doc_id {kind}, {names}, base_failed boolean, score double, kept boolean"
    told, joined = told_apart(documents, trusted.select("doc_id"))
    return arrow(told, judge, schema).unionByName(arrow(joined, judge, schema))


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    trusted = trusted_ids(spark.read.parquet(f"{folder}/labels.parquet"))
    return score(documents, trusted, fit(documents, trusted))
