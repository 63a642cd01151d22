"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata of the text.

score = sigmoid(w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j); the pairs cost linear time by the identity
2 * sum over pairs = sum over factors of (sum v_if x_i)^2 - sum (v_if x_i)^2.

Features: the lower-cased words of the whole text, hashed into WORD_BUCKETS, with x = sqrt(share of the words); and for each
statistic of the text (case, symbols, repeats, length in characters and lines, ...) the tenth of the training sample it falls into, with x = 1.
Labels, lang, source and doc_id are never inputs.

The model is learnt in one task from a bounded sample (SAMPLE labelled rows, by hash order) of labelled documents outside the held-out
fold, crc32(doc_id as text) mod 5 = 0. Scoring streams over all documents; the model of about 150 KB goes along with the function.

Null and empty texts have the features of an empty text and get a score like any other; texts may be of any length. Repeated rows give repeated results; a doc_id
that is labelled twice counts with its smaller label. Without labelled rows every score is 0.5. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reckon.llm.shared import arrow
from reckon.llm.textbytes import IS_SPACE, Chunk, chunks, column, covered, in_doc, windows

SAMPLE = 6_000
WORD_BUCKETS = 1 << 12
BINS = 10
FACTORS = 8
EPOCHS = 12
BATCH = 128
RATE = 0.05
PENALTY = 1e-4
FOLDS = 5
ACCEPT = 0.3
STATISTICS = (
    "characters", "words", "lines", "mean_word", "upper", "symbols", "digits", "punctuation", "non_ascii",
    "repeated_lines", "repeated_windows", "distinct_words", "echoed_words", "commonest_word",
)
N_FEATURES = WORD_BUCKETS + BINS * len(STATISTICS)


def _flags(characters: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters.encode())] = True
    return table


IS_SYMBOL, IS_PUNCTUATION, IS_DIGIT = _flags("#*$%&|<>@{}[]=_~^+"), _flags(".,;:!?'\"()-"), _flags("0123456789")
IS_UPPER = _flags("ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def features(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word buckets, their x, their documents) without repeats, and a row of statistics for each document."""
    low = chunk.lowered()
    starts, ends = low.words()
    doc, hashed = low.doc_of(starts), low.hashes(starts, ends)
    n_words = np.bincount(doc, minlength=chunk.n)
    key = doc * WORD_BUCKETS + (hashed % np.uint64(WORD_BUCKETS)).astype(np.int64)
    key, counts = np.unique(key, return_counts=True)
    owner, bucket = key // WORD_BUCKETS, key % WORD_BUCKETS
    x = np.sqrt(counts / n_words[owner])

    data = chunk.data
    characters = chunk.per_doc((data & 0xC0) != 0x80)
    per_character = lambda flags: chunk.per_doc(flags) / np.maximum(characters, 1)
    per_word = lambda numbers: numbers / np.maximum(n_words, 1)
    line_starts, line_ends = chunk.runs(data != 10)
    line_doc = chunk.doc_of(line_starts)
    lines = np.bincount(line_doc, minlength=chunk.n)
    _, first = np.unique(in_doc(chunk.hashes(line_starts, line_ends), line_doc), return_index=True)
    found, at = windows(hashed, doc, 8)
    _, which, times = np.unique(in_doc(found, doc[at]), return_inverse=True, return_counts=True)
    repeated = covered(at[times[which] > 1], 8, len(starts))
    whole, times = np.unique(in_doc(hashed, doc), return_index=True, return_counts=True)[1:]
    commonest = np.zeros(chunk.n)
    np.maximum.at(commonest, doc[whole], times)
    echoed = np.flatnonzero((hashed[1:] == hashed[:-1]) & (doc[1:] == doc[:-1]))
    statistics = np.column_stack(
        [
            np.log1p(characters),
            np.log1p(n_words),
            lines / np.maximum(n_words, 1),
            per_word(chunk.per_doc(~IS_SPACE[data] & ((data & 0xC0) != 0x80))),
            per_character(IS_UPPER[data]),
            per_character(IS_SYMBOL[data]),
            per_character(IS_DIGIT[data]),
            per_character(IS_PUNCTUATION[data]),
            per_character(data >= 0xC0),
            1 - np.bincount(line_doc[first], minlength=chunk.n) / np.maximum(lines, 1),
            per_word(np.bincount(doc[repeated], minlength=chunk.n)),
            per_word(np.bincount(doc[whole], minlength=chunk.n)),
            per_word(np.bincount(doc[echoed], minlength=chunk.n)),
            per_word(commonest),
        ]
    )
    return bucket, x, owner, statistics


@dataclass
class Machine:
    """edges: BINS - 1 bounds of each statistic; w0, w, v: the weights and factors."""

    edges: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def binned(self, statistics: np.ndarray) -> np.ndarray:
        """The feature that each statistic of each row switches on."""
        within = [np.searchsorted(edges, statistics[:, k], "left") for k, edges in enumerate(self.edges)]
        return WORD_BUCKETS + np.column_stack(within) + BINS * np.arange(len(self.edges))

    def rows(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(feature, x, document) of all that is not zero, by document."""
        bucket, x, owner, statistics = features(chunk)
        switched = self.binned(statistics)
        feature = np.concatenate((bucket, switched.ravel()))
        owner = np.concatenate((owner, np.repeat(np.arange(chunk.n), switched.shape[1])))
        x = np.concatenate((x, np.ones(switched.size)))
        order = np.argsort(owner, kind="stable")
        return feature[order], x[order], owner[order]

    def margin(self, feature: np.ndarray, x: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value before the sigmoid of rows that begin there, and their sums of v x."""
        vx = self.v[feature] * x[:, None]
        sums = np.add.reduceat(vx, begin)
        linear = np.add.reduceat(self.w[feature] * x, begin)
        return self.w0 + linear + 0.5 * (sums**2 - np.add.reduceat(vx**2, begin)).sum(1), sums

    def score(self, chunk: Chunk) -> np.ndarray:
        feature, x, owner = self.rows(chunk)
        margin, _ = self.margin(feature, x, np.searchsorted(owner, np.arange(chunk.n)))
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def train(words: list[tuple[np.ndarray, np.ndarray]], statistics: np.ndarray, labels: np.ndarray) -> Machine:
    """AdaGrad on the logistic loss, both classes with the same total weight, in a fixed order of batches."""
    edges = np.quantile(statistics, np.arange(1, BINS) / BINS, axis=0).T
    rng = np.random.default_rng(7)
    machine = Machine(edges, 0.0, np.zeros(N_FEATURES), rng.normal(0, 0.02, (N_FEATURES, FACTORS)))
    switched = machine.binned(statistics)
    feature = [np.concatenate((f, s)) for (f, _), s in zip(words, switched, strict=True)]
    value = [np.concatenate((x, np.ones(len(s)))) for (_, x), s in zip(words, switched, strict=True)]
    share = np.bincount(labels, minlength=2) / len(labels)
    weight = np.where(share[labels] > 0, 0.5 / np.maximum(share[labels], 1e-9), 1.0)
    g0, gw, gv = 1.0, np.ones(N_FEATURES), np.ones((N_FEATURES, FACTORS))
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for batch in np.array_split(order, max(1, len(order) // BATCH)):
            f = np.concatenate([feature[i] for i in batch])
            x = np.concatenate([value[i] for i in batch])
            sizes = np.array([len(feature[i]) for i in batch])
            begin = np.cumsum(sizes) - sizes
            margin, sums = machine.margin(f, x, begin)
            error = weight[batch] * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[batch]) / len(batch)
            each = np.repeat(error, sizes) * x
            v = machine.v[f]
            step = each[:, None] * (np.repeat(sums, sizes, axis=0) - v * x[:, None])
            used, where = np.unique(f, return_inverse=True)
            dw = np.bincount(where, weights=each) + PENALTY * machine.w[used]
            dv = np.column_stack([np.bincount(where, weights=step[:, k]) for k in range(FACTORS)]) + PENALTY * machine.v[used]
            # gradients are of a batch's mean: scaled so that the first steps have the size of RATE
            dw, dv, d0 = dw * BATCH, dv * BATCH, error.sum() * BATCH
            g0, gw[used], gv[used] = g0 + d0**2, gw[used] + dw**2, gv[used] + dv**2
            machine.w0 -= RATE * d0 / np.sqrt(g0)
            machine.w[used] -= RATE * dw / np.sqrt(gw[used])
            machine.v[used] -= RATE * dv / np.sqrt(gv[used])
    return machine


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0


def sample_ids(labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(doc_id, label) of at most `most` labelled rows outside the held-out fold, those of the lowest hashes."""
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").where(~held_out())
    return known.groupBy("doc_id").agg(F.min("quality").alias("_label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def fit(documents: DataFrame, sample: DataFrame) -> Machine:
    """The machine learnt from the sample's documents, at most SAMPLE, which one task gathers and trains on.

    Of rows that share a sampled doc_id the one whose text has the least hash is learnt, found before they meet.
    """
    sample = F.broadcast(sample.withColumnRenamed("doc_id", "_id"))  # at most SAMPLE rows
    chosen = documents.select("doc_id", "text").join(sample, F.col("doc_id") == F.col("_id"))
    one = F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("one")
    chosen = chosen.groupBy("doc_id", "_label").agg(one).select("doc_id", "one.text", "_label")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(column(batch, "text")):
                bucket, x, owner, statistics = features(chunk)
                cuts = np.searchsorted(owner, np.arange(1, chunk.n))
                yield pa.RecordBatch.from_arrays(
                    [
                        column(batch, "doc_id").slice(chunk.first, chunk.n),
                        column(batch, "_label").slice(chunk.first, chunk.n).cast(pa.int32()),
                        pa.array([a.astype(np.int32) for a in np.split(bucket, cuts)], pa.list_(pa.int32())),
                        pa.array([a.astype(np.float32) for a in np.split(x, cuts)], pa.list_(pa.float32())),
                        pa.array(list(statistics), pa.list_(pa.float64())),
                    ],
                    names=["doc_id", "label", "buckets", "xs", "statistics"],
                )

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = list(batches)
        if not frames:
            return
        frame = pd.concat(frames, ignore_index=True).sort_values("doc_id")
        if len(frame) < 2 or frame["label"].nunique() < 2:
            return
        words = [(b.astype(np.int64), x.astype(float)) for b, x in zip(frame["buckets"], frame["xs"], strict=True)]
        machine = train(words, np.stack(frame["statistics"].to_list()), frame["label"].to_numpy(np.int64))
        yield pd.DataFrame({"name": ["edges", "w0", "w", "v"], "numbers": [machine.edges.ravel(), np.array([machine.w0]), machine.w, machine.v.ravel()]})

    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, label int, buckets array<int>, xs array<float>, statistics array<double>"
    learnt = arrow(chosen, gather, schema).repartition(1).mapInPandas(learn, "name string, numbers array<double>")
    parts = {row.name: np.array(row.numbers) for row in learnt.collect()}  # one model of a fixed size
    if not parts:
        return Machine(np.zeros((len(STATISTICS), BINS - 1)), 0.0, np.zeros(N_FEATURES), np.zeros((N_FEATURES, FACTORS)))
    return Machine(parts["edges"].reshape(len(STATISTICS), BINS - 1), float(parts["w0"][0]), parts["w"], parts["v"].reshape(N_FEATURES, FACTORS))


def classify(documents: DataFrame, machine: Machine, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, score and predicted (1 if score >= ACCEPT) of every document."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*keep).schema.fields)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(column(batch, "_text")):
                score = machine.score(chunk)
                kept = [column(batch, name).slice(chunk.first, chunk.n) for name in keep]
                verdict = pa.array((score >= ACCEPT).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*kept, pa.array(score), verdict], names=[*keep, "score", "predicted"])

    return arrow(documents.select(*keep, documents["text"].alias("_text")), judge, f"{fields}, score double, predicted int")


def op10_classifier(spark: SparkSession, folder: str) -> DataFrame:
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    machine = fit(documents, sample_ids(spark.read.parquet(f"{folder}/labels.parquet")))
    return classify(documents, machine).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")
