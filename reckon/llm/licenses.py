"""Licence scan by a positional index of rare words.

1. Phrases and notices (fixed values below) are sequences of words. A first pass counts in how many documents each of their words stands;
   that gives the words' IDF in the corpus.
2. The index has postings (word -> template, position in it) of the rarest words of each template only. In a file the
   postings of the indexed words are intersected by relative position: an exact phrase needs its two rarest words at their distance, a notice two of
   its rare words within SLACK words of theirs. A notice that keeps COVER of its words keeps at least two of the indexed ones,
   so the corpus decides how much is looked at, never what is found.
3. What meets is verified: phrases word by word; notices by their mandatory key phrases (the first fixes the place, the others stand within
   SLACK words of theirs) and by the share of their words that stand within SLACK words of their place, which is the score.

Words are maximal runs of digits, small letters (A-Z count as small) and characters from U+0080, numbered from 0. Null and empty
texts have none and no labels. Texts may have any length; repeated rows give repeated results. Columns but the text are passed on unread.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reckon.llm.shared import arrow
from reckon.llm.textbytes import Chunk, chunks, column

SLACK = 8
COVER = 0.8
PHRASE_SCORE = 0.5  # of a document with base phrases, but without a whole notice

# Base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Notices, (label, words, mandatory key phrases).
NOTICES = (
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    (
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
        "you may obtain a copy of the license at",
        ("apache license version 2 0", "except in compliance with the license"),
    ),
    ("mit", "released under the mit license", ("mit license",)),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
        "the software to deal in the software without restriction including without limitation the rights to use copy modify merge "
        "publish distribute sublicense and or sell copies of the software",
        ("hereby granted free of charge", "without restriction"),
    ),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
        "published by the free software foundation",
        ("gnu general public license", "free software foundation"),
    ),
    (
        "lgpl",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license "
        "as published by the free software foundation",
        ("gnu lesser general public license", "free software foundation"),
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
        "conditions are met",
        ("source and binary forms", "provided that the following conditions"),
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        ("with or without fee",),
    ),
    (
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        ("mozilla public license",),
    ),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
)


def words_of(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and documents of the words of a chunk, and the index of each document's first word."""
    low = chunk.lowered()
    data = low.data
    starts, ends = low.runs(((data >= 48) & (data <= 57)) | ((data >= 97) & (data <= 122)) | (data >= 128))
    doc = low.doc_of(starts)
    return low.hashes(starts, ends), doc, np.searchsorted(doc, np.arange(chunk.n))


def _hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return words_of(Chunk(data, np.array([0, len(data)]), 0))[0]


@dataclass
class Notice:
    label: str
    words: np.ndarray
    keys: list[tuple[int, int]]  # (number of the phrase, its place in the words)
    rare: np.ndarray  # positions of the indexed words


class Index:
    """Phrases and notices under their rarest words; frequency: documents that hold a word, by its hash."""

    def __init__(
        self,
        phrases: dict[str, str] = PHRASES,
        notices: tuple[tuple[str, str, tuple[str, ...]], ...] = NOTICES,
        frequency: dict[int, int] | None = None,
        n_documents: int = 0,
        slack: int = SLACK,
        cover: float = COVER,
    ):
        self.slack, self.cover = slack, cover
        self.base = list(phrases.values())
        self.phrases = [_hashes(p) for p in phrases]
        self.notices: list[Notice] = []
        idf = lambda h: math.log((1 + n_documents) / (1 + (frequency or {}).get(int(h), 0)))
        numbers: dict[str, int] = {p: k for k, p in enumerate(phrases)}
        for label, text, keys in notices:
            own = []
            for key in keys:
                if key not in numbers:
                    numbers[key] = len(self.phrases)
                    self.phrases.append(_hashes(key))
                at = f" {text} ".index(f" {key} ")
                own.append((numbers[key], text[:at].count(" ")))
            hashes = _hashes(text)
            # of so many positions at least two are kept by any text that covers the notice
            n_rare = min(len(hashes), int((1 - cover) * len(hashes) + 1e-9) + 2)
            rare = sorted(range(len(hashes)), key=lambda q, h=hashes: (-idf(h[q]), q))[:n_rare]
            self.notices.append(Notice(label, hashes, own, np.array(sorted(rare))))
        self.anchors = []  # of each phrase: positions of its rarest words, the rarest first
        for hashes in self.phrases:
            self.anchors.append(sorted(range(len(hashes)), key=lambda q, h=hashes: (-idf(h[q]), q)))
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.phrases, *(n.words for n in self.notices)]))

    def licence_words(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the words of the vocabulary and their numbers in it, by number, then position."""
        if not len(self.vocabulary):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        number = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        at = np.flatnonzero(self.vocabulary[number] == words)
        order = np.argsort(number[at], kind="stable")
        return at[order], number[at][order]

    def scan(self, words: np.ndarray, doc: np.ndarray, first: np.ndarray) -> Iterator[tuple[str, bool, np.ndarray, np.ndarray, np.ndarray]]:
        """(label, base, first words, last words, shares) of the places of all base phrases and notices; positions count in the chunk."""
        at, number = self.licence_words(words)
        bounds = np.searchsorted(number, np.arange(len(self.vocabulary) + 1))
        places = lambda h: at[bounds[k := np.searchsorted(self.vocabulary, h)] : bounds[k + 1]]
        found = [self._phrase(p, a, words, doc, places) for p, a in zip(self.phrases, self.anchors, strict=True)]
        for k, label in enumerate(self.base):
            if len(found[k]):
                yield label, True, found[k], found[k] + len(self.phrases[k]) - 1, np.ones(len(found[k]))
        bound = np.append(first, len(words))
        for notice in self.notices:
            phrase, before = notice.keys[0]
            if len(own := found[phrase]):
                own = own[self._met(notice, own - before, doc[own], doc, places)]
                for other, q in notice.keys[1:]:
                    a, b = self._around(found[other], own - before + q, bound[doc[own]], bound[doc[own] + 1])
                    own = own[b > a]
                if not len(own):
                    continue
                low, high = bound[doc[own]], bound[doc[own] + 1]  # words of the same document
                kept, lowest, highest = np.zeros(len(own), np.int64), own.copy(), own + len(self.phrases[phrase]) - 1
                for q, word in enumerate(notice.words):
                    stands = places(word)
                    a, b = self._around(stands, own - before + q, low, high)
                    hit = b > a
                    kept += hit
                    if hit.any():
                        lowest[hit] = np.minimum(lowest[hit], stands[a[hit]])
                        highest[hit] = np.maximum(highest[hit], stands[b[hit] - 1])
                whole = kept >= self.cover * len(notice.words) - 1e-9
                if whole.any():
                    yield notice.label, False, lowest[whole], highest[whole], kept[whole] / len(notice.words)

    def _around(self, stands: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of sorted positions the range within SLACK words of each place, from low and below high."""
        a = np.searchsorted(stands, np.maximum(place - self.slack, low))
        return a, np.searchsorted(stands, np.minimum(place + self.slack + 1, high))

    def _phrase(self, phrase: np.ndarray, anchors: list[int], words: np.ndarray, doc: np.ndarray, places) -> np.ndarray:
        """Starts of a phrase: the postings of its two rarest words, intersected by relative position, then compared word by word."""
        starts = places(phrase[anchors[0]]) - anchors[0]
        starts = starts[(starts >= 0) & (starts + len(phrase) <= len(words))]
        if len(anchors) > 1:
            starts = np.intersect1d(starts, places(phrase[anchors[1]]) - anchors[1], assume_unique=True)
        starts = starts[doc[starts] == doc[starts + len(phrase) - 1]] if len(starts) else starts
        for q in anchors[2:]:
            starts = starts[words[starts + q] == phrase[q]]
        return starts

    def _met(self, notice: Notice, place: np.ndarray, own: np.ndarray, doc: np.ndarray, places) -> np.ndarray:
        """Flags of the places near which two or more indexed words of the notice stand at their relative position."""
        met = np.zeros(len(place), np.int64)
        for q in notice.rare:
            stands = places(notice.words[q])
            a = np.searchsorted(stands, place + q - self.slack)
            b = np.searchsorted(stands, place + q + self.slack, "right")
            some = np.flatnonzero(b > a)
            same = (doc[stands[a[some]]] <= own[some]) & (doc[stands[b[some] - 1]] >= own[some])
            met[some[same]] += 1
        return met >= min(2, len(notice.rare))


def frequencies(documents: DataFrame, index: Index, text: str = "text") -> tuple[dict[int, int], int]:
    """In how many documents each word of the index stands, one number a word, and the number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(index.vocabulary), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for chunk in chunks(column(batch, "_text")):
                words, doc, _ = words_of(chunk)
                at, number = index.licence_words(words)
                pairs = np.unique(number * chunk.n + doc[at])
                total += np.bincount(pairs // chunk.n, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *some], pa.int64()), pa.array([n, *total[some]], pa.int64())], names=["word", "n"])

    counts = arrow(documents.select(documents[text].alias("_text")), run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {row.word: row.n for row in counts.collect()}  # at most a number for each word of the templates
    return {int(index.vocabulary[k]): n for k, n in found.items() if k >= 0}, found.get(-1, 0)


PLACE = "struct<label:string,base:boolean,first:bigint,last:bigint,share:double>"


def scan(documents: DataFrame, text: str = "text", phrases: dict[str, str] = PHRASES, notices=NOTICES) -> DataFrame:
    """All columns of documents, `_n_words`, and `_places`: where base phrases and notices stand; columns of these two names are replaced.

    A place has label, base (of a base phrase), first and last word, and the share of the notice's words that stand there.
    """
    plain = Index(phrases, notices)
    index = Index(phrases, notices, *frequencies(documents, plain, text))
    names = [name for name in documents.columns if name not in ("_n_words", "_places")]
    documents = documents.select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(column(batch, text)):
                words, doc, first = words_of(chunk)
                held: list[list] = [[] for _ in range(chunk.n)]
                for label, base, a, b, share in index.scan(words, doc, first):
                    of = doc[a]
                    for d, x, y, s in zip(of.tolist(), (a - first[of]).tolist(), (b - first[of]).tolist(), share.tolist(), strict=True):
                        held[d].append({"label": label, "base": base, "first": x, "last": y, "share": s})
                n_words = np.bincount(doc, minlength=chunk.n)
                kept = [batch.column(k).slice(chunk.first, chunk.n) for k in range(len(names))]
                kind = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("first", pa.int64()), ("last", pa.int64()), ("share", pa.float64())]))
                yield pa.RecordBatch.from_arrays([*kept, pa.array(n_words, pa.int64()), pa.array(held, kind)], names=[*names, "_n_words", "_places"])

    fields = T.StructType([*documents.schema.fields, *T.StructType.fromDDL(f"_n_words long, _places array<{PLACE}>").fields])
    return arrow(documents, run, fields)


def op13_licenses(spark: SparkSession, folder: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))
    base = F.filter("_places", lambda p: p["base"])
    labels = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    notices = F.transform(F.filter("_places", lambda p: ~p["base"]), lambda p: p["share"])
    return found.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda p: p["first"])).alias("first_word"),
        F.array_max(F.transform(base, lambda p: p["first"])).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("_places")).alias("labels"),
        F.coalesce(F.array_max(notices), F.when(F.size(base) > 0, F.lit(PHRASE_SCORE)), F.lit(0.0)).alias("score"),
    )
