"""Spelling variants against plain code."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from fixtures import SCHEMA, awkward_texts, documents, rows

from reckon.llm import spelling

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(docs, spoilt):
    found = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if spoilt and h % spoilt == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {word: n for word, n in found.items() if len(word) >= 6}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def plain_variants(words, ratio=5):
    near = {w: [x for x in words if one_apart(w, x)] for w in words}
    best = {w: min(near[w], key=lambda x: (-words[x], x), default=None) for w in words}
    form = {w: b if b is not None and words[b] >= ratio * words[w] else None for w, b in best.items()}

    def root(word):
        while form[word] is not None:
            word = form[word]
        return word

    return {(w, form[w], root(w), words[w], len(near[w]), words.get(form[w])) for w in words}


def variant_texts():
    rnd = random.Random(5)
    base = ["settlement", "reconcile", "épargneée", "voucher", "unbelievable", "a" * 70, "b" * 200, "×÷ßàéîõü", "mississippi"]
    texts = awkward_texts(7)
    for word in base:
        texts.append(f"{word.upper()} {word}. " * rnd.choice([6, 40]))
        for _ in range(12):
            other = word
            for _ in range(rnd.choice([1, 1, 2])):
                at = rnd.randrange(len(other))
                other = other[:at] + rnd.choice(["", "x", "é", "ab"[rnd.randrange(2)] + other[at]]) + other[at + 1 :]
            texts.append(f"{other}, " * rnd.randint(1, 9))
    texts += ["zebra_zebras 1zebras", "w" * 50_000 + " " + "w" * 49_999 + "x", "Ünïçødé ÜNÏÇØDÉ Ünïçødé"]
    return texts


@pytest.mark.parametrize("spoilt", [None, 7, 199])
def test_words(spark, spoilt):
    texts = variant_texts()
    docs = spark.createDataFrame([*rows(texts), (None, "nothing named nothings", None, None, None)], SCHEMA).repartition(3)
    found = {r.word: r.n for r in spelling.counted(docs, spoilt).collect()}
    assert found == plain_words([*enumerate(texts), (None, "nothing named nothings")], spoilt)


def test_words_are_spilled_in_parts(spark, monkeypatch):
    texts = variant_texts()
    monkeypatch.setattr(spelling, "WORDS_AT_ONCE", 10)
    monkeypatch.setattr(spelling, "STEPS", 4)
    found = spelling.counted(documents(spark, texts), 199)
    assert {r.word: r.n for r in found.collect()} == plain_words(enumerate(texts), 199)


def test_variants(spark):
    words = plain_words(enumerate(variant_texts()), 7)
    found = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long").repartition(3))
    assert {tuple(r) for r in found.collect()} == plain_variants(words)


@pytest.mark.parametrize("rest, levels", [(1, 1), (3, 2), (2, 6)])
def test_every_near_pair_meets(spark, monkeypatch, rest, levels):
    """All words of two letters up to a length: every kind of edit at every place, at every depth of cutting."""
    monkeypatch.setattr(spelling, "REST", rest)
    monkeypatch.setattr(spelling, "LEVELS", levels)
    rnd = random.Random(2)
    words = {"".join(rnd.choice("ab") for _ in range(rnd.randint(6, 9))): rnd.randint(5, 60) for _ in range(300)}
    found = spelling.near_words(spark.createDataFrame(list(words.items()), "word string, n long"))
    pairs = [frozenset((r.a, r.b)) for r in found.collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {frozenset((a, b)) for a in words for b in words if one_apart(a, b)}


def test_roots_of_long_chains(spark):
    chain = [(f"w{k}", f"w{k + 1}") for k in range(37)] + [("side", "w20")]
    found = spelling.roots(spark.createDataFrame(chain, "word string, form string"))
    assert {tuple(r) for r in found.collect()} == {(w, "w37") for w, _ in chain}


def test_no_words(spark):
    for texts in ([], [None, "", "1234 5678"]):
        words = spelling.counted(spark.createDataFrame(rows(texts), SCHEMA), 199)
        assert spelling.variants(words).collect() == []


def test_crc32():
    rnd = random.Random(1)
    runs = [bytes(rnd.randrange(256) for _ in range(rnd.choice([0, 1, 5, 47, 48, 49, 300]))) for _ in range(60)]
    before = [zlib.crc32(str(k).encode()) for k in range(60)]
    ends = np.cumsum([len(r) for r in runs])
    starts = ends - [len(r) for r in runs]
    found = spelling.crc32(np.frombuffer(b"".join(runs), np.uint8), starts, ends, np.array(before, np.uint32))
    assert found.tolist() == [zlib.crc32(r, b) for r, b in zip(runs, before, strict=True)]


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    found = spelling.op12_spelling(spark, folder)
    assert dict(found.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    words = {w: n for w, n in plain_words(docs, 199).items() if n >= 5}
    assert {tuple(r) for r in found.collect()} == plain_variants(words)
