"""Phrase collocations against plain code."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from fixtures import SCHEMA, awkward_texts, documents, rows

from reckon.llm import collocations
from reckon.llm.collocations import HatTrie

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(docs, longest=5):
    """(lang, words): occurrences."""
    found = Counter()
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for m in range(1, longest + 1):
                found.update((lang or "und", tuple(words[k : k + m])) for k in range(len(words) - m + 1))
    return found


def plain_collocations(docs, least, longest=5, absorb=100):
    counts = plain_counts(docs, longest)
    totals = Counter()
    for (lang, words), n in counts.items():
        totals[lang] += n * (len(words) == 1)
    some = {key: n for key, n in counts.items() if len(key[1]) > 1 and n >= least}
    gone = set()
    for (lang, words), n in some.items():
        for a in range(len(words)):
            for b in range(a + 2, len(words) + 1):
                if b - a < len(words) and 100 * n >= absorb * some[lang, words[a:b]]:
                    gone.add((lang, words[a:b]))
    out = set()
    for (lang, words), a in some.items():
        if (lang, words) not in gone:
            cuts = []
            for k in range(1, len(words)):
                left, right = counts[lang, words[:k]], counts[lang, words[k:]]
                cuts.append((1000 * a * totals[lang] // (left * right), k, left, right))
            score, _, left, right = min(cuts)
            out.add((lang, " ".join(words), a, left, right, totals[lang], score))
    return out


def phrase_texts():
    rnd = random.Random(9)
    words = ["the", "cat", "Sat", "on", "mat", "é", "über", "a\x00b", "x y", "new", "york"]
    texts = awkward_texts(3)
    texts += [rnd.choice([" ", "  ", "\t"]).join(rnd.choices(words, k=rnd.randint(1, 60))) + rnd.choice(".,;:!?\n\r\x0b ") for _ in range(80)]
    texts += ["new york city hall. " * 30, "New\tYork, new york\nnew york", "a a a a a a a a a", "one.two;three", "spam spam " * 400]
    return texts


def langs_of(texts):
    return [(r[2], r[1]) for r in rows(texts)]


@pytest.mark.parametrize("least, longest, absorb", [(5, 5, 100), (20, 4, 100), (3, 3, 80), (2, 2, 100)])
def test_collocations(spark, least, longest, absorb):
    texts = phrase_texts()
    found = collocations.collocations(documents(spark, texts), least, longest, absorb)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got))
    assert set(got) == plain_collocations(langs_of(texts), least, longest, absorb)


def test_spilled_subtrees_and_full_bitmaps(spark, monkeypatch):
    """Tiny containers that burst and spill all the time, and bitmaps that let nearly everything through."""
    for name, value in (("BURST", 4), ("MOST", 30), ("LEAST_BITS", 5), ("MOST_BITS", 6), ("WORDS_AT_ONCE", 7), ("NAMINGS", 1)):
        monkeypatch.setattr(collocations, name, value)
    texts = phrase_texts()
    found = collocations.collocations(documents(spark, texts), 5)
    assert {tuple(r) for r in found.collect()} == plain_collocations(langs_of(texts), 5)


def test_trie():
    rnd = np.random.default_rng(4)
    trie, want, got = HatTrie(burst=8, most=100), Counter(), Counter()

    def take(runs):
        for run in runs:
            assert (np.diff(run[0].astype(object)) >= 0).all()  # a sorted run
            for gram, n in zip(run[1].tolist(), run[2].tolist(), strict=True):
                got[gram] += n

    for _ in range(50):
        gram = rnd.integers(0, 300, 40).astype(np.uint64)
        want.update(gram.tolist())
        spread = gram * np.uint64(0x9E3779B97F4A7C15)
        trie.add(spread, gram)
        assert (np.diff(trie.bounds.astype(object)) > 0).all() and len(trie.leaves) == len(trie.bounds) + 1
        if trie.full():
            take(trie.spilled(50))
            assert trie.size <= 50
    assert len(trie.leaves) > 8
    take(trie.spilled())
    assert got == want and trie.size == 0


def test_one_path_cannot_burst():
    trie = HatTrie(burst=4, most=1000)
    gram = np.arange(100).astype(np.uint64)
    trie.add(np.zeros(100, np.uint64), gram)  # all paths are equal: a container of any size
    assert sum(run[2].sum() for run in trie.spilled()) == 100


def test_exact_beyond_64_bits(spark, monkeypatch):
    """Counts so large that 1000 * a * n and l * r need more than 64 bits."""
    a, left, right, n = 4 * 10**9 + 7, 3 * 10**12 + 1, 5 * 10**12 + 3, 6 * 10**13 + 11
    phrases = [("en", [1], "x", left), ("en", [2], "y", right), ("en", [1, 2], "x y", a)]
    table = spark.createDataFrame(phrases, "lang string, ids array<long>, phrase string, a long")
    monkeypatch.setattr(collocations, "frequent_phrases", lambda *_: (table, spark.createDataFrame([("en", n)], "lang string, n long")))
    (row,) = collocations.collocations(table).collect()
    assert tuple(row) == ("en", "x y", a, left, right, n, 1000 * a * n // (left * right))


def test_empty(spark):
    for texts in ([], [None, "", " \t", ".,;"]):
        assert collocations.collocations(spark.createDataFrame(rows(texts), SCHEMA), 1).collect() == []


def test_other_columns_may_clash(spark):
    docs = documents(spark, ["a b a b", "a b"]).selectExpr("text", "lang", "1 AS id", "2 AS gram", "3 AS word", "4 AS n")
    assert {(r.phrase, r.a) for r in collocations.collocations(docs, 2).collect()} == {("a b", 2)}
