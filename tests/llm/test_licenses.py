"""Licence scan against plain code."""

import random
import re

import pytest
from fixtures import SCHEMA, awkward_texts, documents, rows

from reckon.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SLACK, COVER = licenses.SLACK, licenses.COVER


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def starts(words, phrase):
    phrase = phrase.split(" ")
    return [k for k in range(len(words) - len(phrase) + 1) if words[k : k + len(phrase)] == phrase]


def plain(text):
    """n_words, sorted base places (label, start), sorted notices (label, share)."""
    words = words_of(text)
    base = sorted((label, k) for phrase, label in licenses.PHRASES.items() for k in starts(words, phrase))
    found = []
    for label, notice, keys in licenses.NOTICES:
        own = notice.split(" ")
        first = [starts(own, key)[0] for key in keys]
        for at in starts(words, keys[0]):
            place = at - first[0]
            if any(not [k for k in starts(words, key) if abs(k - place - q) <= SLACK] for key, q in zip(keys[1:], first[1:], strict=True)):
                continue
            near = lambda q, place=place: words[max(0, place + q - SLACK) : max(0, place + q + SLACK + 1)]
            share = sum(word in near(q) for q, word in enumerate(own)) / len(own)
            if share >= COVER - 1e-9:
                found.append((label, round(share, 9)))
    return len(words), base, sorted(found)


def license_texts():
    rnd = random.Random(11)
    texts = awkward_texts(5)
    texts += ["MIT License", "the mit-license; Mit License mit license", "mit", "license mit", "x MIT\nLICENSE Apache/License GENERAL PUBLIC licenSe"]
    texts += ["Licensed under the Apache License, Version 2.0.", "This is licensed under the GNU General Public License, version 3."]
    texts += ["Licensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0.", "licence é mit license ü", "mit liçense", "0mit license 1"]
    filler = words_of(texts[-20]) or ["word"]
    for _, notice, _ in licenses.NOTICES:
        words = notice.split(" ")
        for changes in (0, 1, 2, 4, 8, 20):
            other = list(words)
            for _ in range(changes):
                at = rnd.randrange(len(other))
                other[at : at + 1] = rnd.choice([[], [rnd.choice(filler)], [other[at], rnd.choice(filler)]])
                other = other or ["x"]
            before, after = ([rnd.choice(filler) for _ in range(rnd.choice([0, 3, 50]))] for _ in "ab")
            texts.append(rnd.choice([" ", ", ", "\n"]).join([*before, *other, *after]).title())
    texts += [" ".join(notice for _, notice, _ in licenses.NOTICES) * 3, "mit license " * 5000, "the license " * 4000]
    return texts


def found_in(df):
    out = {}
    for r in df.collect():
        base = sorted((p.label, p.first) for p in r._places if p.base)
        out[r.doc_id] = r._n_words, base, sorted((p.label, round(p.share, 9)) for p in r._places if not p.base)
    return out


def test_scan(spark):
    texts = license_texts()
    assert found_in(licenses.scan(documents(spark, texts))) == {k: plain(text) for k, text in enumerate(texts)}


def test_corpus_does_not_change_results(spark):
    """The rarest words follow the corpus; what is found does not."""
    texts = license_texts()
    some = texts[40:60]
    alone = found_in(licenses.scan(documents(spark, some)))
    crowd = some + ["licensed under mit apache general public version 2 3 hereby charge forms"] * 400
    among = found_in(licenses.scan(documents(spark, crowd)))
    assert {k: among[k] for k in alone} == alone


def test_index_holds_the_rarest_words():
    plain_index = licenses.Index()
    common = {int(h): 900 for h in plain_index.vocabulary}
    rare = int(licenses._hashes("apache")[0])
    index = licenses.Index(frequency=common | {rare: 2}, n_documents=1000)
    assert [anchors[0] for phrase, anchors in zip(index.phrases, index.anchors, strict=True) if int(phrase[0]) == rare] == [0, 0]
    assert all(len(notice.rare) < len(notice.words) for notice in index.notices if len(notice.words) > 9)


def test_places_are_where_the_words_stand(spark):
    text = "x y Licensed under the Apache License, Version 2.0. z"
    (row,) = licenses.scan(documents(spark, [text])).collect()
    assert [(p.label, p.base, p.first, p.last, p.share) for p in row._places] == [("apache", True, 5, 6, 1.0), ("apache-2.0", False, 2, 9, 1.0)]


def test_empty_and_clashing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert licenses.scan(empty).collect() == []
    clash = documents(spark, ["mit license", None]).selectExpr("doc_id", "text", "1 AS _places", "2 AS label", "3 AS _text", "4 AS _n_words")
    assert {r.doc_id: (r._n_words, len(r._places), r.label, r._text) for r in licenses.scan(clash).collect()} == {0: (2, 1, 2, 3), 1: (0, 0, 2, 3)}


@pytest.mark.parametrize("name", ["sf0.001"])
def test_query(spark, name):
    folder = f"/root/testdata/{name}"
    want = {}
    for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        n, base, notices = plain(r.text)
        at = [k for _, k in base]
        labels = sorted({label for label, _ in base})
        score = max((s for _, s in notices), default=0.5 if base else 0.0)
        every = ",".join(sorted({*labels, *(label for label, _ in notices)}))
        want[r.doc_id] = (n, len(base), min(at, default=None), max(at, default=None), ",".join(labels), every, score)
    found = licenses.op13_licenses(spark, folder)
    assert {r.doc_id: (*r[1:7], round(r.score, 9)) for r in found.collect()} == want
