"""Quality rules, byte-level BPE, token counts and the classifier against plain versions."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from fixtures import SCHEMA, WORD, awkward_texts, documents, rows
from pyspark.sql import functions as F

from reckon.llm import bpe, classifier, lengths, quality_rules
from reckon.llm.textbytes import chunks

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts():
    return awkward_texts()


@pytest.fixture(scope="module")
def plain_encoder():
    ranks = bpe.load_ranks(public_tokenizers.path(bpe.RANKS))
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    seen, repeated_lines = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated_lines += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated_lines, len(covered)]


def test_base_counts(spark, texts):
    docs = documents(spark, texts).withColumnRenamed("lang", "n_words")
    none = np.zeros(64, np.int64)
    out = quality_rules.score(docs, docs.select("doc_id").limit(0), quality_rules.Counts(none, none)).collect()
    assert len(out) == len(texts)
    for row in out:
        counts = base_counts(texts[row.doc_id])
        assert [row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words] == counts
        assert row.base_failed == (counts[0] < 20 or 100 * counts[4] > 30 * counts[0])
        assert row.kept == (not row.base_failed)


def test_swapped_words_are_other_windows():
    line = "a b c d e f g h i a b d c e f g h j"
    (chunk,) = chunks(pa.array([line]))
    assert quality_rules.base_counts(chunk)["n_repeat_words"][0] == base_counts(line)[4] == 0


@pytest.mark.parametrize("bits", [23, 5])
def test_ratio_is_that_of_the_other_documents(spark, texts, monkeypatch, bits):
    """Also where the bitmap of trusted ids lets nearly all others through."""
    monkeypatch.setattr(quality_rules, "FILTER_BITS", bits)
    docs = documents(spark, texts)
    trusted = docs.where("doc_id % 3 = 1").select(F.col("doc_id").cast("int"))
    counts = quality_rules.fit(docs, trusted, buckets=128)
    raw, target, grams = np.zeros(128), np.zeros(128), {}
    for i, text in enumerate(texts):
        for chunk in chunks(pa.array([text], pa.string())):
            grams[i] = quality_rules.ngrams(chunk, 128)[0]
        n = len(WORD.findall(text or ""))
        assert len(grams[i]) == max(0, 2 * n - 1)
        raw += np.bincount(grams[i], minlength=128)
        target += np.bincount(grams[i], minlength=128) * (i % 3 == 1)
    assert (counts.raw == raw).all() and (counts.target == target).all()
    out = quality_rules.score(docs, trusted, counts, threshold=0.0).collect()
    assert sorted(r.doc_id for r in out) == list(range(len(texts)))
    for row in out:
        own = np.bincount(grams[row.doc_id], minlength=128)
        t, r = target - own * (row.doc_id % 3 == 1) + 1, raw - own + 1
        expected = (own * (np.log(t / t.sum()) - np.log(r / r.sum()))).sum() / max(own.sum(), 1)
        assert math.isclose(row.score, expected, abs_tol=1e-9)
        assert row.kept == (not row.base_failed and row.score >= 0)


def test_no_trusted_documents(spark, texts):
    docs = documents(spark, texts)
    counts = quality_rules.fit(docs, docs.select("doc_id").limit(0))
    assert not counts.target.any()
    assert all(r.score == 0 for r in quality_rules.score(docs, docs.select("doc_id").limit(0), counts).collect())
    empty = spark.createDataFrame([], SCHEMA)
    none = empty.select("doc_id")
    assert quality_rules.score(empty, none, quality_rules.fit(empty, none)).count() == 0


def test_every_trusted_document_counts(spark):
    """However many there are; if all documents are trusted, the target is the raw corpus."""
    docs = spark.range(20_500).selectExpr("id AS doc_id", "concat('w', id, ' v', id % 7) AS text")
    labels = docs.selectExpr("doc_id", "1 AS quality")
    counts = quality_rules.fit(docs, quality_rules.trusted_ids(labels.union(labels.limit(9))))
    assert (counts.target == counts.raw).all() and counts.raw.sum() == 3 * 20_500


def test_trusted_rows_are_told_apart(spark, monkeypatch):
    """Repeated rows stay, rows without id are not trusted, ids may come in another type."""
    monkeypatch.setattr(quality_rules, "FILTER_BITS", 6)
    docs = spark.range(900).selectExpr("IF(id < 890, id % 600, NULL) AS doc_id", "concat('t', id) AS text")
    trusted = spark.range(2000).where("id % 9 = 0").selectExpr("CAST(id AS INT) AS doc_id")
    others, maybe = quality_rules.told_apart(docs, trusted.union(trusted))
    assert others.where("trusted").isEmpty() and not maybe.where("NOT trusted").isEmpty()
    out = sorted((r.text, r.trusted) for r in others.union(maybe).collect())
    assert out == sorted((f"t{i}", i < 890 and i % 600 % 9 == 0) for i in range(900))


def test_trusted_texts_are_not_joined(spark):
    """Two bitmaps decide nearly all rows, so the texts of trusted documents are not shuffled either."""
    docs = spark.range(9000).selectExpr("id AS doc_id", "concat('t', id) AS text")
    told, joined = quality_rules.told_apart(docs, docs.where("doc_id % 2 = 0").select("doc_id"))
    assert joined.count() < 90
    out = sorted((r.doc_id, r.trusted) for r in told.union(joined).collect())
    assert out == [(i, i % 2 == 0) for i in range(9000)]


def test_no_document_vouches_for_itself(spark):
    """A trusted document of words of its own scores no better than the same text without trust."""
    words = lambda k, n=40: " ".join(f"w{(k * 37 + j * j) % 400}" for j in range(n))
    texts = [words(k) for k in range(400)] + [" ".join(f"x{j}" for j in range(40)), " ".join(f"y{j}" for j in range(40))]

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    trusted = docs.where("doc_id < 400 AND doc_id % 2 = 0 OR doc_id = 400").select("doc_id")
    out = {r.doc_id: r.score for r in quality_rules.score(docs, trusted, quality_rules.fit(docs, trusted)).collect()}
    assert abs(out[400] - out[401]) < 0.05


def test_pre_tokens_and_merges(plain_encoder):
    import random

    rnd = random.Random(1)
    alphabet = "ab'sre tlvdm \n\t\x0b  é日1²½Ⅷ!?.\u0085 😀x'S\x1c​一"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(3000)] + ["", None, "aaaa'sx're", "'" * 9]
    encoder = bpe.encoder(public_tokenizers.path(bpe.RANKS))
    for chunk in chunks(pa.array(texts, pa.string()), 5000):
        for k, (ids, decoded) in enumerate(encoder.documents(chunk)):
            text = texts[chunk.first + k] or ""
            assert ids.tolist() == plain_encoder.encode_ordinary(text)
            assert decoded == text.encode()


def test_memory_of_a_task_is_bounded():
    """Many texts of ever new words, cut into chunks, take far less memory than all of them at once."""
    import tracemalloc

    rnd = np.random.default_rng(3)
    texts = [" ".join(f"{n:x}" for n in rnd.integers(0, 1 << 40, 300)) for _ in range(2000)]
    encoder = bpe.Encoder(public_tokenizers.path(bpe.RANKS))
    bpe._pairs(encoder.path)
    tracemalloc.start()
    n = sum(len(ids) for chunk in chunks(pa.array(texts), bpe.TEXT_AT_ONCE) for ids, _ in encoder.documents(chunk))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 2000 * 300 and peak < 160 << 20


def test_replay_in_rank_order(plain_encoder):
    import random

    rnd = random.Random(2)
    path = public_tokenizers.path(bpe.RANKS)
    ranks = bpe.load_ranks(path)
    words = ["".join(rnd.choice("aaabe s.") for _ in range(rnd.randint(1, 40))).encode() for _ in range(1500)]
    flat, offsets = bpe.replay(words, path)
    for n, word in enumerate(words):
        expected = [ranks[word]] if word in ranks else bpe._one_by_one(word, ranks)
        assert flat[offsets[n] : offsets[n + 1]].tolist() == expected


def test_lower_rank_comes_up_late(tmp_path):
    """A vocabulary in which a merge brings up a pair of lower rank: it must go before the rest."""
    tokens = [bytes([b]) for b in range(256)] + [b"xyz", b"xy", b"zz", b"xyzz"]
    file = tmp_path / "ranks"
    file.write_bytes(b"".join(base64.b64encode(t) + b" " + str(n).encode() + b"\n" for n, t in enumerate(tokens)))
    ranks = bpe.load_ranks(str(file))
    words = [b"xyzxyz", b"zzxyzz", b"xyxyzzz", b"qqxyz"]
    flat, offsets = bpe.replay(words, str(file))
    for n, word in enumerate(words):
        assert flat[offsets[n] : offsets[n + 1]].tolist() == bpe._one_by_one(word, ranks)


def test_encode_and_decode_table(spark, texts, plain_encoder):
    docs = documents(spark, texts).withColumnRenamed("lang", "ids")
    coded = bpe.encode(docs, keep=("doc_id", "source"))
    out = {r.doc_id: r for r in coded.collect()}
    assert len(out) == len(texts)
    for i, text in enumerate(texts):
        ids = plain_encoder.encode_ordinary(text or "")
        assert out[i].ids == ids and out[i].n_tokens == len(ids)
        assert out[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert out[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert {r.doc_id: r.text for r in bpe.decode(coded).collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.encode(spark.createDataFrame([], SCHEMA)).count() == 0


def test_token_counts(spark):
    values = [0, 0, 1, 3, 3, 3, 1023, 1024, 5000, 5000, 9999, None]
    table = lengths.limits(lengths.histogram(spark.createDataFrame([(v,) for v in values], "n_tokens long")))
    own = [v or 0 for v in values]
    out = {r.length: r for r in table.collect()}
    assert out.keys() == set(own)
    for length, row in out.items():
        assert row.documents == own.count(length)
        assert (row.all_documents, row.all_tokens) == (len(own), sum(own))
        assert row.documents_longer == sum(v > length for v in own)
        assert row.tokens_longer == sum(v for v in own if v > length)
        assert row.tokens_cut == sum(min(v, length) for v in own)
        assert row.share_fitting == sum(v <= length for v in own) / len(own)
    for row in lengths.at_limits(table, [0, 2, 3, 1500, 20000]).collect():
        assert row.tokens_cut == sum(min(v, row.context) for v in own)
        assert row.documents_longer == sum(v > row.context for v in own)
    assert lengths.quantile(table, 0.5).first().length == sorted(own)[len(own) // 2 - 1]
    assert lengths.limits(lengths.histogram(spark.createDataFrame([], "n_tokens long"))).count() == 0


def test_token_counts_of_documents(spark, plain_encoder):
    out = lengths.op3_token_counts(spark, SF).collect()
    own = Counter(len(plain_encoder.encode_ordinary(r.text or "")) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    assert {r.length: r.documents for r in out} == own


def test_margin_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    machine = classifier.Machine(
        np.zeros((len(classifier.STATISTICS), classifier.BINS - 1)), 0.3, rng.normal(size=classifier.N_FEATURES),
        rng.normal(size=(classifier.N_FEATURES, classifier.FACTORS)),
    )
    feature, x = rng.choice(classifier.N_FEATURES, 12, replace=False), rng.normal(size=12)
    margin, _ = machine.margin(feature, x, np.array([0, 5]))
    for n, part in enumerate((slice(0, 5), slice(5, 12))):
        f, v = feature[part], x[part]
        pairs = sum(machine.v[f[i]] @ machine.v[f[j]] * v[i] * v[j] for i in range(len(f)) for j in range(i))
        assert math.isclose(margin[n], 0.3 + machine.w[f] @ v + pairs)


def test_classifier_learns(spark):
    out = {r.doc_id: r for r in classifier.op10_classifier(spark, SF).collect()}
    assert len(out) == spark.read.parquet(f"{SF}/documents.parquet").count()
    hits = []
    for label in spark.read.parquet(f"{SF}/labels.parquet").collect():
        row = out[label.doc_id]
        assert row.held_out == (zlib.crc32(str(label.doc_id).encode()) % 5 == 0)
        assert 0 <= row.score <= 1 and row.predicted == (row.score >= 0.3)
        if row.held_out:
            hits.append(row.predicted == label.quality)
    assert np.mean(hits) > 0.95


def test_classifier_on_awkward_tables(spark, texts):
    docs = spark.createDataFrame(rows(texts) + rows(texts)[:5] + [(None, "no id", None, None, None)], SCHEMA).withColumnRenamed("lang", "score")
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(40)] + [(0, 1, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    scored = classifier.classify(docs, classifier.fit(docs, classifier.sample_ids(labels)))
    found = scored.collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 for r in found)
    same = {}
    for row in found:
        assert same.setdefault(row.doc_id, row.score) == row.score
    none = classifier.fit(docs, classifier.sample_ids(labels.limit(0)))
    assert {r.score for r in classifier.classify(docs, none).collect()} == {0.5}
    assert classifier.classify(docs.limit(0), none).count() == 0


def test_score_ignores_other_columns(spark, texts):
    labels = spark.createDataFrame([(i, int(len(t or "") > 300), 0) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int")
    docs = documents(spark, texts)
    machine = classifier.fit(docs, classifier.sample_ids(labels))
    one = {r.doc_id: r.score for r in classifier.classify(docs, machine).collect()}
    moved = docs.selectExpr("doc_id + 1000 AS doc_id", "text", "source AS lang", "lang AS source", "0L AS n_chars")
    assert {r.doc_id - 1000: r.score for r in classifier.classify(moved, machine).collect()} == one
