"""Phrase collocations: exact counts of frequent word sequences, by HAT-tries, and the sequences whose words belong together.

1. Words are counted per language; a word's id is a 64-bit hash of both. Phrases are counted length by length: one of m words can only
   reach the least count if both of its parts of m - 1 words do, so other places are passed over (told by a bitmap of the
   frequent parts, which may let some more through).
2. A task counts in a HAT-trie: a shallow trie over ranges of first-word ids, whose leaves are containers that find phrases by hash. A
   container that grows beyond BURST phrases bursts into several; beyond MOST phrases in all the largest subtrees are spilled whole, as sorted
   runs of hashes (64 bits) and counts. Runs are merged in Spark, dealt by the whole phrase instead of its first word, as a word may begin a third
   of all phrases.
3. Only frequent phrases are named: a last reading gives their words, from a few documents each. Cuts, scores and absorbed phrases are joins
   of frequent phrases alone.

A-Z are lower-cased. Pieces end at [.,;:!?] and 0x0A-0x0D, words at space and tab; phrases stay within a piece. A null text is
empty, a null language `und`. Texts may have any length; repeated rows count again. Only text and lang are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reckon.llm.shared import arrow, bitmap, in_bitmap, written
from reckon.llm.textbytes import Chunk, chunks, column, mix

LEAST = 100
LONGEST = 5
TOP = 2000
ABSORB = 100  # per cent of a phrase's occurrences that lie in one longer phrase
BURST = 1 << 15
MOST = 1 << 20
WORDS_AT_ONCE = 200_000
NAMINGS = 4
LEAST_BITS, MOST_BITS = 16, 25
TOGETHER = ((2,), (3,), (4, 5))  # lengths that are counted in one reading of the texts
_BASE = np.uint64(0x9E3779B97F4A7C15)
_HIGH = np.uint64(0xFFFFFF << 40)

IS_BREAK = np.zeros(256, bool)
IS_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
IS_GAP = IS_BREAK.copy()
IS_GAP[list(b" \t")] = True


def words_of(chunk: Chunk, langs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, starts and ends of the words of a chunk, and flags of those whose next word is in the same piece; langs of its documents."""
    low = chunk.lowered()
    starts, ends = low.runs(~IS_GAP[low.data])
    doc = low.doc_of(starts)
    of_lang = {lang: int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest()) for lang in set(langs)}
    seed = np.array([of_lang[lang] for lang in langs], np.uint64)
    ids = mix(low.hashes(starts, ends) ^ mix(seed[doc]))
    piece = np.concatenate(([0], np.cumsum(IS_BREAK[low.data])))[starts]
    goes_on = np.zeros(len(starts), bool)
    goes_on[:-1] = (doc[1:] == doc[:-1]) & (piece[1:] == piece[:-1])
    return ids, starts, ends, goes_on


class HatTrie:
    """Counts of phrases in containers that cover ranges of paths; a path begins with bits of the first word's id.

    Entries are columns of a matrix: path, gram (hash of the phrase), count.
    """

    def __init__(self, burst: int | None = None, most: int | None = None):
        self.burst, self.most = burst or BURST, most or MOST
        self.bounds = np.zeros(0, np.uint64)  # least path of each container but the first
        self.leaves: list[list[np.ndarray]] = [[]]
        self.size = 0

    @staticmethod
    def settled(parts: list[np.ndarray]) -> np.ndarray:
        """One matrix of the parts, sorted by path, equal phrases added up."""
        all_of = np.concatenate(parts, axis=1) if len(parts) != 1 else parts[0]
        if not all_of.shape[1]:
            return all_of
        all_of = all_of[:, np.argsort(all_of[0])]
        new = np.ones(all_of.shape[1], bool)
        new[1:] = (all_of[0, 1:] != all_of[0, :-1]) | (all_of[1, 1:] != all_of[1, :-1])
        begin = np.flatnonzero(new)
        out = all_of[:, begin]
        out[2] = np.add.reduceat(all_of[2], begin)
        return out

    def add(self, first: np.ndarray, gram: np.ndarray) -> None:
        """Count one occurrence of each phrase."""
        path = (first & _HIGH) | (gram >> np.uint64(24))
        rows = self.settled([np.vstack((path, gram, np.ones(len(gram), np.uint64)))])
        cuts = np.concatenate(([0], np.searchsorted(rows[0], self.bounds), [rows.shape[1]]))
        grown = []
        for k, leaf in enumerate(self.leaves):
            if cuts[k + 1] > cuts[k]:
                leaf.append(rows[:, cuts[k] : cuts[k + 1]])
                self.size += int(cuts[k + 1] - cuts[k])
                if sum(part.shape[1] for part in leaf) > 2 * self.burst:
                    grown.append(k)
        for k in reversed(grown):
            self._settle(k)

    def _settle(self, k: int) -> None:
        """Add up a container; beyond BURST phrases it bursts into several of equal size."""
        before = sum(part.shape[1] for part in self.leaves[k])
        rows = self.settled(self.leaves[k])
        self.size += rows.shape[1] - before
        some = -(-2 * rows.shape[1] // self.burst) if rows.shape[1] > self.burst else 1
        bounds = np.unique(rows[0, np.arange(1, some) * rows.shape[1] // some]) if some > 1 else rows[0, :0]
        cuts = [0, *np.searchsorted(rows[0], bounds).tolist(), rows.shape[1]]
        keep = [j for j in range(len(bounds)) if cuts[j + 1] > cuts[j]]  # a bound at the first path splits nothing off
        bounds, cuts = bounds[keep], [0, *(cuts[j + 1] for j in keep), rows.shape[1]]
        self.leaves[k : k + 1] = [[rows[:, a:b]] for a, b in zip(cuts, cuts[1:], strict=False)]
        self.bounds = np.insert(self.bounds, k, bounds)

    def full(self) -> bool:
        return self.size > self.most

    def spilled(self, keep: int = 0) -> Iterator[np.ndarray]:
        """Sorted runs of whole containers, the largest first, until at most keep phrases are left."""
        sizes = [sum(part.shape[1] for part in leaf) for leaf in self.leaves]
        for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
            if self.size <= keep:
                break
            if sizes[k]:
                yield self.settled(self.leaves[k])
                self.leaves[k] = []
                self.size -= sizes[k]


def _named(documents: DataFrame) -> DataFrame:
    return documents.select("text", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))


def word_counts(documents: DataFrame) -> DataFrame:
    """id, lang, word, n: every word of each language and its occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, int] = {}
        names: dict[int, tuple[str, bytes]] = {}

        def flush() -> pa.RecordBatch:
            ids = pa.array(np.array(list(held), np.uint64).view(np.int64))
            langs = pa.array([names[k][0] for k in held], pa.string())
            words = pa.array([names[k][1] for k in held], pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([ids, langs, words, pa.array(held.values(), pa.int64())], names=["id", "lang", "word", "n"])

        for batch in batches:
            all_langs = column(batch, "lang").to_pylist()
            for chunk in chunks(column(batch, "text")):
                langs = all_langs[chunk.rows]
                ids, starts, ends, _ = words_of(chunk, langs)
                found, at, n = np.unique(ids, return_index=True, return_counts=True)
                fresh = [k for k, one in enumerate(found.tolist()) if one not in names]
                raw = chunk.lowered().data.tobytes() if fresh else b""
                doc = chunk.doc_of(starts[at])
                for k in fresh:
                    names[int(found[k])] = langs[doc[k]], raw[starts[at[k]] : ends[at[k]]]
                for one, some in zip(found.tolist(), n.tolist(), strict=True):
                    held[one] = held.get(one, 0) + some
                if len(held) > WORDS_AT_ONCE:
                    yield flush()
                    held.clear()
                    names.clear()
        if held:
            yield flush()

    counts = arrow(_named(documents), run, "id long, lang string, word string, n long")
    return counts.groupBy("id", "lang", "word").agg(F.sum("n").alias("n"))


def phrases_in(ids: np.ndarray, goes_on: np.ndarray, longest: int, filters: dict[int, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, first words, hashes) of the phrases of 2 to `longest` words whose parts of m words filters[m] lets through, if there is one."""
    at, gram = np.arange(len(ids)), ids
    for length in range(2, longest + 1):
        if length - 1 in filters:
            some = np.flatnonzero(in_bitmap(filters[length - 1], gram))
            at, gram = at[some], gram[some]
        beside = at[1:] == at[:-1] + 1  # longer ones overlap, so both lie in one piece
        next_to = np.flatnonzero(beside & goes_on[at[:-1]] if length == 2 else beside)
        gram, at = gram[next_to], at[next_to]
        gram = mix(gram * _BASE + ids[at + length - 1])
        yield length, at, gram


def gram_counts(documents: DataFrame, parts: np.ndarray, lengths: tuple[int, ...]) -> DataFrame:
    """gram, n of the phrases of these lengths, whose parts of lengths[0] - 1 words a bitmap lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = HatTrie()

        def rows(one: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(one[k].view(np.int64)) for k in (1, 2)], names=["gram", "n"])

        for batch in batches:
            langs = column(batch, "lang").to_pylist()
            for chunk in chunks(column(batch, "text")):
                ids, _, _, goes_on = words_of(chunk, langs[chunk.rows])
                for length, at, gram in phrases_in(ids, goes_on, lengths[-1], {lengths[0] - 1: parts}):
                    if length in lengths and len(at):
                        trie.add(ids[at], gram)
                if trie.full():
                    yield from map(rows, trie.spilled(trie.most // 2))
        yield from map(rows, trie.spilled())

    return arrow(_named(documents), run, "gram long, n long").repartition("gram").groupBy("gram").agg(F.sum("n").alias("n"))


def named_grams(documents: DataFrame, parts: np.ndarray, wanted: dict[int, np.ndarray], longest: int) -> DataFrame:
    """gram, lang, ids, phrase of the phrases that a bitmap in wanted lets through, of which only one in so many documents gives the name.

    Which ones follows from hashes of the phrase and the text. parts lets all parts of wanted phrases through, words included.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            all_langs, texts = column(batch, "lang").to_pylist(), column(batch, "h").to_numpy().view(np.uint64)
            for chunk in chunks(column(batch, "text")):
                langs, own = all_langs[chunk.rows], texts[chunk.rows]
                ids, starts, ends, goes_on = words_of(chunk, langs)
                doc, raw = chunk.doc_of(starts), chunk.lowered().data.tobytes()
                out: list[tuple] = []
                for length, at, gram in phrases_in(ids, goes_on, longest, dict.fromkeys(range(1, longest), parts)):
                    drawn = mix(gram ^ own[doc[at]])
                    named = np.zeros(len(gram), bool)
                    for one_in, table in wanted.items():
                        some = np.flatnonzero(drawn % np.uint64(one_in) == 0)
                        named[some[in_bitmap(table, gram[some])]] = True
                    some = np.flatnonzero(named)
                    found, first = np.unique(gram[some], return_index=True)
                    for key, i in zip(found.view(np.int64).tolist(), at[some][first].tolist(), strict=True):
                        if key not in seen:
                            seen.add(key)
                            words = [raw[starts[j] : ends[j]] for j in range(i, i + length)]
                            out.append((key, langs[doc[i]], ids[i : i + length].view(np.int64), b" ".join(words).decode()))
                if out:
                    kinds = (pa.int64(), pa.string(), pa.list_(pa.int64()), pa.string())
                    columns = [pa.array(values, kind) for values, kind in zip(zip(*out, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names=["gram", "lang", "ids", "phrase"])

    rows = arrow(_named(documents).withColumn("h", F.xxhash64("text")), run, "gram long, lang string, ids array<long>, phrase string")
    return rows.groupBy("gram").agg(*(F.min(name).alias(name) for name in ("lang", "ids", "phrase")))


def named(documents: DataFrame, grams: DataFrame, words: DataFrame, least: int, longest: int) -> DataFrame:
    """gram, lang, ids, phrase, n of the frequent phrases (gram, n), parts of which are the words (gram).

    A phrase with n occurrences takes its name from about one in n / NAMINGS documents, so that not every task names it; what so
    gets none, as its occurrences are in a few documents, is looked for in all.
    """
    parts = _filter(grams.select("gram").union(words))
    wanted, low = {}, least
    most = grams.agg(F.max("n")).first()[0] or 0
    while low <= most:  # as many steps as the counts have powers of eight
        some = grams.where(F.col("n").between(low, 8 * low - 1)).select("gram")
        wanted[max(1, low // NAMINGS)] = _filter(some)
        low *= 8
    first = written(named_grams(documents, parts, wanted, longest).join(grams, "gram"))
    missing = grams.join(first.select("gram"), "gram", "left_anti")
    if (left := missing.select("gram")).isEmpty():
        return first
    return first.union(named_grams(documents, parts, {1: _filter(left)}, longest).join(missing, "gram"))


def _filter(hashes: DataFrame) -> np.ndarray:
    """A bitmap of about 16 bits a hash, up to a bound; beyond it lets more through."""
    return bitmap(hashes, min(max(LEAST_BITS, (16 * hashes.count()).bit_length()), MOST_BITS))


def frequent_phrases(documents: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """lang, ids (of the words), phrase, a of all phrases of up to `longest` words with a >= least; and lang, n, the words of each language."""
    words = written(word_counts(documents))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    single = words.where(F.col("n") >= least)
    found, before = [], single.select(F.col("id").alias("gram"))
    for together in TOGETHER:
        if lengths := tuple(m for m in together if m <= longest):
            found.append(written(gram_counts(documents, _filter(before), lengths).where(F.col("n") >= least)))
            before = found[-1].select("gram")
    grams = reduce(DataFrame.unionByName, found)
    phrases = named(documents, grams, single.select(F.col("id").alias("gram")), least, longest)
    one = single.select("lang", F.array("id").alias("ids"), F.col("word").alias("phrase"), F.col("n").alias("a"))
    return written(one.unionByName(phrases.select("lang", "ids", "phrase", F.col("n").alias("a")))), totals


def collocations(documents: DataFrame, least: int = LEAST, longest: int = LONGEST, absorb: int = ABSORB) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the phrases of 2 to `longest` words that occur `least` times and are in no longer one.

    Cutting a phrase in two gives floor(1000 * a * n / (l * r)), n being the words of the language; the lowest cut counts, of equal ones the
    first. A phrase is absorbed if one longer phrase has `absorb` per cent of its occurrences; the longer ones by a single word tell.
    """
    phrases, totals = frequent_phrases(documents, least, longest)
    size = F.size("ids")
    longer = phrases.where(size > 2)
    parts = F.explode(F.array(F.slice("ids", F.lit(1), size - 1), F.slice("ids", F.lit(2), size - 1)))
    inside = longer.select(parts.alias("ids"), "a").groupBy("ids").agg(F.max("a").alias("longer"))
    kept = phrases.where(size > 1).join(inside, "ids", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < absorb * F.col("a")))
    cut = kept.join(totals, "lang").select("lang", "ids", "phrase", "a", "n", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cut = cut.withColumns({"left": F.slice("ids", F.lit(1), F.col("k")), "right": F.slice("ids", F.col("k") + 1, size)})
    cut = cut.join(phrases.select(F.col("ids").alias("left"), F.col("a").alias("l")), "left")
    cut = cut.join(phrases.select(F.col("ids").alias("right"), F.col("a").alias("r")), "right")
    exact = {name: f"CAST({name} AS DECIMAL({digits}, 0))" for name, digits in (("a", 16), ("n", 18), ("l", 18), ("r", 18))}
    score = F.expr(f"CAST(1000 AS DECIMAL(4, 0)) * {exact['a']} * {exact['n']} div ({exact['l']} * {exact['r']})")
    best = cut.groupBy("ids").agg(
        F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"), *(F.first(name).alias(name) for name in ("lang", "phrase", "a", "n"))
    )
    return best.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    found = collocations(spark.read.parquet(f"{folder}/documents.parquet"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


OP11_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), lists AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
    SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: w[i:i + m - 1])) AS g
    FROM lists, (VALUES (1), (2), (3), (4), (5)) AS lengths(m)
    WHERE len(w) >= m
), counts AS (
    SELECT lang, m, g, count(*) AS f FROM grams GROUP BY lang, m, g
), totals AS (
    SELECT lang, sum(f) AS n FROM counts WHERE m = 1 GROUP BY lang
), candidates AS (
    SELECT lang, m, g, f AS a FROM counts WHERE m > 1 AND f >= 100
), kept AS (
    SELECT * FROM candidates AS c
    WHERE NOT EXISTS (
        SELECT 1 FROM candidates AS x
        WHERE x.lang = c.lang AND x.m = c.m + 1 AND 100 * x.a >= 100 * c.a AND (x.g[1:c.m] = c.g OR x.g[2:c.m + 1] = c.g))
), cuts AS (
    SELECT c.lang, c.g, c.a, x.f AS l, y.f AS r, t.n, s.k, 1000 * c.a::HUGEINT * t.n // (x.f::HUGEINT * y.f) AS score
    FROM kept AS c
    JOIN (VALUES (1), (2), (3), (4)) AS s(k) ON s.k < c.m
    JOIN totals AS t ON t.lang = c.lang
    JOIN counts AS x ON x.lang = c.lang AND x.g = c.g[1:s.k]
    JOIN counts AS y ON y.lang = c.lang AND y.g = c.g[s.k + 1:]
), scored AS (
    SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score FROM cuts
    QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM scored)
WHERE rank <= 2000
"""
