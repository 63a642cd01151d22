"""Small tables with every awkward case, and plain versions of the operators to compare with."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def vocabulary(seed: int, n: int = 400) -> list[str]:
    rnd = random.Random(seed)
    return ["".join(rnd.choice(["an", "er", "th", "ou", "é", "in", "st", "ü"]) for _ in range(rnd.randint(1, 5))) for _ in range(n)]


def prose(rnd: random.Random, words: list[str], n: int) -> str:
    out = []
    for k in range(n):
        out.append(rnd.choice(words))
        if k % 13 == 12:
            out[-1] += ".\n" if rnd.random() < 0.3 else "."
    return " ".join(out)


def awkward_texts(seed: int = 3) -> list[str | None]:
    """Null, empty, blank, tiny, junk, long, repeated and nearly repeated texts."""
    rnd, words = random.Random(seed), vocabulary(seed)
    texts: list[str | None] = [None, "", " \n\t ", "one", "One  two", "a b c d", "a b c d", "A B C D", "a b c d e", "a b d c e"]
    base = [prose(rnd, words, n) for n in (30, 60, 120, 300, 300, 900)]
    passage = prose(rnd, words, 70)
    for text in base:
        texts += [text, text, text.upper()]
        parts = text.split(" ")
        for changes in (1, 2, 5, 12, 40):
            other = list(parts)
            for _ in range(changes):
                other[rnd.randrange(len(other))] = rnd.choice(words)
            texts.append(" ".join(other))
        texts.append(prose(rnd, words, 40) + " " + passage + " " + prose(rnd, words, 20))
        texts.append(text + " " + passage)
    texts += ["spam " * 300, "x!! " * 50, "# | * " * 40, "ab" * 3000, "word " * 8 + "other", prose(rnd, words, 12000)]
    texts += [f"password = hunter{k}zz{k} and AKIA{'ABCDEFGH' * 3} or {'0123456789abcdef' * 2}" for k in range(3)]
    return texts


def rows(texts: list[str | None], start: int = 0) -> list[tuple]:
    langs, sources = ["en", "fr", None, "de"], ["a", "a", "a", "b", None]
    return [(start + i, t, langs[i % 4], sources[i % 5], None if t is None else len(t)) for i, t in enumerate(texts)]


def documents(spark, texts: list[str | None]):
    return spark.createDataFrame(rows(texts), SCHEMA).repartition(3)


def shingle_set(text: str | None) -> frozenset:
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) or frozenset([tuple(words)])


def similar(a: frozenset, b: frozenset) -> bool:
    return bool(a and b) and 100 * len(a & b) >= 75 * len(a | b)


def near_components(documents: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """doc_id: (set size, smallest reachable doc_id), by comparing all pairs."""
    sets = {i: shingle_set(t) for i, t in documents}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if similar(sets[a], sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}
