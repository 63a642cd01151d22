"""Secret scan in DataFrame functions: pattern spans, and candidate strings whose sliding-window entropy is high.

The base kinds are matched leftmost and without overlap; matches that are too short are dropped afterwards. The entropy kind takes
runs of key characters, sorts them into a character class (hex, alnum, base64, mixed), slides a window of WINDOW characters over them and
updates its Shannon entropy from the counts of the character that enters and the one that leaves. A run whose best window
reaches the class's bound is a secret unless an allow-list pattern matches it. Of a run that is none, the pieces between separators
are judged in the same way, each alone, so that a path, a name or a word beside a key does not hide it.

Positions are code points, ends exclusive. They come from the lengths of the matches and of the gaps between them. Null and empty
texts have no spans. A text is handled in its own row, whatever its length: no pattern repeats a group, the entropy of a run takes time in
proportion to its length, the list of n matches that of n * sqrt(n). Repeated rows give repeated results. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The base kinds, (pattern, group that is measured, least length).
KINDS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),  # the same as runs of any length of which those below 24 are dropped
}
WINDOW = 20
AT_ONCE = 1000
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
PIECE = rf"[A-Za-z0-9]{{{WINDOW},}}"  # of a candidate, between separators
SEPARATOR = r"[+/_=-]"
# (class, pattern of all its strings, least bits a character); the first that fits counts.
CLASSES = (
    ("hex", r"^(?=.*[0-9])(?=.*[a-fA-F])[0-9a-fA-F]+$", 3.0),
    ("alnum", r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9]+$", 3.6),
    ("base64", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z]).+$", 3.8),
    ("mixed", r"^(?=.*[0-9])(?=.*[A-Za-z]).+$", 3.8),  # letters of one case, digits and separators
)
ALLOWED = (
    # whole words: between characters that are no letters or digits, or capitalised after a small letter
    r"(?<![A-Za-z0-9])(?i:example|sample|dummy|placeholder|changeme|redacted|test)(?![A-Za-z0-9])",
    r"(?<=[a-z])(?:Example|Sample|Dummy|Placeholder|Changeme|Redacted|Test)(?![a-z])",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",  # UUIDs
    r"(?i)0123456789|abcdefgh|qwerty",
    r"^[A-Za-z][A-Za-z/_=+-]*+[0-9]{0,4}$",  # words in a path or a name with a number
    # of the mixed class only: words and short numbers between separators; a UUID among words
    r"^(?!.*(?:[A-Za-z][0-9]|[0-9][A-Za-z]|[0-9]{5}))(?:[a-z0-9+/_=-]+|[A-Z0-9+/_=-]+)$",
    r"^(?:[a-z+/_=-]*[+/_=-])?[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}(?:[+/_=-][a-z+/_=-]*)?$",
)
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
MATCH = "struct<start:int,end:int,from:int,to:int,match:string,inner:string>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it in folds."""
    return F.transform(F.array(value), body)[0]


def _running(items: Column, zero: Column, step: Callable, out: Callable, kind: str) -> Column:
    """out(state, item) of every item, state being what step has made of zero and the items before.

    An array that grows item by item is copied each time, so items are taken in about sqrt(n) blocks: one fold passes the state from
    block to block, then each block collects its own results.
    """

    def blocked(items: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(items))).cast("int"), F.lit(1))
        numbers = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(items) / size).cast("int") - 1, F.lit(0)))
        blocks = F.transform(numbers, lambda k: F.slice(items, k * size + 1, size))
        return _let(blocks, collected)

    def collected(blocks: Column) -> Column:
        begins = F.aggregate(
            blocks,
            F.struct(zero.alias("state"), F.slice(F.array(zero), 1, 0).alias("all")),
            lambda s, block: F.struct(F.aggregate(block, s["state"], step).alias("state"), F.concat(s["all"], F.array(s["state"])).alias("all")),
        )["all"]
        each = lambda z: F.aggregate(
            z["block"],
            F.struct(z["begin"].alias("state"), F.array().cast(f"array<{kind}>").alias("all")),
            lambda s, item: F.struct(step(s["state"], item).alias("state"), F.concat(s["all"], F.array(out(s["state"], item))).alias("all")),
        )["all"]
        return F.flatten(F.transform(F.arrays_zip(blocks.alias("block"), begins.alias("begin")), each))

    return _let(items, blocked)


def _matches(text: Column, pattern: str, group: int) -> Column:
    """(start, end, from, to, match, group) of all matches of a pattern without empty matches; from and to count bytes."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.split(text, pattern, -1)
    pairs = F.arrays_zip(gaps.alias("gap"), found.alias("match"), inner.alias("inner"))
    pairs = F.slice(pairs, 1, F.size(found))  # the text after the last match is a gap without one
    start = lambda s, p: s["at"] + F.length(p["gap"])
    begin = lambda s, p: s["byte"] + F.octet_length(p["gap"])
    end = lambda s, p: start(s, p) + F.length(p["match"])
    stop = lambda s, p: begin(s, p) + F.octet_length(p["match"])
    row = lambda s, p: F.struct(
        start(s, p).alias("start"), end(s, p).alias("end"), begin(s, p).alias("from"), stop(s, p).alias("to"),
        p["match"].alias("match"), p["inner"].alias("inner"),
    )
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("byte"))
    listed = _running(pairs, zero, lambda s, p: F.struct(end(s, p).alias("at"), stop(s, p).alias("byte")), row, MATCH)
    return F.when(text.rlike(pattern), listed).otherwise(F.array().cast(f"array<{MATCH}>"))


def best_entropy(candidate: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy, in bits a character, of any window of a string of ALPHABET characters, at least `window` long.

    The fold keeps the counts of the window's characters and the sum of n * log2(n) over them; a step changes two counts. Counts have five
    bits, twelve in a long (window is below 32), so that a step copies few numbers.
    """
    weight = [n * math.log2(n) if n else 0.0 for n in range(window + 2)]
    up = F.array(*[F.lit(weight[n + 1] - weight[n]) for n in range(window + 1)])  # by n + 1: what one more of n adds
    down = F.array(*[F.lit(weight[max(n - 1, 0)] - weight[n]) for n in range(window + 1)])
    words = -(-(len(ALPHABET) + 1) // 12)
    none = F.lit(0).cast("long")

    def symbol(character: Column) -> Column:
        number = F.instr(F.lit(ALPHABET), character)
        shift = (number % 12) * 5
        one = F.call_function("shiftleft", F.lit(1).cast("long"), shift)
        return F.struct(number.alias("number"), F.floor(number / 12).cast("int").alias("word"), shift.alias("shift"), one.alias("one"))

    def fold(symbols: Column) -> Column:
        # stands for the character that leaves before the first window is full
        nothing = F.struct(*(F.lit(0).cast(kind).alias(name) for name, kind in (("number", "int"), ("word", "int"), ("shift", "int"), ("one", "long"))))
        pairs = F.transform(
            symbols,
            lambda x, i: F.struct(x.alias("new"), F.coalesce(F.get(symbols, i - window), nothing).alias("old"), (i >= window - 1).alias("full")),
        )
        count = lambda state, x: F.call_function("shiftrightunsigned", F.element_at(state["counts"], x["word"] + 1), x["shift"]).bitwiseAND(F.lit(31))

        def step(state: Column, x: Column) -> Column:
            new, old = x["new"], x["old"]
            left = F.when(old["number"] == 0, 0.0).otherwise(F.element_at(down, count(state, old).cast("int") + 1))
            entered = F.element_at(up, count(state, new).cast("int") + 1)
            total = F.when(new["number"] == old["number"], state["total"]).otherwise(state["total"] + entered + left)
            counts = F.transform(
                state["counts"], lambda c, k: c + F.when(k == new["word"], new["one"]).otherwise(none) - F.when(k == old["word"], old["one"]).otherwise(none)
            )
            return F.struct(counts.alias("counts"), total.alias("total"), F.when(x["full"], F.least(state["least"], total)).otherwise(state["least"]).alias("least"))

        start = F.struct(F.array_repeat(none, words).alias("counts"), F.lit(0.0).alias("total"), F.lit(math.inf).alias("least"))
        return F.lit(math.log2(window)) - F.aggregate(pairs, start, step)["least"] / window

    characters = F.filter(F.split(candidate, ""), lambda c: c != "")
    return _let(F.transform(characters, symbol), fold)


def _is_secret(candidate: Column) -> Column:
    bound = F.lit(None).cast("double")
    for _, pattern, least in reversed(CLASSES):
        bound = F.when(candidate.rlike(pattern), F.lit(least)).otherwise(bound)
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | candidate.rlike(pattern)
    # Windows begin in blocks of so many characters; the first block with a window that reaches the bound decides.
    blocks = F.regexp_extract_all(candidate, F.lit(f"(?=(.{{1,{AT_ONCE + WINDOW - 1}}})).{{1,{AT_ONCE}}}"), F.lit(1))
    reaches = lambda bound: F.exists(blocks, lambda block: (F.length(block) >= WINDOW) & (best_entropy(block) >= bound))
    return _let(bound, lambda bound: F.when(bound.isNull() | allowed, F.lit(False)).otherwise(reaches(bound)))


def _entropy_spans(body: Column, rank: int) -> Column:
    """Spans of the runs that are secrets, and of those pieces of the other runs that are."""

    def span(m: Column, start: Column, begin: Column) -> Column:
        return F.struct(
            (start + m["start"]).alias("start"), F.lit(rank).alias("rank"), (start + m["end"]).alias("end"), F.lit("entropy").alias("kind"),
            (begin + m["from"]).alias("from"), (begin + m["to"]).alias("to"),
        )

    def found(run: Column) -> Column:
        pieces = F.filter(_matches(run["match"], PIECE, 0), lambda p: _is_secret(p["match"]))
        pieces = F.transform(pieces, lambda p: span(p, run["start"], run["from"]))
        whole = F.array(span(run, F.lit(0), F.lit(0)))
        return F.when(_is_secret(run["match"]), whole).otherwise(F.when(run["match"].rlike(SEPARATOR), pieces).otherwise(F.slice(whole, 1, 0)))

    return F.flatten(F.transform(_matches(body, CANDIDATE, 0), found))


def _spans(rows: Column, kind: str, rank: int) -> Column:
    return F.transform(
        rows,
        lambda m: F.struct(
            m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"),
            m["from"].alias("from"), m["to"].alias("to"),
        ),
    )


def _at_least(least: int) -> Callable[[Column], Column]:
    return lambda m: F.length(m["inner"]) >= least


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(documents: DataFrame, text: str = "text") -> DataFrame:
    """All columns of documents and `_base` and `_all`: the sorted spans (start, rank of the kind, end, kind; from, to in bytes) of every row."""
    body = F.coalesce(F.col(text), F.lit(""))
    base = []
    for rank, (kind, (pattern, group, least)) in enumerate(KINDS.items()):
        base.append(_spans(F.filter(_matches(body, pattern, group), _at_least(least)), kind, rank))
    documents = documents.withColumns({"_base": F.array_sort(F.concat(*base)), "_entropy": _entropy_spans(body, len(KINDS))})
    return documents.withColumn("_all", F.array_sort(F.concat("_base", "_entropy"))).drop("_entropy")


def redact(documents: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span replaced by the mark; overlapping spans become one. Null stays null, other texts stay as they are."""
    body = F.col(text)
    raw = body.cast("binary")  # cut by bytes; positions of characters would be counted from the start each time
    part = lambda s, x: F.when(
        x["from"] >= s, F.concat(F.substring(raw, s + 1, x["from"] - s).cast("string"), F.lit(mark))
    ).otherwise(F.lit(""))
    parts = _running(F.col("_all"), F.lit(0), lambda s, x: F.greatest(s, x["to"]), part, "string")
    last = F.array_max(F.transform("_all", lambda x: x["to"]))
    rest = F.substring(raw, last + 1, F.octet_length(body)).cast("string")
    clean = F.array_join(F.concat(parts, F.array(rest)), "")
    found = scan(documents, text)
    return found.withColumn(text, F.when(F.size("_all") > 0, clean).otherwise(body)).drop("_base", "_all")


def op6_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    digest = F.sha2(_joined(F.col("_base")), 256).alias("base_sha256")
    return found.select("doc_id", *(count(kind) for kind in KINDS), digest, _joined(F.col("_all")).alias("spans"))
