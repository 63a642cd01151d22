"""N-gram Jaccard join by parity sketches: documents whose shingle sets have a similarity of 0.75 or more, and their components.

1. Equal sets are one class, named by a 128-bit digest, so copies of any number meet as one row.
2. Each class XORs its shingles into the blocks of a sketch, per band of sizes. Similar sets differ in at most d shingles, so in at
   most d blocks: their first d + 1 non-empty blocks, in any common order, hold an equal one (shingles.keys). The blocks are joined
   by equality. Frequent blocks, found in a sample of classes, come last in the order; the order cannot change the result.
3. Pairs that meet are tested by odd sketches (one bit flipped a shingle: the Hamming distance never exceeds the symmetric
   difference). What may be similar makes candidate components, and for them only groups of FEW are expanded into all pairs: in others every
   member is tested against the least member of its group and a few before it; then only such groups that still span several components are
   compared across components, by bits, in blocks of GROUP members.
4. Similar classes always lie in one candidate component, so all pairs of classes of a component are tested by sizes, bits and exactly on
   the shingle sets, in pairs of blocks, each pair once (linked). Links are counted there, or returned as pairs (links); a
   forest of them gives the components.

Null and empty texts and such without words have no shingles and stand alone. A text of fewer than five words is one shingle. Repeated
rows give repeated results; a doc_id with several texts is judged by each of them. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reckon.llm import shingles
from reckon.llm.shared import arrow, bitmap, components, in_bitmap, written
from reckon.llm.textbytes import chunks, column, mix

SAMPLE_OF = 32  # one of so many classes tells which blocks are frequent
FREQUENT = 3  # times in the sample
MOST_FREQUENT = 100_000  # so many frequent blocks are sent to the tasks, 1.6 MB
FILTER_BITS = 23
GROUP = 1024
GROUP_SHINGLES = 1 << 20  # in a block whose members bring their sets, 8 MB
PAIRS_AT_ONCE = 250_000
SHINGLES_AT_ONCE = 1 << 20
TOLD = 20_000
STEPS = (1, 2, 4, 8)
FEW = 6  # classes of a key, of which all pairs are hardly more than those of STEPS
NONE = np.zeros(0, np.uint64), np.zeros(0, np.int64)


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _class_ids(one: np.ndarray, two: np.ndarray) -> pa.Array:
    raw = np.column_stack((one, two)).astype("<u8").tobytes()
    return pa.array([raw[i : i + 16] for i in range(0, len(raw), 16)], pa.binary())


def sets_of(documents: DataFrame, load: float = shingles.LOAD) -> DataFrame:
    """The columns but text, n_shingles, class (128 bits), handle (56 of them and the size), sketch, and whether the keys are too few to be sure (short)."""
    own = [name for name in documents.columns if name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(column(batch, "text")):
                found, owner = shingles.shingle_sets(chunk)
                size, one, two = shingles.digests(found, owner, chunk.n)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(column(batch, name).slice(chunk.first, chunk.n) for name in own),
                        pa.array(size, pa.int64()),
                        _class_ids(one, two),
                        _long(shingles.handles(one, size)),
                        pa.array(shingles.odd_sketch(found, owner, size), pa.binary()),
                        pa.array(shingles.unsure(found, owner, size, load)),
                    ],
                    names=[*own, "n_shingles", "class", "handle", "sketch", "short"],
                )

    kinds = ", ".join(f"`{name}` {documents.schema[name].dataType.simpleString()}" for name in own)
    return arrow(documents, run, f"{kinds}, n_shingles long, class binary, handle long, sketch binary, short boolean")


def block_keys(
    documents: DataFrame, hot: np.ndarray, heat: np.ndarray, sample_of: int = 0, load: float = shingles.LOAD
) -> DataFrame:
    """(key, handle) of each class, once a task; with sample_of all keys of one in so many classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for chunk in chunks(column(batch, "text")):
                found, owner = shingles.shingle_sets(chunk)
                size, one, _ = shingles.digests(found, owner, chunk.n)
                own = shingles.handles(one, size)
                for k, handle in enumerate(one.tolist()):
                    if handle in seen or (sample_of and handle % sample_of):
                        size[k] = 0
                    seen.add(handle)
                keys, docs = shingles.keys(found, owner, size, hot, heat, sample_of > 0, load)
                yield pa.RecordBatch.from_arrays([_long(keys), _long(own[docs])], names=["key", "handle"])

    return arrow(documents.select("text"), run, "key long, handle long")


def frequent_keys(documents: DataFrame, load: float = shingles.LOAD) -> tuple[np.ndarray, np.ndarray]:
    """At most MOST_FREQUENT keys that many sampled classes hold, sorted, and their counts."""
    counts = block_keys(documents, *NONE, SAMPLE_OF, load).distinct().groupBy("key").agg(F.count("*").alias("n"))
    rows = counts.where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "key").limit(MOST_FREQUENT).collect()
    keys = np.array([row.key for row in rows], np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.array([row.n for row in rows], np.int64)[order]


def shared_keys(keys: DataFrame) -> DataFrame:
    """(key, handle, hub, whole) of the keys that several classes hold; hub is the least of them.

    Rows come sorted, so a run of one key is passed on row by row, whatever its length. Most keys have but a few classes: of up to
    FEW that lie in one batch come all pairs (handle, hub) instead, marked as whole; nothing of them is left to compare later.
    """

    names = ["key", "handle", "hub", "whole"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row: key, handle, hub, passed on already
        for batch in batches:
            key = column(batch, "key").to_numpy()
            handle = column(batch, "handle").to_numpy()
            if not len(key):
                continue
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (handle[1:] != handle[:-1])
            if held and key[0] == held[0] and handle[0] == held[1]:
                new[0] = False
            key, handle = key[new], handle[new]
            if not len(key):
                continue
            begins = np.ones(len(key), bool)
            begins[1:] = key[1:] != key[:-1]
            runs = np.flatnonzero(begins)
            hub = handle[runs][np.cumsum(begins) - 1]
            out = np.zeros(len(key), bool)
            out[1:] = ~begins[1:]
            out[:-1] |= ~begins[1:]
            members = np.diff(np.append(runs, len(key)))
            few = (members > 1) & (members <= FEW)
            few[-1] = False  # may go on in the next batch
            if held and key[0] == held[0]:
                few[0] = False
            run_of = np.cumsum(begins) - 1
            whole = few[run_of]
            out &= ~whole
            later = [np.flatnonzero(whole[step:] & (run_of[step:] == run_of[:-step])) + step for step in range(1, FEW)]
            at, hubs = np.concatenate(later), np.concatenate([handle[i - step] for step, i in enumerate(later, 1)])
            if held and key[0] == held[0]:
                end = runs[1] if len(runs) > 1 else len(key)
                hub[:end], out[:end] = held[2], True
                if not held[3]:
                    yield pa.RecordBatch.from_arrays([*(pa.array([v], pa.int64()) for v in held[:3]), pa.array([False])], names=names)
            held = int(key[-1]), int(handle[-1]), int(hub[-1]), bool(out[-1])
            rows = (key[out], key[at]), (handle[out], handle[at]), (hub[out], hubs), (np.zeros(out.sum(), bool), np.ones(len(at), bool))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(both)) for both in rows], names=names)

    dealt = keys.repartition("key").sortWithinPartitions("key", "handle")
    return arrow(dealt, run, "key long, handle long, hub long, whole boolean")


def neighbours(shared: DataFrame) -> DataFrame:
    """Pairs (a, b) of handles to try first: of each key every member with the least one and with those some STEPS before it.

    The pairs of whole keys are there already. Those of the others join most of a large group, so that few of its members are left to
    compare across components. Rows are taken as they lie in the table, sorted by key; where a batch ends a few pairs are left out, which
    across() finds. Pairs whose sizes differ too much are left out before any sketch is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, handle, hub = (column(batch, name).to_numpy() for name in ("key", "handle", "hub"))
            a, b = [hub[hub != handle]], [handle[hub != handle]]
            part = ~column(batch, "whole").to_numpy(zero_copy_only=False)
            key, handle = key[part], handle[part]
            for step in STEPS:
                same = np.flatnonzero(key[step:] == key[:-step])
                a.append(handle[same])
                b.append(handle[same + step])
            a, b = np.concatenate(a), np.concatenate(b)
            good = shingles.sizes_allow(a, b)
            a, b = a[good], b[good]
            _, first = np.unique(mix(a.view(np.uint64)) + b.view(np.uint64), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first])], names=["a", "b"])

    return arrow(shared, run, "a long, b long").distinct()


def probable(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of pairs (a, b) of handles, the classes whose sizes and odd sketches allow the similarity."""
    side = lambda s: classes.select(*(F.col(c).alias(f"{c}_{s}") for c in ("handle", "class", "n_shingles", "sketch")))
    both = pairs.join(side("a"), F.col("a") == F.col("handle_a")).join(side("b"), F.col("b") == F.col("handle_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            sketches = column(batch, "sketch_a").to_pylist() + column(batch, "sketch_b").to_pylist()
            size = np.concatenate([column(batch, f"n_shingles_{s}").to_numpy() for s in "ab"])
            good = pa.array(shingles.probable(sketches, size, np.arange(n), np.arange(n, 2 * n)))
            yield pa.RecordBatch.from_arrays([column(batch, f"class_{s}").filter(good) for s in "ab"], names=["a", "b"])

    return arrow(both.drop("a", "b"), run, "a binary, b binary")


def shingles_of(needed: DataFrame, classes: DataFrame, documents: DataFrame) -> DataFrame:
    """(class, shingles) of the classes in needed.

    The documents to read again are marked in a bitmap of 2 ** FILTER_BITS bits, so that no text is shuffled; what it lets through
    besides is dropped by the joins.
    """
    marks = bitmap(needed.join(classes, "class").select(F.xxhash64("rep")), FILTER_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(in_bitmap(marks, column(batch, "h").to_numpy())))
            for chunk in chunks(column(batch, "text")):
                found, owner = shingles.shingle_sets(chunk)
                size, one, two = shingles.digests(found, owner, chunk.n)
                offsets = np.concatenate(([0], np.cumsum(size)))
                sets = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), _long(found))
                yield pa.RecordBatch.from_arrays([_class_ids(one, two), sets], names=["class", "shingles"])

    marked = arrow(documents.select("text", F.xxhash64("doc_id").alias("h")), run, "class binary, shingles array<long>")
    return marked.join(needed, "class", "left_semi").dropDuplicates(["class"])


def _compare(group: np.ndarray, rows: dict[str, list]) -> set[tuple[bytes, bytes]]:
    """Probable pairs of classes within each group of rows, which are sorted by group, between different components."""
    code: dict[bytes, int] = {}
    own = np.array([code.setdefault(c, len(code)) for c in rows["class"]])
    first = np.zeros(len(code), np.int64)
    first[own[::-1]] = np.arange(len(own))[::-1]
    names, sketches = list(code), [rows["sketch"][i] for i in first]
    size = np.array([rows["n_shingles"][i] for i in first])
    root, left, right = np.array(rows["root"]), np.array(rows["left"]), np.array(rows["right"])
    end = np.searchsorted(group, group, "right")
    behind = end - np.arange(len(group)) - 1
    found: set[tuple[bytes, bytes]] = set()
    cuts = np.searchsorted(np.cumsum(behind), np.arange(PAIRS_AT_ONCE, behind.sum() + 1, PAIRS_AT_ONCE))
    for part in np.split(np.arange(len(group)), cuts):
        count = behind[part]
        i = np.repeat(part, count)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
        keep = (root[i] != root[j]) & ((left[i] & right[j]) | (left[j] & right[i]))
        a, b = own[i[keep]], own[j[keep]]
        pair = np.unique(np.minimum(a, b) * len(names) + np.maximum(a, b))
        a, b = pair // len(names), pair % len(names)
        good = (a != b) & shingles.probable(sketches, size, a, b)
        found.update((min(names[x], names[y]), max(names[x], names[y])) for x, y in zip(a[good], b[good], strict=True))
    return found


def _dealt(rows: DataFrame, name: str) -> DataFrame:
    """Rows with a number of blocks for their group `name`, once for each pair of blocks: group, left and right tell the sides."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64("handle"), "blocks"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    return rows.withColumns(
        {
            "group": F.xxhash64(name, F.least("block", "other"), F.greatest("block", "other")),
            "left": F.col("block") <= F.col("other"),
            "right": F.col("block") >= F.col("other"),
        }
    )


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        group = column(batch, "group").to_numpy()
        last = int(np.searchsorted(group, group[-1]))
        if held and column(held[0], "group")[0].as_py() != group[0]:
            yield pa.Table.from_batches(held)
            held = []
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _links(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group that are similar, each pair once; rows are sorted by group."""
    group, size = table["group"].to_numpy(), table["n_shingles"].to_numpy()
    left, right = (table[name].to_numpy().astype(bool) for name in ("left", "right"))
    sketches = table["sketch"].to_pylist()
    sets = table["shingles"].combine_chunks()
    _, flat = np.unique(sets.flatten().to_numpy(), return_inverse=True)
    begin = np.concatenate(([0], np.cumsum(size)))
    marked = np.zeros(int(flat.max(initial=-1)) + 1, bool)
    behind = np.searchsorted(group, group, "right") - np.arange(len(group)) - 1
    cuts = np.searchsorted(np.cumsum(behind), np.arange(PAIRS_AT_ONCE, behind.sum() + 1, PAIRS_AT_ONCE))
    for part in np.split(np.arange(len(group)), cuts):
        count = behind[part]
        i = np.repeat(part, count)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
        keep = (left[i] & right[j]) | (left[j] & right[i])
        i, j = i[keep], j[keep]
        good = shingles.probable(sketches, size, i, j)
        i, j = i[good], j[good]
        if not len(i):
            continue
        common = np.zeros(len(i), np.int64)
        edges = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1])))
        for a, b in zip(edges, np.append(edges[1:], len(i)), strict=True):
            own = flat[begin[i[a]] : begin[i[a] + 1]]
            marked[own] = True
            n = size[j[a:b]]
            for some in np.split(np.arange(a, b), np.searchsorted(np.cumsum(n), np.arange(SHINGLES_AT_ONCE, n.sum() + 1, SHINGLES_AT_ONCE))):
                if len(some):
                    n = size[j[some]]
                    first = np.cumsum(n) - n
                    hits = marked[flat[np.arange(n.sum()) + np.repeat(begin[j[some]] - first, n)]]
                    common[some] = np.add.reduceat(hits, first, dtype=np.int64)
            marked[own] = False
        similar = shingles.OVER * common >= shingles.UNDER * (size[i] + size[j] - common)
        yield i[similar], j[similar]


def _forest(pairs: Iterator[tuple[np.ndarray, np.ndarray]], size: int, total: np.ndarray, n_rows: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join what the pairs join, fewer than size; adds the rows behind each pair to the totals of both sides."""
    root, edges = np.arange(size), []
    for i, j in pairs:
        np.add.at(total, i, n_rows[j])
        np.add.at(total, j, n_rows[i])
        while True:
            x, y = root[i], root[j]
            apart = np.flatnonzero(x != y)
            if not len(apart):
                break
            i, j = i[apart], j[apart]
            low, high = np.minimum(x[apart], y[apart]), np.maximum(x[apart], y[apart])
            hook = np.arange(size)
            np.minimum.at(hook, high, low)
            hooked = np.flatnonzero(hook != np.arange(size))
            edges += list(zip(hooked.tolist(), hook[hooked].tolist(), strict=True))
            while (hook[hook] != hook).any():
                hook = hook[hook]
            root = hook[root]
    return edges


def linked(roots: DataFrame, classes: DataFrame, documents: DataFrame, pairs: bool = False) -> DataFrame:
    """a, b, n: with null b the rows of the classes that class a is similar to, else an edge of a forest that joins all similar classes.

    With pairs instead all similar pairs (a, b) of classes, a < b. roots has components within which all links lie. Components of more
    than GROUP classes or GROUP_SHINGLES shingles are dealt into blocks, each pair of blocks a group of its own; a set is sent once for
    each block of its component, not for each pair.
    """
    named = roots.select(F.col("node").alias("class"), "root").union(roots.select(F.col("root").alias("class"), "root").distinct())
    named = written(named)
    members = named.join(classes.select("class", "handle", "n_shingles", "n_rows", "sketch"), "class")
    blocks = F.greatest(F.ceil(F.count("*") / GROUP), F.ceil(F.sum("n_shingles") / GROUP_SHINGLES))
    rows = _dealt(members.join(members.groupBy("root").agg(blocks.alias("blocks")), "root"), "root")
    rows = rows.select("group", "left", "right", "class", "n_shingles", "n_rows", "sketch")
    rows = rows.join(shingles_of(named.select("class"), classes, documents), "class")
    rows = rows.repartition("group").sortWithinPartitions("group")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches):
            names, n_rows = table["class"].to_pylist(), table["n_rows"].to_numpy()
            if pairs:
                for i, j in _links(table):
                    both = [sorted((names[x], names[y])) for x, y in zip(i, j, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in both], pa.binary()) for k in (0, 1)], names=["a", "b"])
                continue
            total = np.zeros(len(names), np.int64)
            edges = _forest(_links(table), len(names), total, n_rows)
            some = np.flatnonzero(total)
            a = pa.array([*(names[k] for k in some), *(names[x] for x, _ in edges)], pa.binary())
            b = pa.array([*[None] * len(some), *(names[y] for _, y in edges)], pa.binary())
            yield pa.RecordBatch.from_arrays([a, b, pa.array([*total[some].tolist(), *[None] * len(edges)], pa.int64())], names=["a", "b", "n"])

    return arrow(rows, run, "a binary, b binary" + ", n long" * (not pairs))


def across(shared: DataFrame, roots: DataFrame, classes: DataFrame) -> DataFrame:
    """Probable pairs (a, b) of classes that share a key (key, handle) but no component so far.

    Groups of more than GROUP members are dealt into blocks, and each pair of blocks is compared in a group of its own.
    """
    of_handle = classes.join(roots.withColumnRenamed("node", "class"), "class", "left")
    of_handle = of_handle.select("handle", F.xxhash64(F.coalesce("root", "class")).alias("root"))
    own = shared.join(of_handle, "handle")
    spans = own.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("members"))
    spans = spans.where("low != high").select("key", F.ceil(F.col("members") / GROUP).alias("blocks"))
    rows = _dealt(own.join(spans, "key"), "key").select("group", "left", "right", "handle", "root")
    rows = rows.join(classes.select("handle", "class", "n_shingles", "sketch"), "handle")
    rows = rows.drop("handle").repartition("group").sortWithinPartitions("group")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[tuple[bytes, bytes]] = set()

        def compared(table: pa.Table) -> pa.RecordBatch:
            columns = {name: table[name].to_pylist() for name in ("class", "n_shingles", "sketch", "root", "left", "right")}
            pairs = list(_compare(table["group"].to_numpy(), columns) - told) if table.num_rows else []
            if len(told) > TOLD:  # it only spares the shuffle copies
                told.clear()
            told.update(pairs)
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], names=["a", "b"])

        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            group = table["group"].to_numpy()
            last = int(np.searchsorted(group, group[-1])) if len(group) else 0
            yield compared(table.slice(0, last))
            held = table.slice(last).combine_chunks()
        if held is not None:
            yield compared(held)

    return arrow(rows, run, "a binary, b binary").distinct()


def _by_shingles(short: DataFrame, documents: DataFrame) -> DataFrame:
    """Pairs (a, b) of handles that share a shingle, of which a is of a class whose keys are too few to be sure."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(column(batch, "text")):
                found, owner = shingles.shingle_sets(chunk)
                size, one, _ = shingles.digests(found, owner, chunk.n)
                own = shingles.handles(one, size)
                yield pa.RecordBatch.from_arrays([_long(found), _long(own[owner])], names=["shingle", "handle"])

    rows = arrow(documents.select("text"), run, "shingle long, handle long").distinct()
    own = rows.join(short.select("handle").distinct(), "handle", "left_semi").withColumnRenamed("handle", "a")
    pairs = own.join(rows.withColumnRenamed("handle", "b"), "shingle").where("a != b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _candidates(documents: DataFrame, load: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sets of all rows, the classes of equal ones, and components (node, root) of classes within which all similar ones lie."""
    sets = written(sets_of(documents, load))
    filled = sets.where("n_shingles > 0")
    classes = written(
        filled.groupBy("class").agg(
            *(F.min(c).alias(c) for c in ("handle", "n_shingles", "sketch", "short")), F.min("doc_id").alias("rep"), F.count("*").alias("n_rows")
        )
    )
    shared = written(shared_keys(block_keys(documents, *frequent_keys(documents, load), load=load)))
    roots = components(written(probable(neighbours(shared), classes)))
    more = roots.toDF("a", "b").union(across(shared.where("NOT whole").select("key", "handle"), roots, classes))
    if not (short := classes.where("short")).isEmpty():
        more = more.union(probable(_by_shingles(short, documents), classes))
    return sets, classes, components(more)


def _grouped(documents: DataFrame, load: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Sets, classes, the components (node, root) of similar classes, and class, n_linked: the rows of the classes it is similar to."""
    sets, classes, roots = _candidates(documents, load)
    found = written(linked(roots, classes, documents))
    n_linked = found.where("b IS NULL").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("n_linked"))
    return sets, classes, components(found.where("b IS NOT NULL").select("a", "b")), n_linked


def near_duplicates(documents: DataFrame, load: float = shingles.LOAD, n_links: bool = False) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every document.

    load, the shingles a block, trades keys that say more against sets whose blocks are too few; these take the way by shingles.
    With n_links also the number of links of each row: to the rows of similar sets and the other rows of the equal set.
    """
    documents = documents.select("doc_id", "text")
    sets, classes, roots, n_linked = _grouped(documents, load)
    names = ["doc_id", "n_shingles", "component_id"] + ["n_links"] * n_links
    least = classes.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    ids = least.groupBy("root").agg(F.min("rep").alias("component_id"))
    ids = least.select("class", "root", "n_rows").join(ids, "root")
    if n_links:
        ids = ids.join(n_linked, "class", "left")
        ids = ids.withColumn("n_links", F.coalesce("n_linked", F.lit(0)) + F.col("n_rows") - 1)
    filled, bare = sets.where("n_shingles > 0"), sets.where("n_shingles = 0")
    joined = filled.select("doc_id", "n_shingles", "class").join(ids.select("class", *names[2:]), "class").select(*names)
    return joined.unionByName(bare.withColumns({"component_id": F.col("doc_id"), "n_links": F.lit(0).cast("long")}).select(*names))


def row_digest() -> list[Column]:
    """_row, _row2: 128 bits that tell rows of another doc_id or text apart."""
    return [F.xxhash64("doc_id", "text").alias("_row"), F.xxhash64(F.lit(1), "text", "doc_id").alias("_row2")]


def representatives(documents: DataFrame, load: float = shingles.LOAD) -> DataFrame:
    """_row, _row2 of the rows that stand for all: of each component of near duplicates one, and every row without shingles.

    That is the row of the smallest doc_id (null comes last), among texts of one doc_id the one with the least digest. Every text of a
    doc_id is judged on its own; rows that agree in doc_id and text are one row here.
    """
    sets, classes, roots, _ = _grouped(documents.select("doc_id", "text", *row_digest()), load)
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "class", "_row", "_row2")
    of_class = sets.where("n_shingles > 0").groupBy("class").agg(F.min(row).alias("least"))
    of_root = of_class.join(roots.withColumnRenamed("node", "class"), "class", "left").groupBy(F.coalesce("root", "class").alias("root"))
    kept = of_root.agg(F.min("least").alias("least")).select("least._row", "least._row2")
    return kept.union(sets.where("n_shingles = 0").select("_row", "_row2").distinct())


def links(documents: DataFrame, load: float = shingles.LOAD) -> tuple[DataFrame, DataFrame]:
    """All similar pairs (a, b) of different classes, a < b, and the class of every row: doc_id, n_shingles, class.

    Rows of one class are linked too. Rows without shingles are in no class.
    """
    documents = documents.select("doc_id", "text")
    sets, classes, roots = _candidates(documents, load)
    return linked(roots, classes, documents, pairs=True), sets.where("n_shingles > 0").select("doc_id", "n_shingles", "class")


def op4_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{folder}/documents.parquet"), n_links=True)
