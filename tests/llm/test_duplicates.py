"""Near duplicates and repeated strings against plain versions."""

import hashlib
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from fixtures import SCHEMA, awkward_texts, documents, near_components, prose, rows, shingle_set, similar, vocabulary

from reckon.llm import near, repeats, shingles
from reckon.llm.anchors import segments
from reckon.llm.shared import components
from reckon.llm.textbytes import chunks, mix

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts():
    return awkward_texts()


def found_components(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_near_duplicates(spark, texts):
    docs = documents(spark, texts).withColumnRenamed("lang", "component_id")
    assert found_components(near.near_duplicates(docs)) == near_components(list(enumerate(texts)))


def test_near_duplicates_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert found_components(near.op4_near_duplicates(spark, SF)) == near_components([(r.doc_id, r.text) for r in docs.collect()])


def variants(seed: int, n: int, changes: int, size: int = 80) -> list[str]:
    """A chain of texts, each a little different from the one before, so that distant ones are not similar."""
    rnd, words = random.Random(seed), vocabulary(seed)
    parts = prose(rnd, words, size).split(" ")
    out = []
    for _ in range(n):
        for _ in range(changes):
            parts[rnd.randrange(len(parts))] = rnd.choice(words)
        out.append(" ".join(parts))
    return out


def test_groups_beyond_a_block(spark, monkeypatch):
    """Large groups are compared in blocks, and chains are followed to their end."""
    monkeypatch.setattr(near, "GROUP", 7)
    monkeypatch.setattr(near, "PAIRS_AT_ONCE", 50)
    texts = variants(1, 40, 1) + variants(2, 30, 2) + variants(3, 20, 0)
    docs = spark.createDataFrame(rows(texts), SCHEMA).repartition(4)
    assert found_components(near.near_duplicates(docs)) == near_components(list(enumerate(texts)))


@pytest.mark.parametrize("batch", [3, 50, 2000])
def test_few_classes_of_a_key_are_paired_at_once(spark, settings, batch):
    """Every key with several classes comes as all its pairs, or as all its members with the least one; most small ones as pairs."""
    settings(spark__sql__execution__arrow__maxRecordsPerBatch=str(batch))
    rnd = random.Random(batch)
    groups = {k: {rnd.randrange(10**6) for _ in range(rnd.choice([1, 1, 2, 2, 3, 6, 7, 40]))} for k in range(400)}
    keys = [(k, h) for k, members in groups.items() for h in members for _ in range(rnd.choice([1, 1, 2]))]
    rnd.shuffle(keys)
    found = defaultdict(list)
    for r in near.shared_keys(spark.createDataFrame(keys, "key long, handle long")).collect():
        found[r.key].append((r.handle, r.hub, r.whole))
    assert set(found) == {k for k, members in groups.items() if len(members) > 1}
    small = [k for k in found if len(groups[k]) <= near.FEW]
    for k, out in found.items():
        if all(whole for *_, whole in out):
            pairs = [(a, b, True) for a in groups[k] for b in groups[k] if a > b]
        else:
            pairs = [(a, min(groups[k]), False) for a in groups[k]]
        assert sorted(out) == sorted(pairs)
        assert len(groups[k]) <= near.FEW or not out[0][2]
    assert batch < 50 or sum(found[k][0][2] for k in small) > 0.8 * len(small)


def all_links(documents):
    """Similar pairs of rows, by comparing all of them."""
    sets = [shingle_set(text) for _, text in documents]
    return [(i, j) for i in range(len(sets)) for j in range(i) if similar(sets[i], sets[j])]


@pytest.mark.parametrize("group", [1024, 7])
def test_every_link_is_counted(spark, monkeypatch, texts, group):
    """Also those within a component, of one block or several, and of equal sets."""
    monkeypatch.setattr(near, "GROUP", group)
    monkeypatch.setattr(near, "PAIRS_AT_ONCE", 50)
    monkeypatch.setattr(near, "SHINGLES_AT_ONCE", 300)
    bodies = texts + variants(1, 40, 1) + variants(2, 30, 2) + variants(3, 20, 0)
    docs = documents(spark, bodies)
    expected = all_links(list(enumerate(bodies)))
    counts = Counter(k for pair in expected for k in pair)
    out = near.near_duplicates(docs, n_links=True).collect()
    assert {r.doc_id: r.n_links for r in out} == {i: counts[i] for i in range(len(bodies))}
    pairs, members = near.links(docs)
    of = defaultdict(list)
    for row in members.collect():
        of[bytes(row["class"])].append(row.doc_id)
    found = [(bytes(r.a), bytes(r.b)) for r in pairs.collect()]
    assert len(found) == len(set(found)) and all(a < b for a, b in found)
    rows_linked = {(max(x, y), min(x, y)) for a, b in found for x in of[a] for y in of[b]}
    rows_linked |= {(max(x, y), min(x, y)) for ids in of.values() for x in ids for y in ids if x != y}
    assert rows_linked == set(expected)


def test_too_few_blocks(spark):
    """Sketches that are too coarse to be sure fall back on shingles."""
    texts = variants(4, 12, 1, 40) + variants(5, 12, 2, 40)
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    assert near.sets_of(docs, load=50_000).where("short").count() > 10
    assert found_components(near.near_duplicates(docs, load=50_000)) == near_components(list(enumerate(texts)))


def test_empty_and_unnamed(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near.near_duplicates(empty).count() == 0
    assert repeats.Repeats(empty).removed().count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f", None, None, None), (5, "a b c d e f", None, None, None), (5, "a b c d e f", None, None, None)], SCHEMA)
    assert sorted((r.doc_id is None, r.n_shingles, r.component_id) for r in near.near_duplicates(odd).collect()) == [
        (False, 2, 5), (False, 2, 5), (True, 2, 5),
    ]


def test_common_block_in_every_order():
    """Whatever keys are hot, similar sets keep a common key."""
    rnd = random.Random(9)
    for trial in range(60):
        n = rnd.choice([3, 5, 20, 60, 63, 64, 90, 127, 128, 170, 400])
        words = [f"w{rnd.randrange(10**9)}" for _ in range(n + 4)]
        other = list(words)
        while True:
            k = rnd.randrange(len(other))
            before = list(other)
            other[k] = f"v{rnd.randrange(10**9)}"
            if rnd.random() < 0.3:
                other.append(f"u{rnd.randrange(10**9)}")
            if not similar(shingle_set(" ".join(words)), shingle_set(" ".join(other))):
                other = before
                break
        (chunk,) = chunks(pa.array([" ".join(words), " ".join(other)]))
        found, owner = shingles.shingle_sets(chunk)
        size, *_ = shingles.digests(found, owner, 2)
        everything, docs = shingles.keys(found, owner, size, *near.NONE, whole=True)
        hot = np.unique(everything[np.random.default_rng(trial).random(len(everything)) < 0.5])
        heat = np.random.default_rng(trial).integers(1, 90, len(hot))
        if shingles.unsure(found, owner, size).any():
            continue
        for order in (near.NONE, (hot, heat)):
            keys, docs = shingles.keys(found, owner, size, *order)
            assert set(keys[docs == 0]) & set(keys[docs == 1]) or similar(*(frozenset(found[owner == d]) for d in (0, 1))) and size[0] == size[1] and (
                set(found[owner == 0]) == set(found[owner == 1])
            )
        a, b = (frozenset(found[owner == d]) for d in (0, 1))
        sketches = shingles.odd_sketch(found, owner, size)
        assert shingles.probable(sketches, size, np.array([0]), np.array([1])).all() == similar(a, b)


@pytest.mark.parametrize("seed", range(4))
def test_forest_joins_what_the_pairs_join(seed):
    rng = np.random.default_rng(seed)
    size = 200
    pairs = [(rng.integers(0, size, n), rng.integers(0, size, n)) for n in (60, 0, 50, 40)]
    pairs = [(i[i != j], j[i != j]) for i, j in pairs]
    n_rows, total = rng.integers(1, 9, size), np.zeros(size, np.int64)
    edges = near._forest(iter(pairs), size, total, n_rows)
    expected = np.zeros(size, np.int64)
    root, forest = list(range(size)), list(range(size))

    def find(of, x):
        while of[x] != x:
            x = of[x]
        return x

    for i, j in pairs:
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            expected[x] += n_rows[y]
            expected[y] += n_rows[x]
            root[find(root, x)] = find(root, y)
    for x, y in edges:
        assert find(forest, x) != find(forest, y)  # no edge too many
        forest[find(forest, x)] = find(forest, y)
    groups = [{frozenset(y for y in range(size) if find(of, y) == find(of, x)) for x in range(size)} for of in (root, forest)]
    assert groups[0] == groups[1] and (total == expected).all()


def test_components(spark):
    rnd = random.Random(4)
    links = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(40)] + [(100 + k, 101 + k) for k in range(50)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    out = components(spark.createDataFrame(links, "a long, b long"))
    got = {r.node: r.root for r in out.collect()}
    linked = {x for a, b in links for x in (a, b) if a != b}
    assert got == {x: find(x) for x in linked if find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def removed_plainly(texts, length):
    counts = Counter()
    data = [(t or "").encode() for t in texts]
    for d in data:
        counts.update(d[i : i + length] for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if counts[d[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
        kept = np.frombuffer(d, np.uint8)[~gone].tobytes()
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def pieces(seed: int) -> list[str]:
    rnd = random.Random(seed)
    alphabet = rnd.choice(["ab", "abcdefgh", "a", "abc"])
    base = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(3)]
    texts = []
    for _ in range(12):
        text = ""
        for _ in range(rnd.randint(0, 3)):
            piece = rnd.choice(base)
            a = rnd.randint(0, len(piece))
            text += piece[a : rnd.randint(a, len(piece))] + "".join(rnd.choice(alphabet + "é") for _ in range(rnd.randint(0, 4)))
        texts.append(text)
    return texts


@pytest.mark.parametrize("seed", range(60))
def test_covers_of_segments(seed):
    length, gram = [(12, 6), (10, 4), (20, 10)][seed % 3]
    texts = pieces(seed)
    (chunk,) = chunks(pa.array(texts, pa.string()))
    cut = segments(chunk, length, gram)
    raw = chunk.data.tobytes()
    groups, times = defaultdict(dict), Counter(cut.segment.tolist())
    for k in range(len(cut.doc)):
        groups[int(cut.gram[k])][int(cut.segment[k])] = (int(cut.offset[k]), raw[cut.start[k] : cut.end[k]])
    covered = {name: (0, repeats.WHOLE) for name, n in times.items() if n > 1}
    for members in groups.values():
        if len(members) > 1:
            for name, lo, hi in zip(members, *repeats.covers(list(members.values()), length, gram), strict=True):
                if hi > lo:
                    covered.setdefault(name, (lo, hi))
    gone = np.zeros(len(raw), bool)
    for k, name in enumerate(cut.segment.tolist()):
        if name in covered:
            lo, hi = covered[name]
            gone[cut.start[k] + lo : min(cut.start[k] + hi, cut.end[k])] = True
    for d, (_, n_removed, _, digest) in enumerate(removed_plainly(texts, length)):
        own = slice(chunk.offsets[d], chunk.offsets[d + 1])
        assert gone[own].sum() == n_removed
        assert hashlib.sha256(chunk.data[own][~gone[own]].tobytes()).hexdigest() == digest


def test_intervals_of_a_suffix_array():
    text = b"banana$bandana$"
    suffixes = [text[i:] for i in range(len(text))]
    order = sorted(range(len(text)), key=suffixes.__getitem__)
    prefixes = repeats.common_prefixes(suffixes, order, len(text))
    found = {(n, a, b) for n, a, b in repeats.intervals(prefixes) if b > a}
    for n, a, b in found:
        shared = {suffixes[order[k]][:n] for k in range(a, b + 1)}
        assert len(shared) == 1 and all(n <= prefixes[k] for k in range(a + 1, b + 1)) and n in prefixes[a + 1 : b + 1]
    strings = {suffixes[order[a]][:n] for n, a, _ in found}
    assert {b"ana", b"an", b"a", b"ban", b"na", b"n"} <= strings


def rows_of(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


@pytest.mark.parametrize("group", [2, 10_000])
def test_repeats(spark, group):
    """Both ways of comparing the segments of a gram."""
    texts = pieces(1) + pieces(5) + pieces(7) + [None, "", "ab" * 200, "abc" * 100]
    docs = documents(spark, texts).withColumnRenamed("lang", "n_bytes")
    job = repeats.Repeats(docs, length=12, gram=6, group=group)
    assert rows_of(job.removed()) == dict(enumerate(removed_plainly(texts, 12)))


def test_repeats_of_awkward_texts(spark, texts):
    job = repeats.Repeats(documents(spark, texts))
    out = job.removed(with_text=True)
    expected = removed_plainly(texts, repeats.LENGTH)
    assert rows_of(out) == dict(enumerate(expected))
    for row in out.collect():
        if row.n_removed == 0:
            assert row.text == (texts[row.doc_id] or "")


def test_repeated_rows_are_documents(spark):
    long = "x".join(str(k) for k in range(300))
    docs = spark.createDataFrame([(1, long, None, None, 0), (1, long, None, None, 0), (None, long + "!", None, None, 0)], SCHEMA)
    out = sorted((r.n_bytes, r.n_removed) for r in repeats.Repeats(docs).removed().collect())
    assert out == [(len(long), len(long)), (len(long), len(long)), (len(long) + 1, len(long))]


def test_handles_tell_sizes_that_cannot_be_similar(spark):
    """No pair of sizes within the threshold is left out; pairs far apart bring no sketch into a shuffle."""
    size = np.arange(1, 3000)
    handle = shingles.handles(np.random.default_rng(1).integers(0, 1 << 63, len(size), dtype=np.uint64) * np.uint64(2), size).view(np.int64)
    for i in range(0, len(size), 7):
        near_by = shingles.OVER * np.minimum(size, size[i]) >= shingles.UNDER * np.maximum(size, size[i])
        allowed = shingles.sizes_allow(np.full(len(size), handle[i]), handle)
        assert allowed[near_by].all()
        assert not allowed[(size > 2 * size[i]) | (2 * size < size[i])].any()
    small, large, other = (int(handle[k - 1]) for k in (40, 200, 45))
    rows = [(1, small, small, False), (1, large, small, False), (1, other, small, False)]
    shared = spark.createDataFrame(rows, "key long, handle long, hub long, whole boolean").coalesce(1)
    assert {frozenset(r) for r in near.neighbours(shared).collect()} == {frozenset((small, other))}


def test_shuffled_keys_and_sketches_are_short():
    """A key has 48 bits, a sketch two bits a shingle at most."""
    rng = np.random.default_rng(2)
    for n in (20, 100, 700):
        found = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        owner, size = np.zeros(len(found), np.int64), np.array([len(found)])
        keys, _ = shingles.keys(found, owner, size, *near.NONE)
        assert len(keys) and not (keys & np.uint64(0xFFFF)).any()
        (sketch,) = shingles.odd_sketch(found, owner, size)
        assert 8 * len(sketch) <= max(2 * n, 32)


def test_memory_of_exact_tests_is_bounded():
    """A block of large sets is tested in small parts: a task's arrays stay below a few times the block."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 2000)
    sets = [np.unique(np.concatenate((base[: 2000 - k % 50], rng.integers(0, 1 << 62, k % 50)))) for k in range(700)]
    size = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets).view(np.uint64), np.repeat(np.arange(len(sets)), size)
    columns = {
        "group": pa.array(np.zeros(len(sets), np.int64)),
        "n_shingles": pa.array(size),
        "left": pa.array(np.ones(len(sets), bool)),
        "right": pa.array(np.ones(len(sets), bool)),
        "sketch": pa.array(shingles.odd_sketch(flat, owner, size), pa.binary()),
        "shingles": pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), pa.array(flat.view(np.int64))),
    }
    table = pa.table(columns)
    tracemalloc.start()
    n = sum(len(i) for i, _ in near._links(table))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(sets) * (len(sets) - 1) // 2
    assert most < 8 * flat.nbytes


def test_parts_without_a_pair_are_passed_over(monkeypatch):
    """A part of a component's pairs of which none may be similar."""
    monkeypatch.setattr(near, "PAIRS_AT_ONCE", 1)
    a, b = np.arange(0, 60), np.arange(1000, 1060)
    sets = [mix(s.astype(np.uint64)) for s in (a, b, a)]
    flat, owner, size = np.concatenate(sets), np.repeat(np.arange(3), 60), np.full(3, 60)
    table = pa.table(
        {
            "group": pa.array(np.zeros(3, np.int64)),
            "n_shingles": pa.array(size),
            "left": pa.array(np.ones(3, bool)),
            "right": pa.array(np.ones(3, bool)),
            "sketch": pa.array(shingles.odd_sketch(flat, owner, size), pa.binary()),
            "shingles": pa.ListArray.from_arrays(pa.array(np.arange(0, 181, 60), pa.int32()), pa.array(flat.view(np.int64))),
        }
    )
    assert [(i, j) for x, y in near._links(table) for i, j in zip(x.tolist(), y.tolist(), strict=True)] == [(0, 2)]
