"""Exact top-k inner products by KD-trees.

1. Vectors are dealt into shards of about SHARD vectors: by their length, by regions of space (median splits of a bounded sample) and,
   within a region, by hash. Queries are searched among the vectors of their own length.
2. Each shard builds a KD-tree: median splits along the widest side, every node with its tight bounding box. A query visits nodes best
   first, by their bound (for each dimension the larger product with the box's sides), and ends when no bound reaches its kth score;
   queries that are at the same node are computed together.
3. Every query searches the shard it would lie in first. Its kth score then goes with it to the other shards, and only to regions whose box reaches that
   score. Boxes of regions are few: MOST_REGIONS at most, and BOX_VALUES numbers in all.
4. A shard with many queries is sent to several tasks, each with up to QUERIES of them, so no task holds more than a shard and a block.

Vectors that are null, empty or hold null or non-finite components take no part, nor do rows without vec_id. Rows that share a vec_id are rows of
their own: each is a candidate of the other, and a query of its own. Queries are a stated set; no row meets row. k may exceed the
number of candidates: then all are returned. Ties go to the smaller vec_id. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reckon.llm.shared import arrow, written
from reckon.llm.textbytes import column

SHARD = 16_384
BLOCK = 512
QUERIES = 8_192  # sent to one task with a copy of the shard
LEAF = 256
SCALE = 64
SAMPLE = 4_096  # vectors that place the regions; they decide where vectors lie, not what is found
MOST_REGIONS = 512
BOX_VALUES = 1 << 20
PLACE = ["length", "region", "part"]


@dataclass
class Tree:
    """A KD-tree: boxes and children of its nodes, the root first; a leaf has no children and holds vectors [begin, end)."""

    rows: np.ndarray
    ids: np.ndarray
    vectors: np.ndarray
    low: np.ndarray
    high: np.ndarray
    children: np.ndarray
    begin: np.ndarray
    end: np.ndarray


def build(rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, leaf: int | None = None) -> Tree:
    """Median splits until a part has at most `leaf` vectors or only equal ones; the members of a node lie together."""
    leaf = leaf or LEAF
    order = np.arange(len(ids))
    begin, end, low, high, children = [0], [len(ids)], [], [], []
    node = 0
    while node < len(begin):
        a, b = begin[node], end[node]
        part = vectors[order[a:b]]
        low.append(part.min(0))
        high.append(part.max(0))
        spread = high[-1] - low[-1]
        children.append(-1)
        if b - a > leaf and spread.any():
            middle = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(part[:, spread.argmax()], middle)]
            children[-1] = len(begin)  # the second child follows the first
            begin += [a, a + middle]
            end += [a + middle, b]
        node += 1
    nodes = (np.array(x) for x in (low, high, children, begin, end))
    return Tree(rows[order], ids[order], vectors[order], *nodes)


def _bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The largest inner product that each query can have in each box."""
    return np.maximum(queries, 0) @ high.T.astype(float) + np.minimum(queries, 0) @ low.T.astype(float)


def search(tree: Tree, query_rows: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(number of the query, vec_id, score) of the k best of each query in the tree that reach its kth score, ties to the smaller id; and how
    many pairs of a query and a leaf were computed."""
    wanted = queries.astype(float)  # products of whole numbers below 2 ** 53 are exact
    points = tree.vectors.astype(float)
    n, visits = len(queries), 0
    kth = kth.astype(float).copy()
    scores, found = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
    frontier = np.full((n, len(tree.begin)), -np.inf)
    frontier[:, :1] = _bounds(wanted, tree.low[:1], tree.high[:1])
    todo = np.arange(n)
    while len(todo):
        node = frontier[todo].argmax(1)
        best = frontier[todo, node]
        goes_on = (best > -np.inf) & (best >= kth[todo])  # a tie may hold a smaller id
        todo, node = todo[goes_on], node[goes_on]
        frontier[todo, node] = -np.inf
        order = np.argsort(node, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(node[order])) + 1) if len(order) else ():
            at, who = int(node[own[0]]), todo[own]
            child = int(tree.children[at])
            if child >= 0:
                frontier[who, child : child + 2] = _bounds(wanted[who], tree.low[child : child + 2], tree.high[child : child + 2])
                continue
            a, b = int(tree.begin[at]), int(tree.end[at])
            visits += len(who)
            new = wanted[who] @ points[a:b].T
            new[query_rows[who][:, None] == tree.rows[None, a:b]] = -np.inf
            every = np.concatenate((scores[who], new), axis=1)
            names = np.concatenate((found[who], np.broadcast_to(tree.ids[a:b], new.shape)), axis=1)
            kept = np.lexsort((names, -every), axis=1)[:, :k]
            scores[who], found[who] = np.take_along_axis(every, kept, 1), np.take_along_axis(names, kept, 1)
            kth[who] = np.maximum(kth[who], scores[who, k - 1])
    row, place = np.nonzero((scores > -np.inf) & (scores >= kth[:, None]))
    return row, found[row, place], scores[row, place].astype(np.int64), visits


def quantised(embeddings: DataFrame, vector: str = "embedding", key: str = "vec_id", scale: int = SCALE) -> DataFrame:
    """(id, vector): floor(scale * x) of every component; rows that share an id stay rows of their own."""
    whole = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.col(key).isNotNull()
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    cells = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return embeddings.where(whole).where(finite).select(F.col(key).cast("long").alias("id"), cells.alias("vector"))


def _matrix(batch: pa.RecordBatch | pa.Table, rows: np.ndarray) -> np.ndarray:
    """The vectors of some rows, which have one length."""
    vectors = batch["vector"] if isinstance(batch, pa.Table) else column(batch, "vector")
    vectors = vectors.take(pa.array(rows))
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


@dataclass
class Splits:
    """Median splits of space: the root first; a side >= 0 is a further split, below 0 the region -1 - side."""

    dimension: np.ndarray
    value: np.ndarray
    sides: np.ndarray

    def regions(self, vectors: np.ndarray) -> np.ndarray:
        at = np.zeros(len(vectors), np.int64)
        if not len(self.dimension):
            return at
        while (inside := np.flatnonzero(at >= 0)).size:
            node = at[inside]
            above = vectors[inside, self.dimension[node]] > self.value[node]
            at[inside] = self.sides[node, above.astype(np.int64)]
        return -1 - at


def splits(sample: np.ndarray, regions: int) -> Splits:
    """Splits of a sample at the median of its widest side, the largest part first, into so many regions at most."""
    parts, tree, leaves = [np.arange(len(sample))], [], [(-1, 0)]
    while len(parts) < regions:
        k = max(range(len(parts)), key=lambda k: len(parts[k]))
        part = sample[parts[k]]
        spread = part.max(0) - part.min(0)
        if len(part) < 2 or not spread.any():
            break
        dimension = int(spread.argmax())
        value = np.sort(part[:, dimension])[(len(part) - 1) // 2]
        if value == part[:, dimension].max():  # over half are equal to the largest
            value = part[part[:, dimension] < value, dimension].max()
        above = part[:, dimension] > value
        up, side = leaves[k]
        if up >= 0:
            tree[up][2][side] = len(tree)
        tree.append([dimension, value, [-1 - k, -1 - len(parts)]])
        parts, leaves = [*parts, parts[k][above]], [*leaves, (len(tree) - 1, 1)]
        parts[k], leaves[k] = parts[k][~above], (len(tree) - 1, 0)
    columns = ([node[j] for node in tree] for j in range(3))
    return Splits(*(np.array(c, np.int64) for c in columns))


def placed(vectors: DataFrame, shard: int = SHARD) -> tuple[DataFrame, dict[int, Splits]]:
    """row, id, vector, length, region, part of every vector (row, id, vector), written; and the splits of each length that has any."""
    counted = {r["length"]: r["n"] for r in vectors.groupBy(F.size("vector").alias("length")).agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(MOST_REGIONS).collect()}
    total = sum(counted.values())
    step = max(1, total // SAMPLE)
    drawn = vectors.where(F.pmod(F.xxhash64("row"), F.lit(step)) == 0).select("vector").limit(2 * SAMPLE)
    some = drawn.toArrow() if total > shard else None
    trees: dict[int, Splits] = {}
    room = BOX_VALUES
    if some is not None:
        sizes = np.array([len(v) for v in some["vector"].to_pylist()])
        for length, n in counted.items():
            own = np.flatnonzero(sizes == length)
            regions = min(-(-n // shard), MOST_REGIONS, room // (2 * length))
            if regions > 1 and len(own) > 1:
                trees[length] = splits(_matrix(some, own), regions)
                room -= 2 * length * (len(trees[length].dimension) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(column(batch, "vector").offsets.to_numpy())
            region = np.zeros(len(sizes), np.int64)
            for length in np.unique(sizes).tolist():
                if length in trees:
                    own = np.flatnonzero(sizes == length)
                    region[own] = trees[length].regions(_matrix(batch, own))
            columns = [*(column(batch, name) for name in ("row", "id", "vector")), pa.array(sizes, pa.int64()), pa.array(region)]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "vector", "length", "region"])

    rows = written(arrow(vectors, run, "row long, id long, vector array<long>, length long, region long"))
    parts = rows.groupBy("length", "region").agg(F.ceil(F.count("*") / F.lit(shard)).alias("parts"))
    return rows.join(parts, ["length", "region"]).withColumn("part", F.pmod(F.xxhash64("row"), "parts")), trees


def boxes(shards: DataFrame, split_lengths: list[int]) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """The box of each region of the lengths that are split: at most BOX_VALUES numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            length, region = column(batch, "length").to_numpy(), column(batch, "region").to_numpy()
            for key in sorted(set(zip(length.tolist(), region.tolist(), strict=True))):
                part = _matrix(batch, np.flatnonzero((length == key[0]) & (region == key[1])))
                low, high = held.get(key, (part[0], part[0]))
                held[key] = np.minimum(low, part.min(0)), np.maximum(high, part.max(0))
        if held:
            keys = np.array(list(held))
            sides = [pa.array([pair[j].tolist() for pair in held.values()], pa.list_(pa.int64())) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), *sides], names=["length", "region", "low", "high"])

    rows = shards.where(F.col("length").isin(split_lengths)).select("length", "region", "vector")
    sides = arrow(rows, run, "length long, region long, low array<long>, high array<long>")
    each = sides.select("length", "region", F.posexplode(F.arrays_zip("low", "high")))
    found = each.groupBy("length", "region", "pos").agg(F.min("col.low").alias("low"), F.max("col.high").alias("high"))
    out: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    cells = found.toArrow().sort_by([("length", "ascending"), ("region", "ascending"), ("pos", "ascending")])
    length, region, low, high = (cells[name].to_numpy() for name in ("length", "region", "low", "high"))
    at = 0
    while at < len(length):
        out[int(length[at]), int(region[at])] = low[at : at + length[at]], high[at : at + length[at]]
        at += int(length[at])
    return out


def reached(queries: DataFrame, box_of: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """The queries (row, id, vector, length, kth), once for each region of their length whose box reaches their kth score."""
    by_length: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
    for (length, region), (low, high) in box_of.items():
        by_length.setdefault(length, []).append((region, low, high))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = column(batch, "length").to_numpy()
            kth = column(batch, "kth").to_numpy(zero_copy_only=False).astype(float)
            kth = np.where(np.isnan(kth), -np.inf, kth)
            rows, regions = [], []
            for length in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == length)
                if length in by_length:
                    names, low, high = (np.array(x) for x in zip(*by_length[length], strict=True))
                    which, region = np.nonzero(_bounds(_matrix(batch, own).astype(float), low, high) >= kth[own][:, None])
                    rows.append(own[which])
                    regions.append(names[region])
                else:  # one region
                    rows.append(own)
                    regions.append(np.zeros(len(own), np.int64))
            if rows:
                some = batch.take(pa.array(np.concatenate(rows)))
                columns = [*(column(some, name) for name in ("row", "id", "vector", "length", "kth")), pa.array(np.concatenate(regions))]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "vector", "length", "kth", "region"])

    schema = "row long, id long, vector array<long>, length long, kth long, region long"
    return arrow(queries.select("row", "id", "vector", "length", "kth"), run, schema)


def _searched(shards: DataFrame, queries: DataFrame, k: int, per_task: int, block: int) -> DataFrame:
    """query_row, query_id, vec_id, score: the k best of each shard for the queries (PLACE, row, id, vector, kth) sent to it.

    A task gets a shard and up to about per_task of its queries; the shard's vectors come first. Shards without queries are not sent.
    """
    groups = queries.groupBy(*PLACE).agg(F.ceil(F.count("*") / F.lit(per_task)).alias("groups"))
    none = F.lit(None).cast("long").alias("kth")
    members = shards.join(groups, PLACE).withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))
    asked = queries.join(groups, PLACE).withColumn("group", F.pmod(F.xxhash64("row"), "groups"))
    key = [*PLACE, "group"]
    rows = members.select(*key, F.lit(False).alias("asks"), "row", "id", "vector", none)
    rows = rows.unionByName(asked.select(*key, F.lit(True).alias("asks"), "row", "id", "vector", "kth"))
    rows = rows.repartition(*key).sortWithinPartitions(*key, "asks", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: Tree | None = None
        own, held = None, []

        def closed() -> Tree | None:
            if not held:
                return None
            table = pa.concat_tables(held)
            return build(table["row"].to_numpy(), table["id"].to_numpy(), _matrix(table, np.arange(len(table))))

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            names = np.column_stack([table[name].to_numpy() for name in key])
            asks = table["asks"].to_numpy()
            new = (names[1:] != names[:-1]).any(1) | (asks[1:] != asks[:-1])
            bounds = [0, *(np.flatnonzero(new) + 1).tolist(), len(table)]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if own != (name := tuple(names[a].tolist())):
                    own, held, tree = name, [], None
                part = table.slice(a, b - a)
                if not asks[a]:
                    held.append(part)
                    continue
                if tree is None:
                    tree, held = closed(), []
                if tree is None:
                    continue
                for first in range(0, len(part), block):
                    some = part.slice(first, block)
                    kth = some["kth"].to_numpy().astype(float)
                    who, found, score, _ = search(
                        tree, some["row"].to_numpy(), _matrix(some, np.arange(len(some))), np.where(np.isnan(kth), -np.inf, kth), k
                    )
                    columns = [some["row"].to_numpy()[who], some["id"].to_numpy()[who], found, score]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_row", "query_id", "vec_id", "score"])

    return arrow(rows, run, "query_row long, query_id long, vec_id long, score long")


def top_k(
    embeddings: DataFrame, is_query: Column, k: int = 20, shard: int = SHARD, block: int = BLOCK, per_task: int = QUERIES
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best vectors (id, vector) for every row that is a query (of column id)."""
    vectors = written(embeddings.withColumn("row", F.monotonically_increasing_id()))
    shards, trees = placed(vectors, shard)
    queries = shards.where(is_query).withColumn("kth", F.lit(None).cast("long"))
    home = written(_searched(shards, queries, k, per_task, block))
    known = home.groupBy(F.col("query_row").alias("row")).agg(F.count("*").alias("found"), F.min("score").alias("least"))
    known = known.select("row", F.when(F.col("found") >= k, F.col("least")).alias("kth"))
    asked = queries.drop("kth").join(known, "row", "left")
    parts = shards.groupBy("length", "region").agg(F.first("parts").alias("parts"))
    away = reached(asked, boxes(shards, list(trees)) if trees else {}).join(parts, ["length", "region"])
    away = away.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    mine = queries.select("row", F.col("region").alias("own_region"), F.col("part").alias("own_part"))
    away = away.join(mine, "row").where("region <> own_region OR part <> own_part")
    found = home.unionByName(_searched(shards, away, k, per_task, block))
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def op7_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(quantised(spark.read.parquet(f"{folder}/embeddings.parquet")), F.col("id") % 20 == 0)


OP7_SQL = f"""
    WITH whole AS (
        SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings
        WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), pairs AS (
        SELECT q.row, q.vec_id AS query_id, c.vec_id AS vec_id,
               CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
        FROM whole q JOIN whole c ON q.row <> c.row AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0
    ), ranked AS (
        SELECT query_id, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs
    )
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
