"""Tables that a job writes in the shared folder, so that lost executors cost no recomputation, and connected components."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_shipped: set[str] = set()


BATCH_ROWS = 2000


def ship(spark: SparkSession) -> None:
    """Give the executors this subpackage, once an application, so that tasks can import it wherever the driver found it.

    Rows hold whole texts, so tasks take fewer of them at a time than Spark's default, unless the session sets less still.
    """
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(batch)) <= BATCH_ROWS:
        spark.conf.set(batch, BATCH_ROWS)
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        here = Path(__file__).resolve().parent
        file = Path(tempfile.mkdtemp(prefix="reckon-ship-")) / "reckon_llm.zip"  # Spark serves it from the driver
        with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as out:
            out.write(here.parent / "__init__.py", "reckon/__init__.py")
            for module in sorted(here.glob("*.py")):
                out.write(module, f"reckon/llm/{module.name}")
        context.addPyFile(str(file))
        _shipped.add(context.applicationId)


def arrow(df: DataFrame, function: Callable, schema: str | T.StructType) -> DataFrame:
    """mapInArrow with this subpackage at hand in the tasks."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; only a local session may do without the setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="reckon-llm-")
    return f"{folder.rstrip('/')}/llm-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The same rows, read from a table in the shared folder."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of 2 ** bits bits of the 64-bit hashes in the only column of a table: a filter of a fixed size for every task.

    It lets through what it holds and some more; what must not pass is dropped by a join later. If it fills up it filters less.
    """
    (name,) = hashes.columns
    places = hashes.select(F.col(name).bitwiseAND((1 << bits) - 1).alias("bit")).distinct()
    value = F.bit_or(F.expr("shiftleft(1L, CAST(bit & 31 AS INT))"))
    out = np.zeros(1 << (bits - 5), np.uint32)
    for word, found in places.groupBy(F.shiftright("bit", 5).alias("word")).agg(value).toLocalIterator():
        out[word] = found
    return out


def in_bitmap(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Flags of the 64-bit hashes that a bitmap lets through."""
    bit = hashes.view(np.int64) & (len(table) * 32 - 1)
    return (table[bit >> 5] >> (bit & 31).astype(np.uint32)) & np.uint32(1) == 1


def _pairs(rows: DataFrame, *of: tuple[str, str]) -> DataFrame:
    """(a, b): the given pairs of columns of every row, read in one pass."""
    return rows.select(F.inline(F.array(*(F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in of))))


def components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, root): the smallest node that each linked node of links (a, b) reaches.

    Every round links all larger neighbours of a node to its smallest neighbour, then all smaller ones; what remains is a star around
    each smallest node. A node with many links has its neighbours reduced by minimum before any shuffle, and rows go on one by one.
    Both halves of a round are written: a plan that reads a half several times repeats it, and the driver holds a thread for each exchange.
    """
    edges = written(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    check = [F.count("*"), F.expr("bit_xor(xxhash64(a, b))")]
    before = edges.agg(*check).first()
    for _ in range(most_rounds):
        both = _pairs(edges, ("a", "b"), ("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
        large = written(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = _pairs(large.join(least, "a"), ("b", "least"), ("a", "least")).where("a != b")
        edges = written(small.distinct())
        after = edges.agg(*check).first()
        if after == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after
    raise RuntimeError("components did not settle")
