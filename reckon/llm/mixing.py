"""Mixing sources to target weights by iterative proportional fitting.

Documents are added up into cells (source, language, topic) of tokens. Raking scales the cells to the target tokens of each source,
language and topic in turn until they settle. Each document is then kept with the probability that its cell's ratio of raked to own
tokens gives, scaled so that the expected tokens are the wanted share of all, and drawn by a hash of its id: the same at every run.

The cells are a table like any other: each step of a sweep joins them with the sums over one margin, and is written in the shared
folder, so there may be any number of sources and no plan holds more than one step. Targets are given, or the tokens of each value
to the power TEMPER, which lifts small values.

Null sources, languages and topics count as "". Null and empty texts have no tokens and are kept with probability 0 only if
their cell has none either way; they never change the weights. An empty table gives no rows. Repeated rows are drawn alike, by their id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reckon.llm.shared import arrow, written
from reckon.llm.textbytes import chunks, column

MARGINS = ("source", "lang", "topic")
TOPICS = 8
LONG_WORD = 6
TEMPER = 0.7
SHARE = 0.5
SWEEPS = 40
SETTLED = 1e-4


def profiled(documents: DataFrame, keep: list[str], topics: int = TOPICS) -> DataFrame:
    """The kept columns, _tokens (words) and _topic of every document.

    The topic is a stand-in for a topic model: long words are hashed into topics, and the one with most of a text's words counts, the
    lowest of equal ones.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*keep).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(column(batch, "_text")):
                starts, ends = chunk.words()
                doc = chunk.doc_of(starts)
                long = ends - starts >= LONG_WORD
                bucket = (chunk.hashes(starts[long], ends[long]) % np.uint64(topics)).astype(np.int64)
                votes = np.bincount(doc[long] * topics + bucket, minlength=chunk.n * topics).reshape(chunk.n, topics)
                kept = [column(batch, name).slice(chunk.first, chunk.n) for name in keep]
                topic = pa.array([f"topic{t}" for t in votes.argmax(1)])
                tokens = pa.array(np.bincount(doc, minlength=chunk.n), pa.int64())
                yield pa.RecordBatch.from_arrays([*kept, tokens, topic], names=[*keep, "_tokens", "_topic"])

    return arrow(documents.select(*keep, documents["text"].alias("_text")), run, f"{fields}, _tokens long, _topic string")


def tempered(cells: DataFrame, margin: str, temper: float = TEMPER) -> DataFrame:
    """(margin, target): target weights of the values of a margin that occur."""
    totals = cells.groupBy(margin).agg(F.sum("tokens").alias("t"))
    return totals.select(margin, F.pow(F.col("t").cast("double"), F.lit(temper)).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """Cells (source, lang, topic, tokens) with raked tokens in `weight`; they add up to all tokens.

    A target table has the margin's column and `target`, in any unit. Values without a target keep their tokens; cells without
    tokens keep none.
    """
    cells = written(cells)
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    goals = {}
    for margin in MARGINS:
        target = targets[margin] if targets and margin in targets else tempered(cells, margin)
        own = cells.groupBy(margin).agg(F.sum("tokens").alias("t")).join(target, margin, "left")
        goals[margin] = written(own.withColumn("goal", F.coalesce("target", F.col("t").cast("double"))).select(margin, "t", "goal", "target"))
        # given targets share what the values without a target leave
        known = goals[margin].agg(F.sum("target"), F.sum(F.when(F.col("target").isNull(), F.col("t")))).first()
        scale = (total - (known[1] or 0)) / known[0] if known[0] else 1.0
        goals[margin] = goals[margin].select(margin, F.when(F.col("target").isNull(), F.col("t")).otherwise(F.col("target") * scale).alias("goal"))
    now = cells.withColumn("weight", F.col("tokens").cast("double"))
    for margin in MARGINS:
        now = now.join(goals[margin].withColumnRenamed("goal", f"goal_{margin}"), margin)
    now = written(now)
    for _ in range(SWEEPS):
        now = now.withColumnRenamed("weight", "before").withColumn("weight", F.col("before"))
        for margin in MARGINS:
            sums = now.groupBy(margin).agg(F.sum("weight").alias("s"))
            factor = F.when(F.col("s") > 0, F.col(f"goal_{margin}") / F.col("s")).otherwise(F.lit(1.0))
            now = written(now.join(sums, margin).withColumn("weight", F.col("weight") * factor).drop("s"))
        moved = now.where("before > 0").agg(F.max(F.abs(F.col("weight") / F.col("before") - 1))).first()[0]
        now = now.drop("before")
        if moved is None or moved < SETTLED:
            break
    return now.drop(*(f"goal_{margin}" for margin in MARGINS))


def probabilities(raked: DataFrame, share: float = SHARE) -> DataFrame:
    """The raked cells with `ratio` (raked per own token) and `probability`: min(1, scale * ratio), with the scale at which the
    expected tokens are `share` of all."""
    raked = raked.withColumn("ratio", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(F.lit(1.0)))
    wanted = share * (raked.agg(F.sum("tokens")).first()[0] or 0)
    scale = share
    for _ in range(50):
        full = F.col("ratio") * scale >= 1
        whole, rest = raked.agg(F.sum(F.when(full, F.col("tokens"))), F.sum(F.when(~full, F.col("weight")))).first()
        if not rest or wanted <= (whole or 0):
            break
        after = (wanted - (whole or 0)) / rest
        if abs(after - scale) <= 1e-12 * scale:
            break
        scale = after
    return raked.withColumn("probability", F.least(F.lit(1.0), F.col("ratio") * F.lit(float(scale))))


def mixed(
    documents: DataFrame, keep: list[str], targets: dict[str, DataFrame] | None = None, share: float = SHARE, seed: int = 17
) -> DataFrame:
    """The kept columns and _source, _lang, _topic, _tokens, _ratio, _probability and _sampled of every document."""
    value = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")).alias(f"_{name}")
    named = documents.select(*keep, documents["text"], F.col("doc_id").alias("_id"), value("source"), value("lang"))
    own = profiled(named.select("text", "_source", "_lang"), ["_source", "_lang"])
    cells = own.groupBy("_source", "_lang", "_topic").agg(F.sum("_tokens").alias("tokens")).toDF(*MARGINS, "tokens")
    cells = written(probabilities(rake(cells, targets), share).select(*MARGINS, F.col("ratio").alias("_ratio"), F.col("probability").alias("_probability")))
    cells = cells.toDF("_source", "_lang", "_topic", "_ratio", "_probability")
    every = profiled(named, [*keep, "_id", "_source", "_lang"]).join(cells, ["_source", "_lang", "_topic"])
    draw = F.pmod(F.xxhash64(F.col("_id"), F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    return every.withColumn("_sampled", draw < F.col("_probability")).drop("_id")


def op8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    every = mixed(spark.read.parquet(f"{folder}/documents.parquet"), ["doc_id"])
    return every.select(
        "doc_id",
        F.col("_source").alias("source"),
        F.col("_lang").alias("lang"),
        F.col("_topic").alias("topic"),
        F.col("_tokens").alias("n_tokens"),
        F.col("_ratio").alias("weight"),
        F.col("_probability").alias("probability"),
        F.col("_sampled").alias("sampled"),
    )
