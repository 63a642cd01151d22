"""Token counts: the exact histogram of encoded lengths, and its suffix sums, which answer every context limit.

Documents are added up by length in their tasks, so the shuffle holds one row a length and task. Suffix sums go over ranges of
RANGE lengths: one row a range is ordered in one task (the longest document / RANGE rows), the lengths of a range in a task of their own.

Null and empty texts have length 0. An empty table gives no rows. Repeated rows count each time. Only the text is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reckon.llm.bpe import encode

RANGE = 1024


def histogram(lengths: DataFrame, name: str = "n_tokens") -> DataFrame:
    """(length, documents) of a table with a length a row; null counts as 0."""
    return lengths.groupBy(F.coalesce(F.col(name), F.lit(0)).cast("long").alias("length")).agg(F.count("*").alias("documents"))


def limits(counts: DataFrame) -> DataFrame:
    """For every length that occurs, taken as the context limit: documents and tokens in all, those of longer documents, the tokens
    that are left when longer documents are cut, and the share of documents that fit.

    A limit between two lengths, or beyond the last, has the figures of the next smaller length, but for tokens_cut:
    tokens - tokens_longer + limit * documents_longer.
    """
    counts = counts.withColumn("range", F.shiftright("length", 10))
    sums = [F.sum("documents").alias("d"), F.sum(F.col("documents") * F.col("length")).alias("t")]
    ranges = counts.groupBy("range").agg(*sums)
    later = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    none = F.lit(0).cast("long")
    ranges = ranges.select(
        "range",
        F.coalesce(F.sum("d").over(later), none).alias("later_d"),
        F.coalesce(F.sum("t").over(later), none).alias("later_t"),
        F.sum("d").over(all_rows).alias("all_documents"),
        F.sum("t").over(all_rows).alias("all_tokens"),
    )
    longer = Window.partitionBy("range").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    own_d = F.coalesce(F.sum("documents").over(longer), none)
    own_t = F.coalesce(F.sum(F.col("documents") * F.col("length")).over(longer), none)
    joined = counts.withColumns({"own_d": own_d, "own_t": own_t}).join(ranges, "range")
    joined = joined.withColumns({"documents_longer": F.col("own_d") + F.col("later_d"), "tokens_longer": F.col("own_t") + F.col("later_t")})
    cut = F.col("all_tokens") - F.col("tokens_longer") + F.col("length") * F.col("documents_longer")
    fit = (F.col("all_documents") - F.col("documents_longer")) / F.col("all_documents")
    return joined.select(
        "length",
        "documents",
        "all_documents",
        "all_tokens",
        "documents_longer",
        "tokens_longer",
        cut.alias("tokens_cut"),
        fit.alias("share_fitting"),
    )


def at_limits(table: DataFrame, wanted: list[int]) -> DataFrame:
    """(context, tokens_cut, documents_longer) for stated limits, from the table of limits()."""
    figures = F.struct("length", "tokens_longer", "documents_longer")
    below = [F.max(F.when(F.col("length") <= w, figures)).alias(f"at{n}") for n, w in enumerate(wanted)]
    whole = [F.max(c).alias(c) for c in ("all_tokens", "all_documents")]
    answers = []
    for n, w in enumerate(wanted):
        longer = F.coalesce(F.col(f"at{n}.documents_longer"), F.col("all_documents"))
        tokens = F.coalesce(F.col(f"at{n}.tokens_longer"), F.col("all_tokens"))
        cut = F.col("all_tokens") - tokens + F.lit(w).cast("long") * longer
        answers.append(F.struct(F.lit(w).cast("long").alias("context"), cut.alias("tokens_cut"), longer.alias("documents_longer")))
    return table.agg(*whole, *below).select(F.inline(F.array(*answers)))


def quantile(table: DataFrame, share: float) -> DataFrame:
    """The smallest length that at least this share of the documents do not exceed."""
    return table.where(F.col("share_fitting") >= share).agg(F.min("length").alias("length"))


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    documents = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return limits(histogram(encode(documents, ids=False)))
