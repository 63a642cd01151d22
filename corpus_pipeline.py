"""A training corpus from raw documents, stage by stage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents; each works on whole texts and on every row that the one before kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reckon.llm.bpe import encode
from reckon.llm.classifier import classify, fit, sample_ids
from reckon.llm.mixing import mixed
from reckon.llm.near import representatives, row_digest
from reckon.llm.secrets import redact
from reckon.llm.shared import shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from `labels`, accepts."""
    machine = fit(docs, sample_ids(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return classify(docs, machine, keep=COLUMNS).where("predicted = 1").select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest doc_id; documents without words are in no group and stay.

    Texts that share a doc_id are judged and kept one by one, as are those without doc_id, which come last in their group. Rows that repeat
    both doc_id and text are one document: the least of their other columns stays, found before the shuffle.
    """
    digest = ["_row", "_row2"]
    rows = docs.select(*COLUMNS, *row_digest())
    one = rows.join(representatives(docs), digest, "left_semi").groupBy(*digest).agg(F.min(F.struct(*COLUMNS)).alias("_kept"))
    return one.select("_kept.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark; n_chars follows the text."""
    clean = redact(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are drawn at the calibrated probabilities of their source, language and topic."""
    return mixed(docs, list(COLUMNS)).where("_sampled").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus as token ids, with digests of ids and of the decoded text."""
    return encode(docs, keep=("doc_id", "lang", "source"))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near),
    ("secret scans", secrets),
    ("mixing sources to target weights", mixture),
    ("byte-level BPE encoding and decoding", tokens),
]

#: Models, components and hashes of token ids are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the result is the last stage's table, read from the shared folder."""
    folder = shared_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{k}")
        docs = spark.read.parquet(path)
    return docs
