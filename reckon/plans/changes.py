"""Difference of two versions of a table as change records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reckon.functions.money import plain_number
from reckon.functions.ordered import frozen

BUCKETS = 16_384


def _as_text(df: DataFrame, column: str) -> Column:
    if isinstance(df.schema[column].dataType, T.DecimalType):
        return plain_number(F.col(column))
    return F.col(column).cast("string")


def changed_buckets(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """_bucket: the buckets of keys in which two versions of a table differ; at most ``buckets`` rows.

    Both versions are read once and added up in the tasks: the number of rows of a bucket, and two sums of row hashes in any order.
    """

    def digests(df: DataFrame, name: str) -> DataFrame:
        row = [F.col(key), *[_as_text(df, c) for c in columns], *[_as_text(df, c).isNull() for c in columns]]
        sums = F.struct(
            F.count("*").alias("rows"),
            F.sum(F.xxhash64(*row).cast("decimal(20,0)")).alias("sum"),
            F.bit_xor(F.xxhash64(F.lit(1), *row)).alias("xor"),
        )
        return df.groupBy(_bucket(key, buckets)).agg(sums.alias(name))

    both = digests(before, "_before").join(digests(after, "_after"), "_bucket", "full")
    return both.filter(~F.col("_before").eqNullSafe(F.col("_after"))).select("_bucket")


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).alias("_bucket")


def table_diff(
    before: DataFrame, after: DataFrame, key: str, columns: Sequence[str], buckets: int = BUCKETS
) -> DataFrame:
    """One row per record and column whose value differs: RecordID, Change, ColumnName, OldValue, NewValue.

    Change is insert, update or delete. Comparison is null-safe; columns that are null on both sides of
    an insert or delete are left out. Only records of buckets that differ are joined; the list of these is sent to the tasks.
    """
    differing = F.broadcast(frozen(changed_buckets(before, after, key, columns, buckets)))

    def version(df: DataFrame, name: str) -> DataFrame:
        rows = df.withColumn("_bucket", _bucket(key, buckets)).join(differing, "_bucket", "left_semi")
        return rows.select(key, F.struct(*[_as_text(df, c).alias(c) for c in columns]).alias(name))

    old, new = F.col("_old"), F.col("_new")
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("ColumnName"), old[c].alias("OldValue"), new[c].alias("NewValue"))
            for c in columns
        ]
    )
    change = F.when(old.isNull(), "insert").when(new.isNull(), "delete").otherwise("update")
    return (
        version(before, "_old")
        .join(version(after, "_new"), key, "full")
        .select(F.col(key).cast("string").alias("RecordID"), change.alias("Change"), F.inline(pairs))
        .filter(~F.col("OldValue").eqNullSafe(F.col("NewValue")))
    )
