"""Helpers the jobs share for checking requests and numbering new rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reckon.functions.ordered import global_row_number

ARRIVAL = ["RequestedAt", "RequestID"]


def given(column: str) -> Column:
    """Text that is present and not empty."""
    return F.coalesce(F.col(column) != "", F.lit(False))


def given_id(column: str) -> Column:
    """An id that is present; the platform takes 0 for missing."""
    return F.coalesce(F.col(column) != 0, F.lit(False))


def first_reason(*rules: tuple[Column, str]) -> Column:
    """The reason of the first rule that fails, null if all hold. A null condition fails."""
    reason = None
    for holds, text in rules:
        fails = ~F.coalesce(holds, F.lit(False))
        reason = F.when(fails, text) if reason is None else reason.when(fails, text)
    return reason


def known(df: DataFrame, key: str, table: DataFrame, name: str) -> DataFrame:
    """Add flag ``name``: whether the row's ``key`` exists in ``table``, where it is unique."""
    ids = table.select(F.col(key), F.lit(True).alias(name))
    return df.join(ids, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def first_of_each(requests: DataFrame, key: str) -> DataFrame:
    """(key, RequestID) of the earliest request per key; grouped with a partial minimum, so repeated
    keys shrink before the shuffle."""
    return requests.groupBy(key).agg(F.min(F.struct(*ARRIVAL)).alias("_first")).select(
        key, F.col("_first.RequestID").alias("RequestID")
    )


def numbered(rows: DataFrame, table: DataFrame, id_column: str, order: Sequence[str] = ARRIVAL) -> DataFrame:
    """Give new rows the ids after the largest of ``table``, in ``order``."""
    largest = table.agg(F.coalesce(F.max(id_column), F.lit(0))).scalar()
    return global_row_number(rows, [F.col(c) for c in order], "_number").withColumn(
        id_column, F.col("_number") + largest
    ).drop("_number")


def audit(rows: DataFrame, action: Column, table: str, record: Column, old: Column, new: Column, by: int, *keep: str):
    """Rows in the shape of the audit log."""
    return rows.select(
        *keep,
        F.lit(by).cast("bigint").alias("UserID"),
        action.alias("Action"),
        F.lit(table).alias("TableAffected"),
        record.cast("string").alias("RecordID"),
        old.cast("string").alias("OldValue"),
        new.cast("string").alias("NewValue"),
    )


