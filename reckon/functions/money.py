"""Column expressions for exact commission arithmetic."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

CENT = Decimal("0.01")


def expected_commission() -> Column:
    """Amount times percentage. Multiplying by 0.01 keeps six exact decimals, a division would not."""
    return F.col("Amount") * F.col("CommissionPercentage") * F.lit(CENT)


def commission_error() -> Column:
    return F.abs(F.col("CommissionAmount") - expected_commission())


def is_mismatch() -> Column:
    return commission_error() > F.lit(CENT)


def is_correct() -> Column:
    return commission_error() <= F.lit(CENT)


def percentage(part: Column, whole: Column) -> Column:
    """100 * part / whole with two decimals; null when there is nothing to divide by."""
    return F.round(part.cast("decimal(20,0)") * 100 / F.nullif(whole, F.lit(0)).cast("decimal(20,0)"), 2)


def plain_number(value: Column) -> Column:
    """Decimal as text without trailing zeros: 5.00 -> 5, 4.50 -> 4.5."""
    text = value.cast("decimal(38,6)").cast("string")
    return F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))
