"""Sums of binary floating-point numbers that do not depend on the order of addition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 26  # a part has so many bits, so that a double has three or four and their sums are exact
_POWER = 2.0**BITS


def _times_power(value: Column, level: Column) -> Column:
    """value * 2 ** (BITS * level), in two steps because the power alone may be too large or too small for a double."""
    half = F.pow(F.lit(2.0), level * (BITS // 2))
    return value * half * half


def parts(value: Column) -> Column:
    """(level, part) of a double: whole numbers below 2 ** BITS with value = sum(part * 2 ** (BITS * level)); none for null and zero.

    Scaling by a power of two and remainders are exact, so the parts are the bits of the number.
    """
    size = F.abs(value)
    top = F.floor(F.log2(size) / BITS).cast("int") + 1  # the logarithm may be off by a little
    levels = F.when(size > 0, F.transform(F.array(*[F.lit(k) for k in range(5)]), lambda k: top - k))

    def part(level: Column) -> Column:
        bits = F.floor(F.pmod(_times_power(size, -level), F.lit(_POWER)))
        return F.struct(level.alias("level"), F.when(value < 0, -bits).otherwise(bits).alias("part"))

    return F.filter(F.transform(levels, part), lambda p: p["part"] != 0)


def binary_sums(df: DataFrame, keys: Sequence[str], column: str, name: str) -> DataFrame:
    """The keys and ``name``: the sum of a column as doubles, the same to the last digit however the rows are spread.

    Parts of equal weight are added as whole numbers, in any order; their totals are few and are added from the heaviest on. Finite values only.
    """
    rows = df.select(*keys, F.explode_outer(parts(F.col(column).cast("double"))).alias("_part"))
    levels = rows.groupBy(*keys, "_part.level").agg(F.sum(F.col("_part.part").cast("decimal(20,0)")).alias("total"))
    weight = _times_power(F.col("total").cast("double"), F.col("level"))
    ordered = F.array_sort(F.collect_list(F.when(F.col("level").isNotNull(), F.struct((-F.col("level")).alias("at"), weight.alias("value")))))
    total = F.aggregate(ordered, F.lit(0.0), lambda so_far, x: so_far + x["value"])
    return levels.groupBy(*keys).agg(total.alias(name))
