"""Ordered computations that stay distributed when one key holds a large share of all rows.

A plain window sorts every row of a key in one task. Here keys above ``hot_rows`` rows are set apart:
their rows are split into contiguous ranges of (key, order), each range is computed on its own and the
result of the earlier ranges of the key is carried over. All other keys take the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reckon.session import checkpoint_folder, scratch_folder

HOT_ROWS = 5_000_000
BROADCAST_KEYS = 100_000

_SAMPLED_ROWS = 200  # rows of a key with exactly hot_rows rows that a sample is expected to hold
_ROW_BITS = 33  # monotonically_increasing_id() keeps the row position in the low 33 bits


def frozen(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so that several passes over the rows see the same split after lost executors."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The rows as Parquet beside the checkpoints, for many rows of which several passes read a few columns each."""
    folder = scratch_folder(df.sparkSession, "rows")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def split_hot(df: DataFrame, keys: Sequence[str], hot_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary keys, rows of hot keys or None). Keys must not be null.

    Hot keys are found in a sample, which spares a shuffle of all keys. The sample only decides which
    way a key's rows take: every row goes one of two ways, and both give the same result.
    """
    share = min(1.0, _SAMPLED_ROWS / max(hot_rows, 1))
    counts = df.select(*keys).sample(fraction=share, seed=1).groupBy(*keys).agg(F.count("*").alias("_rows"))
    hot_keys = frozen(counts.filter(F.col("_rows") > hot_rows * share).select(*keys))
    size = hot_keys.count()
    if size == 0:
        return df, None
    # About total rows / hot_rows keys; a low hot_rows may find more than can be broadcast.
    if size <= BROADCAST_KEYS:
        hot_keys = F.broadcast(hot_keys)
    return df.join(hot_keys, list(keys), "left_anti"), df.join(hot_keys, list(keys), "left_semi")


def _in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    ranged = df.repartitionByRange(*[F.col(k) for k in keys], *order)
    return frozen(ranged.withColumn("_range", F.spark_partition_id()))


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, name: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Add ``name``: sum of ``value`` over the rows of the key up to and including this one."""
    return running_sums(df, keys, order, {name: value}, hot_rows)


def running_sums(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], values: dict[str, str], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``running_sum`` of several columns (new name -> column) in one pass."""
    keys = list(keys)
    up_to_here = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ordinary, hot = split_hot(df, keys, hot_rows)
    result = ordinary.withColumns({name: F.sum(value).over(up_to_here) for name, value in values.items()})
    if hot is None:
        return result

    ranged = _in_ranges(hot, keys, order)
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        ranged.groupBy(*keys, "_range")
        .agg(*[F.sum(value).alias(f"_total_{name}") for name, value in values.items()])
        .select(*keys, "_range", *[F.coalesce(F.sum(f"_total_{name}").over(before), F.lit(0)).alias(f"_carried_{name}") for name in values])
    )
    in_range = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = {
        name: (F.sum(value).over(in_range) + F.col(f"_carried_{name}")).cast(result.schema[name].dataType)
        for name, value in values.items()
    }
    summed = ranged.join(carried, [*keys, "_range"]).withColumns(sums).drop("_range", *[f"_carried_{name}" for name in values])
    return result.unionByName(summed)


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: dict[str, str],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add each of ``columns`` (new name -> column) taken from the row before in ascending ``order``.

    ``order`` names columns that identify a row within its key.
    """
    keys, order = list(keys), list(order)
    by_key = Window.partitionBy(*keys).orderBy(*order)
    ordinary, hot = split_hot(df, keys, hot_rows)
    result = ordinary.withColumns({new: F.lag(old).over(by_key) for new, old in columns.items()})
    if hot is None:
        return result

    ranged = _in_ranges(hot, keys, [F.col(c) for c in order])
    row = F.struct(*order, *[F.col(old).alias(f"_old_{new}") for new, old in columns.items()])
    across = Window.partitionBy(*keys).orderBy("_range")
    carried = (
        ranged.groupBy(*keys, "_range")
        .agg(F.max(row).alias("_last"))
        .select(*keys, "_range", F.lag("_last").over(across).alias("_before"))
    )
    in_range = Window.partitionBy(*keys, "_range").orderBy(*order)
    filled = ranged.join(carried, [*keys, "_range"]).withColumn("_first", F.row_number().over(in_range) == 1)
    filled = filled.withColumns(
        {
            new: F.when(F.col("_first"), F.col(f"_before._old_{new}")).otherwise(F.lag(old).over(in_range))
            for new, old in columns.items()
        }
    ).drop("_range", "_first", "_before")
    return result.unionByName(filled)


def with_last_before(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, name: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Add ``name``: the last value of ``column`` that is not null in the rows of the key before this one.

    ``order`` names columns that identify a row within its key.
    """
    keys, order = list(keys), list(order)
    earlier = (Window.unboundedPreceding, -1)
    ordinary, hot = split_hot(df, keys, hot_rows)
    by_key = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*earlier)
    result = ordinary.withColumn(name, F.last(column, ignorenulls=True).over(by_key))
    if hot is None:
        return result

    ranged = _in_ranges(hot, keys, [F.col(c) for c in order])
    across = Window.partitionBy(*keys).orderBy("_range").rowsBetween(*earlier)
    carried = (
        ranged.groupBy(*keys, "_range")
        .agg(F.max_by(column, F.when(F.col(column).isNotNull(), F.struct(*order))).alias("_last"))
        .select(*keys, "_range", F.last("_last", ignorenulls=True).over(across).alias("_before"))
    )
    in_range = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(*earlier)
    own = F.last(column, ignorenulls=True).over(in_range)
    filled = ranged.join(carried, [*keys, "_range"]).withColumn(name, F.coalesce(own, F.col("_before")))
    return result.unionByName(filled.drop("_range", "_before"))


def global_row_number(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Add ``name``: 1, 2, 3, … over all rows in ``order``, without bringing them into one task.

    The rows are range-sorted once; the position inside a partition plus the sizes of the partitions
    before it is the row number. ``order`` must be total.
    """
    placed = stored(df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()))
    partition = F.shiftright("_place", _ROW_BITS)
    position = F.col("_place").bitwiseAND((1 << _ROW_BITS) - 1)
    placed = placed.withColumns({"_partition": partition, "_position": position})
    # One row per partition of the sort, so one task and a broadcast are enough here.
    before = Window.orderBy("_partition").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_partition")
        .agg(F.count("*").alias("_size"))
        .select("_partition", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        placed.join(F.broadcast(offsets), "_partition")
        .withColumn(name, F.col("_offset") + F.col("_position") + 1)
        .drop("_place", "_partition", "_position", "_offset")
    )
