"""Text lists of group members that never gather an unbounded group in one row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reckon.functions.ordered import HOT_ROWS, frozen, running_sum

IDS_PER_ROW = 10_000
BROADCAST_GROUPS = 100_000


def duplicate_groups(
    df: DataFrame,
    keys: Sequence[str],
    id_column: str,
    count_name: str,
    ids_name: str,
    values: dict[str, Column] | None = None,
    extra: Sequence[Column] = (),
    ids_per_row: int = IDS_PER_ROW,
    broadcast_groups: int = BROADCAST_GROUPS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Groups of more than one row, with ', '-joined lists of their ids and ``values`` in the order of the ids.

    Every list comes in numbered parts (Part of Parts) of ``ids_per_row`` members, contiguous in the order of
    the ids, at any size of group; most groups have the one part 1 of 1. Each part has the totals of the whole
    group.

    Counts and ``extra`` aggregates are taken over the whole group first, with its smallest and largest
    id, which is all there is to list of a pair. Only for larger groups, or if values are listed, are the
    rows read again and joined to the groups; up to ``broadcast_groups`` of them are broadcast.
    """
    keys, values = list(keys), values or {}
    totals = df.groupBy(*keys).agg(
        F.count("*").alias(count_name), *extra, F.min(id_column).alias("_first"), F.max(id_column).alias("_last")
    )
    parts = F.ceil(F.col(count_name) / ids_per_row).cast("bigint")
    groups = frozen(totals.filter(F.col(count_name) > 1).withColumn("Parts", parts))
    is_pair = F.lit(False) if values or ids_per_row < 2 else F.col(count_name) == 2
    pair = F.concat_ws(", ", F.col("_first").cast("string"), F.col("_last").cast("string"))
    listed = groups.filter(is_pair).withColumn(ids_name, pair).drop("_first", "_last")
    for name in values:
        listed = listed.withColumn(name, F.lit(None).cast("string"))
    listed = listed.withColumn("Part", F.lit(1).cast("bigint"))

    larger = groups.filter(~is_pair).drop("_first", "_last")
    size = larger.count()
    if size == 0:
        return listed
    if size <= broadcast_groups:
        larger = F.broadcast(larger)
    members = df.select(
        *[F.col(k).alias(f"_{k}") for k in keys],
        F.col(id_column).alias("_id"),
        *[v.cast("string").alias(f"_v_{n}") for n, v in values.items()],
    )
    same_group = [larger[k].eqNullSafe(members[f"_{k}"]) for k in keys]
    joined = members.join(larger, same_group).drop(*[f"_{k}" for k in keys])
    # The place in the group; a key that is null is told from the others by a flag.
    named = {f"_k{n}": F.coalesce(F.col(k).cast("string"), F.lit("")) for n, k in enumerate(keys)}
    named |= {f"_n{n}": F.col(k).isNull() for n, k in enumerate(keys)}
    joined = frozen(joined.withColumns(named).withColumn("_one", F.lit(1)))
    placed = running_sum(joined, list(named), [F.col("_id")], "_one", "_place", hot_rows)
    placed = placed.withColumn("Part", F.ceil(F.col("_place") / ids_per_row).cast("bigint"))
    member = F.struct("_id", *[f"_v_{n}" for n in values])
    texts = {ids_name: F.col("_all._id").cast("array<string>"), **{n: F.col(f"_all._v_{n}") for n in values}}
    dealt = (
        placed.groupBy(*larger.columns, "Part")
        .agg(F.array_sort(F.collect_list(member)).alias("_all"))
        .withColumns({name: F.array_join(text, ", ") for name, text in texts.items()})
    )
    return listed.unionByName(dealt.drop("_all"))
