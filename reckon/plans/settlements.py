"""Settlement amounts for any number of merchants and periods at once."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reckon import schemas as s
from reckon.functions.ordered import HOT_ROWS, running_sums
from reckon.operators.shared import completed

_REQUEST = ["RequestID", "MerchantID", "PeriodStart", "PeriodEnd"]


def calculate_settlements(
    ledger: DataFrame,
    wallets: DataFrame,
    merchants: DataFrame,
    requests: DataFrame,
    as_of: datetime.date,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One pending settlement per request (RequestID, MerchantID, PeriodStart, PeriodEnd).

    A row counts when its time lies between both ends, inclusive: with dates the last day counts only
    its first instant. Requests may overlap; without rows the amounts are 0.

    With date periods the ledger is first summed per wallet and day, which bounds the rows of a busy merchant by the
    calendar, and periods are matched by equality on (merchant, month), whole months by their total. Periods with a time
    of day are looked up in running sums.
    """
    held = wallets.select("WalletID", "UserID").join(merchants.select("UserID", "MerchantID"), "UserID")
    held = held.select("WalletID", "MerchantID")
    by_date = all(isinstance(requests.schema[c].dataType, T.DateType) for c in ("PeriodStart", "PeriodEnd"))
    paid, asked = completed(ledger), requests.select(*_REQUEST)
    sums = _by_day(paid, held, asked) if by_date else _by_time(paid, held, asked, hot_rows)
    gross, commission = (F.coalesce(F.col(c), F.lit(0)) for c in ("_gross", "_commission"))
    return sums.select(
        F.col("RequestID").alias("SettlementID"),
        "MerchantID",
        "PeriodStart",
        "PeriodEnd",
        gross.alias("GrossAmount"),
        commission.alias("CommissionAmount"),
        (gross - commission).alias("NetAmount"),
        F.lit("Pending").alias("SettlementStatus"),
        F.lit(as_of).alias("CreatedAt"),
    )


def asked_days(requests: DataFrame) -> tuple[datetime.date | None, datetime.date | None]:
    """First and last day that any request asks for; a ledger partitioned by month need not be read beyond."""
    return tuple(requests.agg(F.to_date(F.min("PeriodStart")), F.to_date(F.max("PeriodEnd"))).first())


def _by_day(paid: DataFrame, held: DataFrame, requests: DataFrame) -> DataFrame:
    """Sums per request from day and month totals, both taken in one pass over the ledger."""
    day = F.to_date("CreatedTimestamp")
    first_instant = F.col("CreatedTimestamp") == day.cast("timestamp_ntz")
    amounts = {"_gross": F.col("Amount"), "_commission": F.col("CommissionAmount")}
    amounts |= {f"{name}_at_start": F.when(first_instant, amount) for name, amount in amounts.items()}
    daily = paid.groupBy("WalletID", day.alias("_date")).agg(
        *[F.sum(amount).alias(name) for name, amount in amounts.items()]
    )
    activity = (
        daily.join(held, "WalletID")
        .withColumns({"_merchant": F.col("MerchantID"), "_of": F.trunc("_date", "month")})
        .groupingSets([["_merchant", "_of", "_date"], ["_merchant", "_of"]], "_merchant", "_of", "_date")
        .agg(*[F.sum(name).alias(name) for name in amounts], F.grouping("_date").alias("_is_month"))
    )

    start, end, date = F.col("PeriodStart"), F.col("PeriodEnd"), F.col("_date")
    whole_month = (F.col("_month") >= start) & (F.last_day("_month") < end)
    buckets = _months(requests).withColumn("_whole", F.when(whole_month, 1).otherwise(0))
    in_period = (F.col("_whole") == 1) | date.between(start, end)
    matched = buckets.join(
        activity,
        (F.col("MerchantID") == F.col("_merchant"))
        & (F.col("_month") == F.col("_of"))
        & (F.col("_whole") == F.col("_is_month"))
        & in_period,
        "left",
    )
    last_day = (F.col("_whole") == 0) & (date == end)
    return matched.groupBy(*_REQUEST).agg(
        *[
            F.sum(F.when(last_day, F.col(f"{name}_at_start")).otherwise(F.col(name))).alias(name)
            for name in ("_gross", "_commission")
        ]
    )


def _by_time(paid: DataFrame, held: DataFrame, requests: DataFrame, hot_rows: int) -> DataFrame:
    """For periods with a time of day: sums up to the end of each period less those before its start.

    The ends of all periods and the rows of the merchants they ask for lie in one order of time; one running sum over it
    gives every end the total so far. However many periods overlap, a row is sorted once, and a busy merchant's rows
    are summed in ranges.
    """
    asked = requests.filter((F.col("PeriodStart") <= F.col("PeriodEnd")) & F.col("MerchantID").isNotNull())
    nothing = {name: F.lit(0).cast(kind) for name, kind in (("_gross", s.AMOUNT), ("_commission", s.COMMISSION))}
    # Of equal times a start comes before the rows, which count, and an end after them.
    starts, ends = (
        asked.select("MerchantID", F.col(column).alias("_at"), F.lit(place).alias("_place"), "RequestID").withColumns(nothing)
        for column, place in (("PeriodStart", -1), ("PeriodEnd", 1))
    )
    rows = paid.filter(F.col("CreatedTimestamp").isNotNull()).join(
        held.join(asked.select("MerchantID").distinct(), "MerchantID", "left_semi"), "WalletID"
    )
    rows = rows.select(
        "MerchantID",
        F.col("CreatedTimestamp").alias("_at"),
        F.lit(0).alias("_place"),
        F.lit(None).cast(requests.schema["RequestID"].dataType).alias("RequestID"),
        F.col("Amount").alias("_gross"),
        F.col("CommissionAmount").alias("_commission"),
    )
    in_order = rows.unionByName(starts).unionByName(ends)
    names = {"_gross": "_gross_so_far", "_commission": "_commission_so_far"}
    summed = running_sums(
        in_order, ["MerchantID"], [F.col("_at"), F.col("_place")], {new: old for old, new in names.items()}, hot_rows
    )
    sums = (
        summed.filter(F.col("_place") != 0)
        .groupBy("RequestID")
        .agg(*[F.sum(F.when(F.col("_place") > 0, F.col(new)).otherwise(-F.col(new))).alias(old) for old, new in names.items()])
    )
    return requests.join(sums, "RequestID", "left")


def _months(requests: DataFrame) -> DataFrame:
    """One row per request and calendar month its period touches; a null month for an empty period."""
    first, last = (F.trunc(F.to_date(c), "month") for c in ("PeriodStart", "PeriodEnd"))
    months = F.when(first <= last, F.sequence(first, F.greatest(first, last), F.make_interval(months=F.lit(1))))
    return requests.withColumn("_month", F.explode_outer(months))
