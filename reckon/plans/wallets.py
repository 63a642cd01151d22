"""Top-ups of wallet balances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reckon.functions.money import plain_number
from reckon.functions.ordered import HOT_ROWS, running_sum
from reckon.plans.requests import ARRIVAL, audit, first_reason, known


def topup_outcomes(wallets: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests with Reason, null when they apply."""
    reason = first_reason(
        (F.col("Amount") > 0, "nothing to add"), (F.col("_known"), "wallet not found")
    )
    return known(requests, "WalletID", wallets, "_known").withColumn("Reason", reason).drop("_known")


def _applied(wallets: DataFrame, requests: DataFrame) -> DataFrame:
    return requests.filter(F.col("Amount") > 0).join(wallets.select("WalletID"), "WalletID", "left_semi")


def apply_topups(wallets: DataFrame, requests: DataFrame) -> DataFrame:
    """The wallet table after all top-ups."""
    added = (
        requests.filter(F.col("Amount") > 0)
        .groupBy("WalletID")
        .agg(F.sum("Amount").alias("_added"), F.max("RequestedAt").alias("_at"))
    )
    return wallets.join(added, "WalletID", "left").select(
        "WalletID",
        "UserID",
        (F.col("Balance") + F.coalesce("_added", F.lit(0))).alias("Balance"),
        "CurrencyCode",
        F.coalesce("_at", F.col("LastUpdated").cast("timestamp_ntz")).alias("LastUpdated"),
    )


def topup_audit(wallets: DataFrame, requests: DataFrame, by: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One audit row per applied top-up with the balance before and after it."""
    order = [F.col(c) for c in ARRIVAL]
    summed = running_sum(_applied(wallets, requests), ["WalletID"], order, "Amount", "_sum", hot_rows)
    after = F.col("Balance") + F.col("_sum")
    return audit(
        summed.join(wallets.select("WalletID", "Balance"), "WalletID"),
        F.lit("TOPUP_WALLET"),
        "Wallets",
        F.col("WalletID"),
        plain_number(after - F.col("Amount")),
        plain_number(after),
        by,
        "RequestID",
    )
