"""Ghost transactions: ledger rows that never produced a voucher.

``vouchers`` may be None when ``ledger`` holds ghosts only, as stored from ``shared.ghosts``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reckon.operators.shared import Timeline, by_dimension, completed, completed_ghosts, first_rows, ghosts


def ghost_count(ledger: DataFrame, vouchers: DataFrame | None) -> DataFrame:
    return completed_ghosts(ledger, vouchers).agg(F.count("*").alias("GhostTransactionCount"))


def ghost_total_impact(ledger: DataFrame, vouchers: DataFrame | None) -> DataFrame:
    """Null when there are no ghosts."""
    return completed_ghosts(ledger, vouchers).agg(F.sum("Amount").alias("TotalGhostAmount"))


def ghost_by_wallet(ledger: DataFrame, vouchers: DataFrame | None) -> DataFrame:
    return (
        completed_ghosts(ledger, vouchers)
        .groupBy("WalletID")
        .agg(F.count("*").alias("GhostCount"), F.sum("Amount").alias("TotalLostAmount"))
        .orderBy(F.col("TotalLostAmount").desc(), "WalletID")
    )


def _count_and_sum(total: str) -> dict:
    return {"GhostCount": F.lit(1), total: F.col("Amount")}


def ghost_by_user(ledger: DataFrame, vouchers: DataFrame | None, wallets: DataFrame, users: DataFrame) -> DataFrame:
    held = wallets.select("WalletID", "UserID").join(users.select("UserID", "FullName"), "UserID")
    return by_dimension(
        completed_ghosts(ledger, vouchers), "WalletID", _count_and_sum("TotalLost"), held, ["UserID", "FullName"]
    ).orderBy(F.col("TotalLost").desc(), "UserID")


def ghost_by_product(ledger: DataFrame, vouchers: DataFrame | None, products: DataFrame) -> DataFrame:
    """By product description, which several products may share."""
    return by_dimension(
        completed_ghosts(ledger, vouchers),
        "ProductID",
        _count_and_sum("TotalAmount"),
        products.select("ProductID", "Description"),
        ["Description"],
    )


def ghost_by_provider(
    ledger: DataFrame, vouchers: DataFrame | None, products: DataFrame, providers: DataFrame
) -> DataFrame:
    sold = products.select("ProductID", "ProviderID").join(providers.select("ProviderID", "ProviderName"), "ProviderID")
    return by_dimension(
        completed_ghosts(ledger, vouchers), "ProductID", _count_and_sum("TotalAmount"), sold, ["ProviderName"]
    )


def ghost_by_status(ledger: DataFrame, vouchers: DataFrame | None) -> DataFrame:
    return ghosts(ledger, vouchers).groupBy("ProcessingStatus").agg(F.count("*").alias("GhostCount"))


def ghost_daily(ledger: DataFrame, vouchers: DataFrame | None) -> DataFrame:
    return (
        completed_ghosts(ledger, vouchers)
        .groupBy(F.to_date("CreatedTimestamp").alias("TransactionDate"))
        .agg(F.count("*").alias("GhostCount"))
        .orderBy("TransactionDate")
    )


def ghost_commission_impact(ledger: DataFrame, vouchers: DataFrame | None) -> DataFrame:
    return completed_ghosts(ledger, vouchers).select(
        "EntryID",
        "Amount",
        "CommissionAmount",
        (F.col("Amount") + F.col("CommissionAmount")).alias("TotalImpact"),
    )


def ghost_duplicate_refs(ledger: DataFrame, vouchers: DataFrame | None) -> DataFrame:
    return (
        completed_ghosts(ledger, vouchers)
        .groupBy("ExternalReference")
        .agg(F.count("*").alias("Occurrences"))
        .filter(F.col("Occurrences") > 1)
    )


def _of_wallets(ledger: DataFrame, wallets: DataFrame) -> DataFrame:
    """Completed rows of some wallets only, so that vouchers are looked up for few rows."""
    return completed(ledger).join(wallets.select("WalletID"), "WalletID", "left_semi")


def ghost_low_balance(ledger: DataFrame, vouchers: DataFrame | None, wallets: DataFrame, below: int = 10) -> DataFrame:
    low = wallets.filter(F.col("Balance") < below).select("WalletID", "Balance")
    return by_dimension(
        ghosts(_of_wallets(ledger, low), vouchers), "WalletID", {"GhostCount": F.lit(1)}, low, ["WalletID", "Balance"]
    )


def ghost_negative_balance(ledger: DataFrame, vouchers: DataFrame | None, wallets: DataFrame) -> DataFrame:
    negative = wallets.filter(F.col("Balance") < 0).select("WalletID", "Balance")
    return (
        ghosts(_of_wallets(ledger, negative), vouchers)
        .join(negative, "WalletID")
        .select("WalletID", "Balance", "EntryID", "Amount")
    )


def _first_ghosts(ledger: DataFrame | Timeline, vouchers: DataFrame | None, n: int, newest: bool) -> DataFrame:
    """Vouchers are looked up for a window of the ledger, which is widened until n rows have none."""

    def without_voucher(window: DataFrame, whole: bool) -> DataFrame:
        rows = completed(window).select("EntryID", "WalletID", "Amount", "CreatedTimestamp")
        issued = vouchers
        if vouchers is not None and not whole:
            issued = vouchers.join(rows.select("EntryID"), "EntryID", "left_semi")
        return ghosts(rows, issued)

    return first_rows(ledger, n, without_voucher, newest)


def ghost_most_recent(ledger: DataFrame | Timeline, vouchers: DataFrame | None, n: int = 10) -> DataFrame:
    return _first_ghosts(ledger, vouchers, n, newest=True)


def ghost_oldest(ledger: DataFrame | Timeline, vouchers: DataFrame | None, n: int = 10) -> DataFrame:
    return _first_ghosts(ledger, vouchers, n, newest=False)
