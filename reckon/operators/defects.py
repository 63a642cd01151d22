"""Checks for rules the platform states but does not enforce."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reckon import schemas as s
from reckon.functions.binary import binary_sums
from reckon.functions.money import CENT
from reckon.functions.ordered import HOT_ROWS, running_sum, with_previous
from reckon.operators.readmodels import voucher_list
from reckon.operators.shared import completed

# Form of a reference and its longest accepted length.
REFERENCE_PATTERN = r"^[A-Z]+-[0-9]+\z"
REFERENCE_LENGTH = 20


def settlement_math_mismatch(settlements: DataFrame) -> DataFrame:
    expected = F.col("GrossAmount") - F.col("CommissionAmount")
    return settlements.select(
        "SettlementID",
        "MerchantID",
        "GrossAmount",
        "CommissionAmount",
        "NetAmount",
        expected.alias("ExpectedNet"),
        (F.col("NetAmount") - expected).alias("Difference"),
    ).filter(F.abs("Difference") > F.lit(CENT))


def inactive_users_transacting(ledger: DataFrame, wallets: DataFrame, users: DataFrame) -> DataFrame:
    """Users that are not active, with their ledger rows of any status."""
    inactive = users.filter(F.col("ServiceStatus") != s.ACTIVE).select("UserID", "FullName", "ServiceStatus")
    held = wallets.select("WalletID", "UserID").join(inactive, "UserID")
    per_wallet = ledger.groupBy("WalletID").agg(F.count("*").alias("_rows"), F.sum("Amount").alias("_amount"))
    return (
        per_wallet.join(held, "WalletID")
        .groupBy("UserID", "FullName", "ServiceStatus")
        .agg(F.sum("_rows").alias("TransactionCount"), F.sum("_amount").alias("TotalAmount"))
    )


def overdrawn_transactions(ledger: DataFrame, wallets: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Completed rows larger than the balance they were paid from.

    Only today's balance is stored: the balance before a row is that balance plus this and all later
    debits of the wallet.
    """
    debits = (
        completed(ledger)
        .filter(F.col("WalletID").isNotNull())
        .select("WalletID", "EntryID", "Amount", "CreatedTimestamp")
    )
    newest_first = [F.col("CreatedTimestamp").desc(), F.col("EntryID").desc()]
    return (
        running_sum(debits, ["WalletID"], newest_first, "Amount", "_since", hot_rows)
        .join(wallets.select("WalletID", "Balance"), "WalletID")
        .select(
            "EntryID",
            "WalletID",
            "CreatedTimestamp",
            "Amount",
            (F.col("Balance") + F.col("_since")).alias("BalanceBefore"),
        )
        .filter(F.col("Amount") > F.col("BalanceBefore"))
    )


def rapid_duplicates(ledger: DataFrame, within: datetime.timedelta, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows that follow a row of the same wallet and product within a time span."""
    rows = ledger.filter(F.col("WalletID").isNotNull() & F.col("ProductID").isNotNull()).select(
        "WalletID", "ProductID", "CreatedTimestamp", "EntryID"
    )
    previous = {"PreviousEntryID": "EntryID", "_previous": "CreatedTimestamp"}
    paired = with_previous(rows, ["WalletID", "ProductID"], ["CreatedTimestamp", "EntryID"], previous, hot_rows)
    gap = F.timestamp_diff("SECOND", F.col("_previous"), F.col("CreatedTimestamp"))
    return (
        paired.withColumn("SecondsApart", gap)
        .filter(F.col("SecondsApart") <= int(within.total_seconds()))
        .select("EntryID", "PreviousEntryID", "WalletID", "ProductID", "CreatedTimestamp", "SecondsApart")
    )


def bad_references(
    rows: DataFrame,
    id_column: str = "EntryID",
    reference: str = "ExternalReference",
    pattern: str = REFERENCE_PATTERN,
    max_length: int = REFERENCE_LENGTH,
) -> DataFrame:
    """References that are missing, too long or not in the agreed form."""
    text = F.col(reference)
    issue = (
        F.when(text.isNull() | (F.trim(text) == ""), "Missing")
        .when(F.length(text) > max_length, "Too long")
        .when(~text.rlike(pattern), "Wrong format")
    )
    return rows.select(id_column, reference, issue.alias("Issue")).filter(F.col("Issue").isNotNull())


def float_drift(ledger: DataFrame, key: str = "WalletID") -> DataFrame:
    """What keeping commissions as binary floating point does to each group's total.

    The doubles are added without regard to order, so every digit shown is the same on every run.
    """
    exact = ledger.groupBy(key).agg(F.sum("CommissionAmount").alias("DecimalTotal"))
    binary = binary_sums(ledger.filter(F.col("CommissionAmount").isNotNull()), [key], "CommissionAmount", "DoubleTotal")
    both = exact.withColumnRenamed(key, "_key").join(binary, F.col("_key").eqNullSafe(F.col(key)), "left")
    drift = F.abs(F.col("DoubleTotal") - F.col("DecimalTotal").cast("double"))
    return both.select(F.col("_key").alias(key), "DecimalTotal", "DoubleTotal", drift.alias("Drift"))


def null_balances(wallets: DataFrame, users: DataFrame) -> DataFrame:
    return (
        wallets.filter(F.col("Balance").isNull())
        .select("WalletID", "UserID", "LastUpdated")
        .join(users.select("UserID", "FullName", "ServiceStatus"), "UserID")
        .select("WalletID", "UserID", "FullName", "ServiceStatus", "LastUpdated")
    )


def active_vouchers(vouchers: DataFrame, ledger: DataFrame, as_of: datetime.date) -> DataFrame:
    """The voucher list without expired vouchers."""
    return voucher_list(vouchers.filter(F.col("ExpiryDate") >= F.lit(as_of)), ledger)


def duplicate_msisdn(users: DataFrame) -> DataFrame:
    return (
        users.groupBy("MSISDN")
        .agg(F.count("*").alias("Holders"))
        .filter(F.col("MSISDN").isNotNull() & (F.col("Holders") > 1))
    )
