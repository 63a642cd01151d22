"""Data hygiene: duplicates, malformed values, orphans, expired vouchers."""

from __future__ import annotations

import datetime
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reckon import schemas as s
from reckon.functions.lists import IDS_PER_ROW, duplicate_groups
from reckon.functions.money import plain_number

MSISDN_DIGITS = 11
FLOAT_TOLERANCE = Decimal("0.0001")


def duplicate_references(ledger: DataFrame, ids_per_row: int = IDS_PER_ROW) -> DataFrame:
    """References used more than once, with all their entries.

    The list comes in numbered parts of ``ids_per_row`` entries.
    """
    return (
        duplicate_groups(
            ledger.select("ExternalReference", "EntryID", "CreatedTimestamp"),
            ["ExternalReference"],
            "EntryID",
            "DuplicateCount",
            "AffectedEntryIDs",
            extra=[
                F.min("CreatedTimestamp").alias("FirstOccurrence"),
                F.max("CreatedTimestamp").alias("LastOccurrence"),
            ],
            ids_per_row=ids_per_row,
        )
        .select(
            "ExternalReference", "DuplicateCount", "Part", "Parts", "AffectedEntryIDs", "FirstOccurrence", "LastOccurrence"
        )
        .orderBy(F.col("DuplicateCount").desc(), "ExternalReference", "Part")
    )


def _msisdn_length() -> Column:
    return F.length(F.rtrim("MSISDN"))


def _msisdn_invalid() -> Column:
    return (_msisdn_length() != MSISDN_DIGITS) | ~F.col("MSISDN").rlike(rf"^[0-9]{{{MSISDN_DIGITS}}}\z")


def invalid_msisdn(users: DataFrame) -> DataFrame:
    """The issue type looks at the first character only, so letters further in are 'Other issue'."""
    issue = (
        F.when(~F.col("MSISDN").rlike("^[0-9]"), "Contains non-digits")
        .when(_msisdn_length() != MSISDN_DIGITS, "Wrong length")
        .otherwise("Other issue")
    )
    return (
        users.filter(_msisdn_invalid())
        .select("UserID", "FullName", "MSISDN", _msisdn_length().alias("Length"), issue.alias("IssueType"))
        .orderBy("UserID")
    )


def duplicate_commission_rules(commissions: DataFrame, ids_per_row: int = IDS_PER_ROW) -> DataFrame:
    """Product and tier pairs with several active rules; both lists in the order of the rule id, in numbered parts."""
    return (
        duplicate_groups(
            commissions.filter(F.col("IsActive")),
            ["ProductID", "MerchantTier"],
            "CommissionID",
            "RuleCount",
            "CommissionIDs",
            {"Percentages": plain_number(F.col("CommissionPercentage"))},
            ids_per_row=ids_per_row,
        )
        .select("ProductID", "MerchantTier", "RuleCount", "Part", "Parts", "Percentages", "CommissionIDs")
        .orderBy(F.col("RuleCount").desc(), "ProductID", "MerchantTier", "Part")
    )


def low_balances(wallets: DataFrame, users: DataFrame, up_to: int = 10) -> DataFrame:
    """Wallets holding at most ``up_to``; a balance of exactly that much is still 'Normal'."""
    balance = F.col("Balance")
    status = (
        F.when(balance < 0, "Negative Balance")
        .when(balance == 0, "Zero Balance")
        .when(balance < up_to, "Critically Low")
        .otherwise("Normal")
    )
    return (
        wallets.filter(balance <= up_to)
        .join(users.select("UserID", "FullName", "Role"), "UserID")
        .select("WalletID", "UserID", "FullName", "Role", "Balance", "LastUpdated", status.alias("BalanceStatus"))
        .orderBy("Balance", "WalletID")
    )


def _expired(as_of: datetime.date) -> Column:
    return F.col("ExpiryDate") < F.lit(as_of)


def expired_vouchers(
    vouchers: DataFrame, ledger: DataFrame, products: DataFrame, as_of: datetime.date
) -> DataFrame:
    """DaysUntilExpiry counts midnights and is negative."""
    sold = ledger.select("EntryID", "ProductID", F.col("CreatedTimestamp").alias("TransactionDate"))
    return (
        vouchers.filter(_expired(as_of))
        .join(sold, "EntryID")
        .join(products.select("ProductID", F.col("Description").alias("Product")), "ProductID")
        .select(
            "VoucherID",
            "EntryID",
            "TransactionDate",
            "ExpiryDate",
            F.datediff(F.to_date("ExpiryDate"), F.lit(as_of)).alias("DaysUntilExpiry"),
            "Product",
        )
        .orderBy("ExpiryDate", "VoucherID")
    )


def inconsistent_merchant_status(users: DataFrame, merchants: DataFrame) -> DataFrame:
    """Owner not active or profile not active; rows where both agree on that are included."""
    profiles = merchants.select("UserID", "MerchantID", "MerchantStatus", "BusinessName", "MerchantTier")
    return (
        users.select("UserID", "FullName", F.col("ServiceStatus").alias("UserStatus"))
        .join(profiles, "UserID")
        .filter(
            (F.col("UserStatus") != s.ACTIVE) | F.col("MerchantStatus").isin(s.SUSPENDED, s.DEACTIVATED, s.PENDING)
        )
        .orderBy("UserID", "MerchantID")
        .select("UserID", "FullName", "UserStatus", "MerchantStatus", "BusinessName", "MerchantTier")
    )


def orphaned_transactions(ledger: DataFrame, wallets: DataFrame) -> DataFrame:
    """Ledger rows without a wallet; rows with a null wallet never match and are kept."""
    return ledger.select("EntryID", "WalletID", "Amount", "CreatedTimestamp").join(
        wallets.select("WalletID"), "WalletID", "left_anti"
    ).select("EntryID", "WalletID", "Amount", "CreatedTimestamp")


def float_precision(ledger: DataFrame) -> DataFrame:
    """Commissions with more than two decimals."""
    extra = F.col("CommissionAmount") - F.round("CommissionAmount", 2)
    return (
        ledger.select(
            "EntryID",
            "Amount",
            "CommissionAmount",
            extra.alias("ExtraDecimals"),
            (F.col("Amount") * F.lit(Decimal("0.05"))).alias("Example5Percent"),
        )
        .filter(F.abs("ExtraDecimals") > F.lit(FLOAT_TOLERANCE))
        .orderBy(F.abs("ExtraDecimals").desc(), "EntryID")
    )


def missing_fk_vouchers(vouchers: DataFrame, ledger: DataFrame) -> DataFrame:
    return vouchers.select("VoucherID", "EntryID").join(ledger.select("EntryID"), "EntryID", "left_anti").select(
        "VoucherID", "EntryID"
    )


def hygiene_dashboard(
    ledger: DataFrame,
    users: DataFrame,
    commissions: DataFrame,
    wallets: DataFrame,
    vouchers: DataFrame,
    as_of: datetime.date,
) -> DataFrame:
    """One row per check. Duplicates are counted on the grouped rows, without listing their members."""

    def repeated(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > 1)

    # A null reference is a group, but COUNT DISTINCT does not count it.
    references = repeated(ledger.filter(F.col("ExternalReference").isNotNull()), "ExternalReference")
    checks = {
        "Duplicate External References": references,
        "Invalid MSISDN Formats": users.filter(_msisdn_invalid()),
        "Duplicate Commission Rules": repeated(commissions.filter(F.col("IsActive")), "ProductID", "MerchantTier"),
        "Negative Balances": wallets.filter(F.col("Balance") < 0),
        "Expired Vouchers": vouchers.filter(_expired(as_of)),
    }
    rows = [
        issues.agg(F.count("*").alias("IssueCount")).select(F.lit(name).alias("CheckName"), "IssueCount")
        for name, issues in checks.items()
    ]
    return reduce(DataFrame.unionAll, rows)
