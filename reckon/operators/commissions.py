"""Validation of applied commissions against the rule table."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reckon import schemas as s
from reckon.functions.money import (
    CENT,
    commission_error,
    expected_commission,
    is_correct,
    is_mismatch,
    percentage,
)
from reckon.operators.shared import Timeline, owners, recent, with_rules


def _recent_with_rules(
    ledger: DataFrame | Timeline,
    wallets: DataFrame,
    merchants: DataFrame,
    commissions: DataFrame,
    n: int,
    products: DataFrame | None = None,
) -> DataFrame:
    return with_rules(recent(ledger, wallets, merchants, n, products=products), commissions)


def commission_mismatches_recent(
    ledger: DataFrame | Timeline,
    wallets: DataFrame,
    users: DataFrame,
    merchants: DataFrame,
    products: DataFrame,
    commissions: DataFrame,
    n: int = 1000,
) -> DataFrame:
    """Recent rows whose commission is off the expectation rounded to cents."""
    expected = F.round(expected_commission(), 2)
    return (
        with_rules(recent(ledger, wallets, merchants, n, users), commissions)
        .join(products.select("ProductID", F.col("Description").alias("Product")), "ProductID")
        .select(
            "EntryID",
            "FullName",
            "EffectiveTier",
            "Product",
            "Amount",
            F.col("CommissionAmount").alias("AppliedCommission"),
            "CommissionPercentage",
            expected.alias("ExpectedCommission"),
            F.abs(F.col("CommissionAmount") - expected).alias("Difference"),
        )
        .filter(F.col("Difference") > F.lit(CENT))
        .orderBy(F.col("Difference").desc(), "EntryID", "CommissionPercentage")
    )


def commission_accuracy(
    ledger: DataFrame | Timeline, wallets: DataFrame, merchants: DataFrame, commissions: DataFrame, n: int = 1000
) -> DataFrame:
    return (
        _recent_with_rules(ledger, wallets, merchants, commissions, n)
        .agg(F.count("*").alias("TotalTransactions"), F.sum(is_correct().cast("bigint")).alias("CorrectCommissions"))
        .withColumn("AccuracyPercentage", percentage(F.col("CorrectCommissions"), F.col("TotalTransactions")))
    )


def _total_and_mismatches() -> list:
    return [F.count("*").alias("TotalTransactions"), F.count_if(is_mismatch()).alias("Mismatches")]


def mismatches_by_tier(
    ledger: DataFrame | Timeline, wallets: DataFrame, merchants: DataFrame, commissions: DataFrame, n: int = 1000
) -> DataFrame:
    return (
        _recent_with_rules(ledger, wallets, merchants, commissions, n)
        .groupBy("EffectiveTier")
        .agg(*_total_and_mismatches())
        .withColumn("MismatchPercentage", percentage(F.col("Mismatches"), F.col("TotalTransactions")))
        .orderBy(F.col("MismatchPercentage").desc(), "EffectiveTier")
    )


def mismatches_by_product(
    ledger: DataFrame | Timeline,
    wallets: DataFrame,
    merchants: DataFrame,
    products: DataFrame,
    commissions: DataFrame,
    n: int = 1000,
) -> DataFrame:
    return (
        _recent_with_rules(ledger, wallets, merchants, commissions, n)
        .join(products.select("ProductID", "Description"), "ProductID")
        .groupBy("Description")
        .agg(*_total_and_mismatches())
        .orderBy(F.col("Mismatches").desc(), "Description")
    )


def mismatches_by_provider(
    ledger: DataFrame | Timeline,
    wallets: DataFrame,
    merchants: DataFrame,
    products: DataFrame,
    providers: DataFrame,
    commissions: DataFrame,
    n: int = 1000,
) -> DataFrame:
    """Only rows with a known product count towards the limit."""
    return (
        _recent_with_rules(ledger, wallets, merchants, commissions, n, products)
        .join(products.select("ProductID", "ProviderID"), "ProductID")
        .join(providers.select("ProviderID", "ProviderName"), "ProviderID")
        .groupBy("ProviderName")
        .agg(*_total_and_mismatches())
        .orderBy(F.col("Mismatches").desc(), "ProviderName")
    )


def expected_vs_actual(
    ledger: DataFrame | Timeline,
    wallets: DataFrame,
    merchants: DataFrame,
    products: DataFrame,
    commissions: DataFrame,
    n: int = 200,
) -> DataFrame:
    """Only rows with a known product count towards the limit."""
    return (
        _recent_with_rules(ledger, wallets, merchants, commissions, n, products)
        .filter(is_mismatch())
        .join(products.select("ProductID", "Description"), "ProductID")
        .select(
            "EntryID",
            "Description",
            "EffectiveTier",
            "Amount",
            F.col("CommissionAmount").alias("AppliedCommission"),
            F.round(expected_commission(), 2).alias("ExpectedCommission"),
            F.round(commission_error(), 2).alias("Difference"),
        )
        .orderBy(F.col("Difference").desc(), "EntryID", "ExpectedCommission")
    )


def duplicate_rule_impact(
    ledger: DataFrame, product_id: int = 2, value: Decimal = Decimal("6.00"), as_rate: bool = False
) -> DataFrame:
    """Rows of a product whose commission is ``value``, or with ``as_rate`` that percentage of the amount."""
    target = F.col("Amount") * F.lit(value) * F.lit(CENT) if as_rate else F.lit(value)
    return (
        ledger.filter((F.col("ProductID") == product_id) & (F.abs(F.col("CommissionAmount") - target) < F.lit(CENT)))
        .agg(
            F.count("*").alias("AffectedTransactions"),
            F.sum("CommissionAmount").alias("TotalCommissionApplied"),
        )
        .select(
            F.lit(f"Duplicate Commission Rule (Product {product_id} - {s.STANDARD})").alias("Issue"),
            "AffectedTransactions",
            "TotalCommissionApplied",
        )
    )


def wrong_tier_used(
    ledger: DataFrame | Timeline,
    wallets: DataFrame,
    merchants: DataFrame,
    products: DataFrame,
    commissions: DataFrame,
    n: int = 1000,
) -> DataFrame:
    """Recent rows whose commission a rule of another tier explains."""
    rules = commissions.filter(F.col("IsActive")).select(
        "ProductID", F.col("MerchantTier").alias("CommissionTierUsed"), "CommissionPercentage"
    )
    return (
        recent(ledger, wallets, merchants, n)
        .join(rules, "ProductID")
        .filter((F.col("EffectiveTier") != F.col("CommissionTierUsed")) & is_correct())
        .join(products.select("ProductID", "Description"), "ProductID")
        .select(
            "EntryID",
            F.col("EffectiveTier").alias("ActualTier"),
            "CommissionTierUsed",
            "Description",
            "CommissionAmount",
        )
    )


def commission_error_impact(
    ledger: DataFrame | Timeline, wallets: DataFrame, merchants: DataFrame, commissions: DataFrame, n: int = 1000
) -> DataFrame:
    surplus = F.col("CommissionAmount") - expected_commission()
    return (
        _recent_with_rules(ledger, wallets, merchants, commissions, n)
        .filter(is_mismatch())
        .agg(
            F.sum(commission_error()).alias("TotalAbsoluteError"),
            F.sum(F.when(surplus > 0, surplus).otherwise(0)).alias("OverCommission"),
            F.sum(F.when(surplus < 0, -surplus).otherwise(0)).alias("UnderCommission"),
        )
    )


def top_merchants_errors(
    ledger: DataFrame | Timeline, wallets: DataFrame, merchants: DataFrame, commissions: DataFrame, n: int = 1000
) -> DataFrame:
    """Profiles are joined once more after the recent rows, as every profile of the owner is charged."""
    profiles = merchants.select("UserID", F.col("BusinessName").alias("Charged"))
    return (
        _recent_with_rules(ledger, wallets, merchants, commissions, n)
        .filter(is_mismatch())
        .join(profiles, "UserID")
        .groupBy(F.col("Charged").alias("BusinessName"))
        .agg(F.count("*").alias("TransactionsWithError"), F.sum(commission_error()).alias("TotalErrorAmount"))
        .orderBy(F.col("TotalErrorAmount").desc(), "BusinessName")
    )


def accuracy_by_month(
    ledger: DataFrame, wallets: DataFrame, merchants: DataFrame, commissions: DataFrame
) -> DataFrame:
    """Whole ledger, every status."""
    time = F.col("CreatedTimestamp")
    return (
        with_rules(ledger.join(owners(wallets, merchants), "WalletID"), commissions)
        .groupBy(F.year(time).alias("TransactionYear"), F.month(time).alias("TransactionMonth"))
        .agg(F.count("*").alias("TotalTransactions"), F.count_if(is_correct()).alias("_correct"))
        .withColumn("AccuracyPercentage", percentage(F.col("_correct"), F.col("TotalTransactions")))
        .drop("_correct")
        .orderBy(F.col("TransactionYear").desc(), F.col("TransactionMonth").desc())
    )


def pending_with_commission(ledger: DataFrame) -> DataFrame:
    return ledger.filter((F.col("ProcessingStatus") == s.PENDING) & (F.col("CommissionAmount") > 0)).agg(
        F.count("*").alias("PendingTransactionsWithCommission"),
        F.sum("CommissionAmount").alias("TotalCommissionInPending"),
    )


def tier_check(
    ledger: DataFrame, wallets: DataFrame, merchants: DataFrame, commissions: DataFrame, tier: str
) -> DataFrame:
    """Mismatches over all ledger rows of merchants of ``tier``; sums are null without rows."""
    held = owners(wallets, merchants).filter(F.col("MerchantTier") == tier)
    checked = with_rules(ledger.join(held, "WalletID"), commissions)
    return checked.agg(
        F.count("*").alias(f"{tier}Transactions"), F.sum(is_mismatch().cast("bigint")).alias("Mismatches")
    )


def enterprise_tier_check(
    ledger: DataFrame, wallets: DataFrame, merchants: DataFrame, commissions: DataFrame
) -> DataFrame:
    return tier_check(ledger, wallets, merchants, commissions, s.ENTERPRISE).withColumn(
        "MismatchPct", percentage(F.col("Mismatches"), F.col("EnterpriseTransactions"))
    )


def premium_tier_check(
    ledger: DataFrame, wallets: DataFrame, merchants: DataFrame, commissions: DataFrame
) -> DataFrame:
    return tier_check(ledger, wallets, merchants, commissions, s.PREMIUM)


def validation_report(
    ledger: DataFrame | Timeline, wallets: DataFrame, merchants: DataFrame, commissions: DataFrame, n: int = 1000
) -> DataFrame:
    """TotalFinancialError adds the deviations of all rows, also those within a cent."""
    return (
        _recent_with_rules(ledger, wallets, merchants, commissions, n)
        .agg(
            F.count("*").alias("TotalTransactions"),
            F.sum(is_correct().cast("bigint")).alias("CorrectCount"),
            F.round(F.sum(commission_error()), 2).alias("TotalFinancialError"),
        )
        .select(
            "TotalTransactions",
            "CorrectCount",
            percentage(F.col("CorrectCount"), F.col("TotalTransactions")).alias("AccuracyPercentage"),
            "TotalFinancialError",
        )
    )


def first_active_rule(commissions: DataFrame) -> DataFrame:
    """The active rule with the lowest id per product and tier, as issuance picks it."""
    return (
        commissions.filter(F.col("IsActive"))
        .groupBy("ProductID", "MerchantTier")
        .agg(
            F.min("CommissionID").alias("CommissionID"),
            F.min_by("CommissionPercentage", "CommissionID").alias("CommissionPercentage"),
        )
    )
