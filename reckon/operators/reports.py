"""Business reports. Totals are taken per wallet or product before any join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reckon.operators.shared import by_dimension, completed

TOP = 10


def _merchant_totals(
    facts: DataFrame, wallets: DataFrame, merchants: DataFrame, sums: dict[str, Column], groups: list[str]
) -> DataFrame:
    held = wallets.select("WalletID", "UserID").join(merchants.select("UserID", *groups), "UserID")
    return by_dimension(facts, "WalletID", sums, held, groups)


def _product_totals(
    facts: DataFrame, products: DataFrame, sums: dict[str, Column], groups: list[str]
) -> DataFrame:
    return by_dimension(facts, "ProductID", sums, products.select("ProductID", *groups), groups)


def top10_merchants_revenue(ledger: DataFrame, wallets: DataFrame, merchants: DataFrame, n: int = TOP) -> DataFrame:
    return (
        _merchant_totals(
            completed(ledger), wallets, merchants, {"TotalRevenue": F.col("Amount")}, ["MerchantID", "BusinessName"]
        )
        .orderBy(F.col("TotalRevenue").desc(), "MerchantID")
        .limit(n)
    )


def top10_merchants_net(ledger: DataFrame, wallets: DataFrame, merchants: DataFrame, n: int = TOP) -> DataFrame:
    """Revenue after commission."""
    net = {"NetRevenue": F.col("Amount") - F.col("CommissionAmount")}
    return (
        _merchant_totals(completed(ledger), wallets, merchants, net, ["MerchantID", "BusinessName"])
        .orderBy(F.col("NetRevenue").desc(), "MerchantID")
        .limit(n)
    )


def merchant_volume_ranking(ledger: DataFrame, wallets: DataFrame, merchants: DataFrame) -> DataFrame:
    """Rows of every status."""
    return _merchant_totals(
        ledger, wallets, merchants, {"TransactionCount": F.lit(1)}, ["MerchantID", "BusinessName"]
    ).orderBy(F.col("TransactionCount").desc(), "MerchantID")


def revenue_by_tier(ledger: DataFrame, wallets: DataFrame, merchants: DataFrame) -> DataFrame:
    return _merchant_totals(
        completed(ledger), wallets, merchants, {"TotalRevenue": F.col("Amount")}, ["MerchantTier"]
    ).orderBy(F.col("TotalRevenue").desc(), "MerchantTier")


def revenue_by_provider(ledger: DataFrame, products: DataFrame, providers: DataFrame) -> DataFrame:
    sold = products.select("ProductID", "ProviderID").join(
        providers.select("ProviderID", "ProviderName"), "ProviderID"
    )
    return by_dimension(
        completed(ledger), "ProductID", {"TotalRevenue": F.col("Amount")}, sold, ["ProviderName"]
    ).orderBy(F.col("TotalRevenue").desc(), "ProviderName")


def product_revenue(ledger: DataFrame, products: DataFrame) -> DataFrame:
    return _product_totals(
        completed(ledger), products, {"Revenue": F.col("Amount")}, ["SKU", "Description"]
    ).orderBy(F.col("Revenue").desc(), "SKU")


def bottom10_skus_revenue(ledger: DataFrame, products: DataFrame, n: int = TOP) -> DataFrame:
    """Products without sales do not appear."""
    return (
        _product_totals(completed(ledger), products, {"TotalRevenue": F.col("Amount")}, ["SKU", "Description"])
        .orderBy("TotalRevenue", "SKU")
        .limit(n)
    )


def bottom10_skus_volume(ledger: DataFrame, products: DataFrame, n: int = TOP) -> DataFrame:
    return (
        _product_totals(completed(ledger), products, {"SalesCount": F.lit(1)}, ["SKU"])
        .orderBy("SalesCount", "SKU")
        .limit(n)
    )


def monthly_revenue(ledger: DataFrame) -> DataFrame:
    return (
        completed(ledger)
        .groupBy(F.date_format("CreatedTimestamp", "yyyy-MM").alias("Month"))
        .agg(F.sum("Amount").alias("TotalRevenue"))
        .orderBy("Month")
    )


def status_totals(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("ProcessingStatus").agg(
        F.count("*").alias("TotalTransactions"), F.sum("Amount").alias("TotalValue")
    )
