"""Read models of the platform's API as whole datasets.

Look-ups by id are the same datasets restricted to the ids in a key DataFrame, so one job serves any
number of keys. ``keys`` is a DataFrame with the id column, or None for all rows.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reckon import schemas as s
from reckon.operators.shared import Timeline, by_dimension, completed, first_rows, following

_USER = ["UserID", "MSISDN", "FullName", "Email", "Role", "AccountTier", "ServiceStatus", "CreatedAt"]
_WALLET = ["WalletID", "Balance", "CurrencyCode"]


def pick(df: DataFrame, key: str, keys: DataFrame | None) -> DataFrame:
    """The rows whose ``key`` occurs in ``keys``, which may repeat it.

    The keys are made distinct as a struct, so the join shuffles them once more: adaptive execution
    can split a hot key of ``df`` only when both sides of the join come straight from a shuffle.
    """
    if keys is None:
        return df
    distinct = keys.select(F.struct(key).alias("_key")).distinct().select(f"_key.{key}")
    return df.join(distinct, key, "left_semi")


def _wallet_of(wallets: DataFrame, *columns: str) -> DataFrame:
    return wallets.select("UserID", *columns)


def users_list(users: DataFrame) -> DataFrame:
    return users.select(*_USER)


def user_with_wallet(users: DataFrame, wallets: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    return pick(users, "UserID", keys).select(*_USER).join(_wallet_of(wallets, *_WALLET), "UserID", "left")


def merchant_directory(merchants: DataFrame, users: DataFrame) -> DataFrame:
    contact = users.select("UserID", "MSISDN", "FullName", "Email", "ServiceStatus")
    return merchants.join(contact, "UserID").orderBy("MerchantID")


def merchant_detail(
    merchants: DataFrame, users: DataFrame, wallets: DataFrame, keys: DataFrame | None = None
) -> DataFrame:
    contact = users.select("UserID", "MSISDN", "FullName", "Email", "ServiceStatus")
    return (
        pick(merchants, "MerchantID", keys)
        .join(contact, "UserID")
        .join(_wallet_of(wallets, *_WALLET), "UserID", "left")
    )


def merchant_transactions(
    ledger: DataFrame, wallets: DataFrame, merchants: DataFrame, keys: DataFrame | None = None
) -> DataFrame:
    """Ledger rows of the merchants, newest first."""
    profiles = pick(merchants, "MerchantID", keys).select("UserID", "MerchantID")
    held = _wallet_of(wallets, "WalletID").join(profiles, "UserID").select("WalletID", "MerchantID")
    return (
        ledger.join(held, "WalletID")
        .orderBy(F.col("CreatedTimestamp").desc(), "EntryID", "MerchantID")
        .select("MerchantID", *ledger.columns)
    )


def merchant_balance(
    wallets: DataFrame, users: DataFrame, merchants: DataFrame, keys: DataFrame | None = None
) -> DataFrame:
    profiles = pick(merchants, "MerchantID", keys).select("UserID", "BusinessName")
    return (
        _wallet_of(wallets, *_WALLET, "LastUpdated")
        .join(users.select("UserID"), "UserID")
        .join(profiles, "UserID")
        .select(*_WALLET, "LastUpdated", "BusinessName")
    )


def product_catalogue(products: DataFrame, providers: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Inactive products are included."""
    return pick(products, "ProductID", keys).join(
        providers.select("ProviderID", "ProviderName", "Category"), "ProviderID"
    )


def wallet_detail(wallets: DataFrame, users: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    return pick(wallets, "WalletID", keys).join(users.select("UserID", "FullName", "MSISDN", "ServiceStatus"), "UserID")


def _with_product(rows: DataFrame, products: DataFrame) -> DataFrame:
    return rows.join(
        products.select("ProductID", "SKU", F.col("Description").alias("ProductDescription")), "ProductID"
    )


def wallet_history(ledger: DataFrame, products: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Ledger rows of the wallets, newest first."""
    return _with_product(pick(ledger, "WalletID", keys), products).orderBy(
        F.col("CreatedTimestamp").desc(), "EntryID"
    )


def transactions_search(
    ledger: DataFrame, wallets: DataFrame | None = None, status: str | None = None
) -> DataFrame:
    """Ledger rows, newest first; each filter applies only when given. ``wallets`` has the WalletIDs asked for."""
    found = ledger
    if status is not None:
        found = found.filter(F.col("ProcessingStatus") == status)
    return pick(found, "WalletID", wallets).orderBy(F.col("CreatedTimestamp").desc(), "EntryID")


def transaction_detail(ledger: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    return pick(ledger, "EntryID", keys)


def _voucher_rows(vouchers: DataFrame, ledger: DataFrame) -> DataFrame:
    sold = ledger.select("EntryID", "WalletID", "ProductID", "Amount", "ExternalReference")
    return vouchers.join(sold, "EntryID")


def voucher_list(vouchers: DataFrame, ledger: DataFrame) -> DataFrame:
    """Newest voucher first; expired ones are included."""
    return _voucher_rows(vouchers, ledger).orderBy(F.col("VoucherID").desc())


def voucher_detail(vouchers: DataFrame, ledger: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    return _voucher_rows(pick(vouchers, "VoucherID", keys), ledger)


def commission_rules(commissions: DataFrame, products: DataFrame) -> DataFrame:
    return _with_product(commissions, products).orderBy("ProductID", "MerchantTier", "CommissionID")


def commission_detail(commissions: DataFrame, products: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    return _with_product(pick(commissions, "CommissionID", keys), products)


def _settlement_rows(settlements: DataFrame, merchants: DataFrame) -> DataFrame:
    return settlements.join(merchants.select("MerchantID", "BusinessName"), "MerchantID")


def settlement_list(settlements: DataFrame, merchants: DataFrame) -> DataFrame:
    return _settlement_rows(settlements, merchants).orderBy(F.col("CreatedAt").desc(), "SettlementID")


def settlement_detail(settlements: DataFrame, merchants: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    return _settlement_rows(pick(settlements, "SettlementID", keys), merchants)


def global_ledger(
    ledger: DataFrame, wallets: DataFrame, users: DataFrame, products: DataFrame, keys: DataFrame | None = None
) -> DataFrame:
    """Ledger rows with owner and product, newest first. ``keys`` has the UserIDs that the reader may see, or all."""
    held = wallets.select("WalletID", "UserID", F.col("Balance").alias("WalletBalance")).join(
        pick(users, "UserID", keys).select("UserID", "FullName", "Role"), "UserID"
    )
    return _with_product(ledger.join(held.drop("UserID"), "WalletID"), products).orderBy(
        F.col("CreatedTimestamp").desc(), "EntryID"
    )


def global_ledger_page(
    ledger: DataFrame | Timeline,
    wallets: DataFrame,
    users: DataFrame,
    products: DataFrame,
    n: int,
    after: tuple[datetime.datetime, object] | None = None,
) -> DataFrame:
    """The next n rows of ``global_ledger`` after a row (CreatedTimestamp, EntryID), from the newest on without one.

    Only a window of the ledger is read and only its n first rows are sorted, however long the list is.
    """
    owned = wallets.join(users.select("UserID"), "UserID", "left_semi").select("WalletID")

    def shown(window: DataFrame, whole: bool) -> DataFrame:
        return window.join(owned, "WalletID", "left_semi").join(products.select("ProductID"), "ProductID", "left_semi")

    return global_ledger(first_rows(following(ledger, after), n, shown), wallets, users, products)


def users_financial(users: DataFrame, wallets: DataFrame) -> DataFrame:
    return user_with_wallet(users, wallets).orderBy("UserID")


def merchant_financials(
    merchants: DataFrame, users: DataFrame, wallets: DataFrame, ledger: DataFrame
) -> DataFrame:
    """Number of ledger rows of any status and completed revenue, 0 without any; one ledger pass."""
    revenue = F.when(F.col("ProcessingStatus") == s.COMPLETED, F.col("Amount"))
    activity = by_dimension(
        ledger,
        "WalletID",
        {"TransactionCount": F.lit(1), "TotalRevenue": revenue},
        wallets.select("WalletID", "UserID"),
        ["UserID"],
    )
    return (
        merchants.join(users.select("UserID", "FullName", "Email", "ServiceStatus"), "UserID")
        .join(_wallet_of(wallets, "Balance", "CurrencyCode"), "UserID", "left")
        .join(activity, "UserID", "left")
        .withColumns(
            {
                "TransactionCount": F.coalesce("TransactionCount", F.lit(0)),
                "TotalRevenue": F.coalesce("TotalRevenue", F.lit(0)),
            }
        )
        .orderBy(F.col("TotalRevenue").desc(), "MerchantID")
    )


def settlements_admin(settlements: DataFrame, merchants: DataFrame, users: DataFrame) -> DataFrame:
    profiles = (
        merchants.select("MerchantID", "UserID", "BusinessName")
        .join(users.select("UserID", "FullName"), "UserID")
        .drop("UserID")
    )
    return settlements.join(profiles, "MerchantID").orderBy(F.col("CreatedAt").desc(), "SettlementID")


def revenue_report(ledger: DataFrame, products: DataFrame, providers: DataFrame) -> DataFrame:
    sold = products.select("ProductID", "ProviderID", "SKU", "Description").join(
        providers.select("ProviderID", "ProviderName"), "ProviderID"
    )
    totals = {
        "TotalTransactions": F.lit(1),
        "TotalRevenue": F.col("Amount"),
        "TotalCommission": F.col("CommissionAmount"),
    }
    return by_dimension(
        completed(ledger), "ProductID", totals, sold, ["ProviderName", "SKU", "Description"]
    ).orderBy(F.col("TotalRevenue").desc(), "SKU")


def top_merchants_report(
    ledger: DataFrame, wallets: DataFrame, users: DataFrame, merchants: DataFrame, n: int = 10
) -> DataFrame:
    groups = ["MerchantID", "BusinessName", "MerchantTier"]
    held = (
        wallets.select("WalletID", "UserID")
        .join(users.select("UserID"), "UserID")
        .join(merchants.select("UserID", *groups), "UserID")
    )
    totals = {
        "TransactionCount": F.lit(1),
        "TotalRevenue": F.col("Amount"),
        "TotalCommission": F.col("CommissionAmount"),
    }
    return (
        by_dimension(completed(ledger), "WalletID", totals, held, groups)
        .orderBy(F.col("TotalRevenue").desc(), "MerchantID")
        .limit(n)
    )


def audit_trail(audit: DataFrame, users: DataFrame) -> DataFrame:
    """Newest first; PerformedBy is null for unknown users."""
    performer = users.select("UserID", F.col("FullName").alias("PerformedBy"))
    return audit.join(performer, "UserID", "left").orderBy(F.col("Timestamp").desc(), "LogID")
