"""What a batch of requests does to all tables it touches, to be published as one version (``sources.versions``).

Every function takes the tables of a version and a table of requests and returns the changes. They depend on these two alone: ids
of entries and pins are hashes of the request, other ids follow the largest one in an order of the requests. So a batch that is computed again
gives the same rows. What several tables need is written once, by a reliable checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reckon.functions.ordered import frozen, stored
from reckon.plans import merchants, products, rules, settlements, users, vouchers, wallets
from reckon.plans.requests import numbered
from reckon.sources.versions import Changes, VersionedTables, Versions, from_tables

Tables = Any


def _logged(t: Tables, *audits: DataFrame) -> DataFrame:
    """Audit rows with ids and the time of the batch; rows without a request are numbered by what they say."""
    said = ["TableAffected", "Action", "RecordID", "OldValue", "NewValue"]
    kept = ["RequestID", "UserID", *said]
    rows = [a.withColumn("RequestID", F.lit(None).cast("bigint")) if "RequestID" not in a.columns else a for a in audits]
    rows = reduce(DataFrame.unionByName, [a.select(*kept) for a in rows])
    return numbered(rows, t.audit, "LogID", ["RequestID", *said]).withColumn("Timestamp", F.lit(t.as_of).cast("timestamp_ntz"))


def _issue(t: Tables, issued: DataFrame) -> Changes:
    issued = stored(issued)
    new = numbered(issued.select("RequestID", "Unit", "EntryID", "PinData", "ExpiryDate"), t.vouchers, "VoucherID", ["RequestID", "Unit"])
    return Changes(replace={"wallets": vouchers.debit_wallets(t.wallets, issued)}, append={"ledger": issued, "vouchers": new})


def issue_vouchers(t: Tables, requests: DataFrame) -> Changes:
    """Debited wallets, ledger rows and vouchers, whatever the balances."""
    return _issue(t, vouchers.issue_vouchers(requests, t.wallets, t.products, t.commissions))


def issue_vouchers_checked(t: Tables, requests: DataFrame) -> Changes:
    """The same for what the wallets of active users can pay."""
    return _issue(t, vouchers.issue_vouchers_checked(requests, t.wallets, t.users, t.products, t.commissions))


def apply_topups(t: Tables, requests: DataFrame, by: int = 1) -> Changes:
    log = _logged(t, wallets.topup_audit(t.wallets, requests, by))
    return Changes(replace={"wallets": wallets.apply_topups(t.wallets, requests)}, append={"audit": log})


def calculate_settlements(t: Tables, requests: DataFrame) -> Changes:
    """Settlements are numbered on from those there are."""
    first, last = settlements.asked_days(requests)
    found = settlements.calculate_settlements(t.ledger_between(first, last), t.wallets, t.merchants, requests, t.as_of)
    found = found.withColumnRenamed("SettlementID", "RequestID")
    return Changes(append={"settlements": numbered(found, t.settlements, "SettlementID", ["RequestID"])})


def change_merchant_status(t: Tables, requests: DataFrame, by: int = 1) -> Changes:
    log = _logged(t, merchants.status_audit(t.merchants, requests, by))
    return Changes(replace={"merchants": merchants.change_merchant_status(t.merchants, requests)}, append={"audit": log})


def upsert_products(t: Tables, requests: DataFrame, by: int = 1) -> Changes:
    after = frozen(products.upsert_products(t.products, t.providers, requests))
    created = after.join(t.products.select("ProductID"), "ProductID", "left_anti")
    return Changes(replace={"products": after}, append={"audit": _logged(t, products.product_audit(created, by))})


def change_commission_rules(t: Tables, requests: DataFrame, by: int = 1) -> Changes:
    after = rules.change_commission_rules(t.commissions, t.products, requests, t.as_of)
    log = _logged(t, rules.rule_audit(t.commissions, t.products, requests, by))
    return Changes(replace={"commissions": after}, append={"audit": log})


def adjust_tier_rates(t: Tables, changes: dict[str, Decimal], by: int = 1) -> Changes:
    """Takes percentage points by tier instead of requests."""
    log = _logged(t, rules.rate_adjustment_audit(t.commissions, changes, by))
    return Changes(replace={"commissions": rules.adjust_tier_rates(t.commissions, changes)}, append={"audit": log})


def register_users(t: Tables, requests: DataFrame) -> Changes:
    """New users, each with an empty wallet."""
    new = frozen(users.register_users(t.users, requests))
    return Changes(append={"users": new, "wallets": users.wallets_for(new, t.wallets)})


def register_merchants(t: Tables, requests: DataFrame) -> Changes:
    return Changes(append={"merchants": merchants.register_merchants(t.merchants, t.users, requests)})


#: By the job's name, with the request table it takes.
BATCHES: dict[str, tuple[str, Callable[[Tables, DataFrame], Changes]]] = {
    "issue_vouchers": ("voucher_requests", issue_vouchers),
    "issue_vouchers_checked": ("voucher_requests", issue_vouchers_checked),
    "apply_topups": ("topup_requests", apply_topups),
    "calculate_settlements": ("settlement_requests", calculate_settlements),
    "change_merchant_status": ("status_requests", change_merchant_status),
    "upsert_products": ("product_requests", upsert_products),
    "change_commission_rules": ("rule_requests", change_commission_rules),
    "register_users": ("registration_requests", register_users),
    "register_merchants": ("merchant_requests", register_merchants),
}


def wallet_books(t: Tables) -> DataFrame:
    """Every wallet with its balance and what ledger, vouchers and audit log have of it."""
    # The mark comes after distinct(), else it is part of its key and the join shuffles the vouchers once more.
    entries = t.ledger.join(t.vouchers.select("EntryID").distinct().withColumn("_voucher", F.lit(1)), "EntryID", "left")
    of_wallet = entries.groupBy("WalletID").agg(
        F.count("*").alias("Entries"), F.sum("Amount").alias("Amount"), F.count("_voucher").alias("Vouchers")
    )
    topups = t.audit.filter(F.col("Action") == "TOPUP_WALLET").groupBy(F.col("RecordID").cast("bigint").alias("WalletID"))
    books = t.wallets.select("WalletID", "Balance").join(of_wallet, "WalletID", "left")
    books = books.join(topups.agg(F.count("*").alias("Topups")), "WalletID", "left")
    return books.fillna(0, ["Entries", "Amount", "Vouchers", "Topups"])


def books_after_batches(spark: SparkSession, t: Tables, folder: str) -> DataFrame:
    """The books after voucher requests and top-ups were published one after the other, in a new folder that starts with the tables."""
    from_tables(
        spark,
        folder,
        t,
        ledger=t.ledger.withColumn("EntryID", F.col("EntryID").cast("string")),  # new entries have text ids
        vouchers=t.vouchers.withColumn("EntryID", F.col("EntryID").cast("string")),
    )
    versions = Versions(spark, folder)
    for name in ("issue_vouchers", "apply_topups"):
        requests, change = BATCHES[name]
        versions.apply(name, lambda tables, requests=requests, change=change: change(tables, getattr(t, requests)), t.as_of)
    return wallet_books(VersionedTables(spark, folder, t.as_of))
