"""Every query by name, as a function of a table set.

A table set is any object with the canonical tables and request tables as lazy DataFrame attributes and
the date ``as_of``: ``TestData`` over the star-schema files or ``StoredTables`` over canonical Parquet.
``ledger_amounts`` is the ledger without CommissionAmount, for sources where that column costs a join. ``timeline`` and
``timeline_amounts`` are the same two by time, with the number of rows of each day (``shared.Timeline``).
"""

from __future__ import annotations

import datetime
from collections.abc import Callable
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reckon import schemas as s
from reckon.operators import commissions as com
from reckon.operators import defects, hygiene, reports
from reckon.operators import readmodels as views
from reckon.operators import reconciliation as rec
from reckon.plans import batches, changes, ghosts, merchants, products, rules, settlements, users, validation, vouchers, wallets
from reckon.session import scratch_folder
from reckon.sources.seed import vouchers_skip_nth
from reckon.sources.versions import Versions

Tables = Any

ADMIN = 1

# What a caller may set, as ``options`` of the table set; these hold otherwise.
OPTIONS: dict[str, Any] = {
    "rapid_seconds": 60,  # rows of a wallet and product this close are rapid duplicates
    "tier_changes": {},  # tier -> percentage points that adjust_tier_rates adds
    "status": None,  # of transactions_search
    "wallets": None,  # of transactions_search and wallet_history: a DataFrame of WalletIDs, or those overdrawn
    "merchants": None,  # of the look-ups by merchant: a DataFrame of MerchantIDs, or those with status requests
    "page": 500,  # rows of a page of the ledger
    "users": None,  # of the look-up by user: a DataFrame of UserIDs, or those with a merchant profile
}


def option(t: Tables, name: str) -> Any:
    return {**OPTIONS, **getattr(t, "options", {})}[name]


def _asked(t: Tables, name: str, otherwise: DataFrame) -> DataFrame:
    """The keys that an option gives, or others."""
    keys = option(t, name)
    return otherwise if keys is None else keys


def _wanted_wallets(t: Tables) -> DataFrame:
    """The wallets asked for, or those that are overdrawn."""
    return _asked(t, "wallets", t.wallets.filter(F.col("Balance") < 0).select("WalletID"))


def _rows(t: Tables, attribute: str, key: str, keys: DataFrame) -> DataFrame:
    """Rows by id: stored tables skip files that cannot hold an id, other sources join."""
    return t.rows_of(attribute, key, keys) if hasattr(t, "rows_of") else views.pick(getattr(t, attribute), key, keys)


def _transactions_of(t: Tables, merchants_: DataFrame) -> DataFrame:
    profiles = _rows(t, "merchants", "MerchantID", merchants_)
    held = _rows(t, "wallets", "UserID", profiles)
    return views.merchant_transactions(_rows(t, "ledger", "WalletID", held), held, profiles)


def _ledger_of_users(t: Tables, users_: DataFrame) -> DataFrame:
    held = _rows(t, "wallets", "UserID", users_)
    return views.global_ledger(_rows(t, "ledger", "WalletID", held), held, t.users, t.products, users_)


def _second_page(t: Tables, size: int) -> DataFrame:
    """The page after the newest one; the last row of a page is where the next one begins."""
    tables = (t.timeline, t.wallets, t.users, t.products)
    first = views.global_ledger_page(*tables, size)
    last = first.orderBy(F.col("CreatedTimestamp"), F.desc("EntryID")).select("CreatedTimestamp", "EntryID").first()
    return views.global_ledger_page(*tables, size, None if last is None else tuple(last))


_RECONCILIATION: dict[str, Callable[[Tables], DataFrame]] = {
    "ghost_count": lambda t: rec.ghost_count(t.ledger_amounts, t.vouchers),
    "ghost_total_impact": lambda t: rec.ghost_total_impact(t.ledger_amounts, t.vouchers),
    "ghost_by_wallet": lambda t: rec.ghost_by_wallet(t.ledger_amounts, t.vouchers),
    "ghost_by_user": lambda t: rec.ghost_by_user(t.ledger_amounts, t.vouchers, t.wallets, t.users),
    "ghost_by_product": lambda t: rec.ghost_by_product(t.ledger_amounts, t.vouchers, t.products),
    "ghost_by_provider": lambda t: rec.ghost_by_provider(t.ledger_amounts, t.vouchers, t.products, t.providers),
    "ghost_by_status": lambda t: rec.ghost_by_status(t.ledger_amounts, t.vouchers),
    "ghost_daily": lambda t: rec.ghost_daily(t.ledger_amounts, t.vouchers),
    "ghost_commission_impact": lambda t: rec.ghost_commission_impact(t.ledger, t.vouchers),
    "ghost_duplicate_refs": lambda t: rec.ghost_duplicate_refs(t.ledger_amounts, t.vouchers),
    "ghost_low_balance": lambda t: rec.ghost_low_balance(t.ledger_amounts, t.vouchers, t.wallets),
    "ghost_negative_balance": lambda t: rec.ghost_negative_balance(t.ledger_amounts, t.vouchers, t.wallets),
    "ghost_most_recent": lambda t: rec.ghost_most_recent(t.timeline_amounts, t.vouchers),
    "ghost_oldest": lambda t: rec.ghost_oldest(t.timeline_amounts, t.vouchers),
}

_COMMISSIONS: dict[str, Callable[[Tables], DataFrame]] = {
    "commission_mismatches_recent": lambda t: com.commission_mismatches_recent(
        t.timeline, t.wallets, t.users, t.merchants, t.products, t.commissions
    ),
    "commission_accuracy": lambda t: com.commission_accuracy(t.timeline, t.wallets, t.merchants, t.commissions),
    "mismatches_by_tier": lambda t: com.mismatches_by_tier(t.timeline, t.wallets, t.merchants, t.commissions),
    "mismatches_by_product": lambda t: com.mismatches_by_product(
        t.timeline, t.wallets, t.merchants, t.products, t.commissions
    ),
    "mismatches_by_provider": lambda t: com.mismatches_by_provider(
        t.timeline, t.wallets, t.merchants, t.products, t.providers, t.commissions
    ),
    "expected_vs_actual": lambda t: com.expected_vs_actual(
        t.timeline, t.wallets, t.merchants, t.products, t.commissions
    ),
    "duplicate_rule_impact": lambda t: com.duplicate_rule_impact(t.ledger),
    "duplicate_rule_impact_as_rate": lambda t: com.duplicate_rule_impact(t.ledger, as_rate=True),
    "wrong_tier_used": lambda t: com.wrong_tier_used(t.timeline, t.wallets, t.merchants, t.products, t.commissions),
    "commission_error_impact": lambda t: com.commission_error_impact(
        t.timeline, t.wallets, t.merchants, t.commissions
    ),
    "top_merchants_errors": lambda t: com.top_merchants_errors(t.timeline, t.wallets, t.merchants, t.commissions),
    "accuracy_by_month": lambda t: com.accuracy_by_month(t.ledger, t.wallets, t.merchants, t.commissions),
    "pending_with_commission": lambda t: com.pending_with_commission(t.ledger),
    "enterprise_tier_check": lambda t: com.enterprise_tier_check(t.ledger, t.wallets, t.merchants, t.commissions),
    "premium_tier_check": lambda t: com.premium_tier_check(t.ledger, t.wallets, t.merchants, t.commissions),
    "validation_report": lambda t: com.validation_report(t.timeline, t.wallets, t.merchants, t.commissions),
    "first_active_rule": lambda t: com.first_active_rule(t.commissions),
}

_HYGIENE: dict[str, Callable[[Tables], DataFrame]] = {
    "duplicate_references": lambda t: hygiene.duplicate_references(t.ledger_amounts),
    "invalid_msisdn": lambda t: hygiene.invalid_msisdn(t.users),
    "duplicate_commission_rules": lambda t: hygiene.duplicate_commission_rules(t.commissions),
    "low_balances": lambda t: hygiene.low_balances(t.wallets, t.users),
    "expired_vouchers": lambda t: hygiene.expired_vouchers(t.vouchers, t.ledger_amounts, t.products, t.as_of),
    "inconsistent_merchant_status": lambda t: hygiene.inconsistent_merchant_status(t.users, t.merchants),
    "orphaned_transactions": lambda t: hygiene.orphaned_transactions(t.ledger_amounts, t.wallets),
    "float_precision": lambda t: hygiene.float_precision(t.ledger),
    "missing_fk_vouchers": lambda t: hygiene.missing_fk_vouchers(t.vouchers, t.ledger_amounts),
    "hygiene_dashboard": lambda t: hygiene.hygiene_dashboard(
        t.ledger_amounts, t.users, t.commissions, t.wallets, t.vouchers, t.as_of
    ),
}

_REPORTS: dict[str, Callable[[Tables], DataFrame]] = {
    "top10_merchants_revenue": lambda t: reports.top10_merchants_revenue(t.ledger_amounts, t.wallets, t.merchants),
    "top10_merchants_net": lambda t: reports.top10_merchants_net(t.ledger, t.wallets, t.merchants),
    "merchant_volume_ranking": lambda t: reports.merchant_volume_ranking(t.ledger_amounts, t.wallets, t.merchants),
    "revenue_by_tier": lambda t: reports.revenue_by_tier(t.ledger_amounts, t.wallets, t.merchants),
    "revenue_by_provider": lambda t: reports.revenue_by_provider(t.ledger_amounts, t.products, t.providers),
    "product_revenue": lambda t: reports.product_revenue(t.ledger_amounts, t.products),
    "bottom10_skus_revenue": lambda t: reports.bottom10_skus_revenue(t.ledger_amounts, t.products),
    "bottom10_skus_volume": lambda t: reports.bottom10_skus_volume(t.ledger_amounts, t.products),
    "monthly_revenue": lambda t: reports.monthly_revenue(t.ledger_amounts),
    "status_totals": lambda t: reports.status_totals(t.ledger_amounts),
}

_READ_MODELS: dict[str, Callable[[Tables], DataFrame]] = {
    "users_list": lambda t: views.users_list(t.users),
    "user_with_wallet": lambda t: views.user_with_wallet(t.users, t.wallets),
    "user_with_wallet_of_users": lambda t: views.user_with_wallet(
        _rows(t, "users", "UserID", _asked(t, "users", t.merchants)), t.wallets
    ),
    "merchant_directory": lambda t: views.merchant_directory(t.merchants, t.users),
    "merchant_detail": lambda t: views.merchant_detail(t.merchants, t.users, t.wallets, t.status_requests),
    "merchant_transactions": lambda t: views.merchant_transactions(t.ledger, t.wallets, t.merchants),
    "merchant_transactions_of_merchants": lambda t: _transactions_of(t, _asked(t, "merchants", t.status_requests)),
    "merchant_balance": lambda t: views.merchant_balance(t.wallets, t.users, t.merchants),
    "merchant_balance_of_merchants": lambda t: views.merchant_balance(
        t.wallets, t.users, _rows(t, "merchants", "MerchantID", _asked(t, "merchants", t.status_requests))
    ),
    "product_catalogue": lambda t: views.product_catalogue(t.products, t.providers),
    "product_detail": lambda t: views.product_catalogue(t.products, t.providers, t.voucher_requests),
    "wallet_detail": lambda t: views.wallet_detail(t.wallets, t.users, t.topup_requests),
    "wallet_history": lambda t: views.wallet_history(t.ledger, t.products),
    "wallet_history_of_wallets": lambda t: views.wallet_history(
        _rows(t, "ledger", "WalletID", _wanted_wallets(t)), t.products
    ),
    "transactions_search": lambda t: views.transactions_search(t.ledger, status=option(t, "status")),
    "transactions_search_of_wallets": lambda t: views.transactions_search(
        t.ledger, _wanted_wallets(t), option(t, "status")
    ),
    "transaction_detail": lambda t: views.transaction_detail(t.ledger, t.vouchers),
    "voucher_list": lambda t: views.voucher_list(t.vouchers, t.ledger_amounts),
    "voucher_detail": lambda t: views.voucher_detail(
        t.vouchers, t.ledger_amounts, t.vouchers.filter(F.col("ExpiryDate") < F.lit(t.as_of))
    ),
    "commission_rules": lambda t: views.commission_rules(t.commissions, t.products),
    "commission_detail": lambda t: views.commission_detail(t.commissions, t.products, t.rule_requests),
    "settlement_list": lambda t: views.settlement_list(t.settlements, t.merchants),
    "settlement_detail": lambda t: views.settlement_detail(
        t.settlements, t.merchants, defects.settlement_math_mismatch(t.settlements)
    ),
    "global_ledger": lambda t: views.global_ledger(t.ledger, t.wallets, t.users, t.products),
    "global_ledger_of_users": lambda t: _ledger_of_users(t, _asked(t, "users", t.merchants)),
    "global_ledger_second_page": lambda t: _second_page(t, option(t, "page")),
    "users_financial": lambda t: views.users_financial(t.users, t.wallets),
    "merchant_financials": lambda t: views.merchant_financials(t.merchants, t.users, t.wallets, t.ledger_amounts),
    "settlements_admin": lambda t: views.settlements_admin(t.settlements, t.merchants, t.users),
    "revenue_report": lambda t: views.revenue_report(t.ledger, t.products, t.providers),
    "top_merchants_report": lambda t: views.top_merchants_report(t.ledger, t.wallets, t.users, t.merchants),
    "audit_trail": lambda t: views.audit_trail(t.audit, t.users),
}

_DEFECTS: dict[str, Callable[[Tables], DataFrame]] = {
    "settlement_math_mismatch": lambda t: defects.settlement_math_mismatch(t.settlements),
    "inactive_users_transacting": lambda t: defects.inactive_users_transacting(t.ledger_amounts, t.wallets, t.users),
    "overdrawn_transactions": lambda t: defects.overdrawn_transactions(t.ledger_amounts, t.wallets),
    "rapid_duplicates": lambda t: defects.rapid_duplicates(
        t.ledger_amounts, datetime.timedelta(seconds=option(t, "rapid_seconds"))
    ),
    "bad_references": lambda t: defects.bad_references(t.voucher_requests, "RequestID", "Reference"),
    "float_drift": lambda t: defects.float_drift(t.ledger),
    "null_balances": lambda t: defects.null_balances(t.wallets, t.users),
    "active_vouchers": lambda t: defects.active_vouchers(t.vouchers, t.ledger_amounts, t.as_of),
    "duplicate_msisdn": lambda t: defects.duplicate_msisdn(
        t.users.select("MSISDN").unionByName(t.registration_requests.select("MSISDN"))
    ),
    "validate_requests": lambda t: validation.request_report(
        t.voucher_requests, t.topup_requests, t.sale_requests, t.registration_requests
    ),
}


def _rules_after(t: Tables) -> DataFrame:
    return rules.change_commission_rules(t.commissions, t.products, t.rule_requests, t.as_of)


def _issued(t: Tables) -> DataFrame:
    return vouchers.issue_vouchers(t.voucher_requests, t.wallets, t.products, t.commissions)


def _settled(t: Tables, requests: DataFrame) -> DataFrame:
    """Only the part of the ledger that the requests ask for is read."""
    first, last = settlements.asked_days(requests)
    return settlements.calculate_settlements(t.ledger_between(first, last), t.wallets, t.merchants, requests, t.as_of)


_JOBS: dict[str, Callable[[Tables], DataFrame]] = {
    "issue_vouchers": _issued,
    "issue_vouchers_balances": lambda t: vouchers.debit_wallets(t.wallets, _issued(t)),
    "issue_vouchers_rejected": lambda t: vouchers.voucher_rejections(t.voucher_requests, t.wallets, t.products),
    "issue_vouchers_checked": lambda t: vouchers.issue_vouchers_checked(
        t.voucher_requests, t.wallets, t.users, t.products, t.commissions
    ),
    "calculate_settlements": lambda t: _settled(t, t.settlement_requests),
    "calculate_settlements_by_time": lambda t: _settled(t, t.timed_settlement_requests),
    "apply_topups": lambda t: wallets.apply_topups(t.wallets, t.topup_requests),
    "apply_topups_audit": lambda t: wallets.topup_audit(t.wallets, t.topup_requests, ADMIN),
    "apply_topups_rejected": lambda t: wallets.topup_outcomes(t.wallets, t.topup_requests)
    .filter(F.col("Reason").isNotNull())
    .select("RequestID", "WalletID", "Amount", "RequestedAt", "Reason"),
    "change_merchant_status": lambda t: merchants.change_merchant_status(t.merchants, t.status_requests),
    "change_merchant_status_audit": lambda t: merchants.status_audit(t.merchants, t.status_requests, ADMIN),
    "change_merchant_status_rejected": lambda t: merchants.status_rejections(t.merchants, t.status_requests),
    "upsert_products": lambda t: products.upsert_products(t.products, t.providers, t.product_requests),
    "upsert_products_outcomes": lambda t: products.product_request_outcomes(
        t.products, t.providers, t.product_requests
    ),
    "upsert_products_audit": lambda t: products.product_audit(
        products.created_products(t.products, t.providers, t.product_requests), ADMIN
    ),
    "change_commission_rules": _rules_after,
    "change_commission_rules_outcomes": lambda t: rules.rule_request_outcomes(
        t.commissions, t.products, t.rule_requests
    ),
    "change_commission_rules_audit": lambda t: rules.rule_audit(t.commissions, t.products, t.rule_requests, ADMIN),
    "adjust_tier_rates": lambda t: rules.adjust_tier_rates(t.commissions, option(t, "tier_changes")),
    "adjust_tier_rates_audit": lambda t: rules.rate_adjustment_audit(t.commissions, option(t, "tier_changes"), ADMIN),
    "register_users": lambda t: users.register_users(t.users, t.registration_requests),
    "register_users_outcomes": lambda t: users.registration_outcomes(t.users, t.registration_requests),
    "register_users_wallets": lambda t: users.wallets_for(
        users.register_users(t.users, t.registration_requests), t.wallets
    ),
    "register_merchants": lambda t: merchants.register_merchants(t.merchants, t.users, t.merchant_requests),
    "register_merchants_outcomes": lambda t: merchants.merchant_registration_outcomes(
        t.merchants, t.users, t.merchant_requests
    ),
    "books_after_batches": lambda t: batches.books_after_batches(t.spark, t, scratch_folder(t.spark, "versions")),
    "ghosts_after_increments": lambda t: ghosts.ghosts_after_increments(
        t, Versions(t.spark, scratch_folder(t.spark, "ghosts"))
    ),
    "audit_rows": lambda t: changes.table_diff(
        t.commissions,
        _rules_after(t),
        "CommissionID",
        ["ProductID", "MerchantTier", "CommissionPercentage", "EffectiveDate", "IsActive"],
    ),
    "vouchers_skip_nth": lambda t: vouchers_skip_nth(t.ledger_amounts, t.as_of),
}

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {
    **_RECONCILIATION, **_COMMISSIONS, **_HYGIENE, **_REPORTS, **_READ_MODELS, **_DEFECTS, **_JOBS
}
