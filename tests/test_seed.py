"""The generated platform has the known defects in the known numbers."""

import datetime
from collections import Counter
from decimal import Decimal

from pyspark.sql import functions as F

from reckon.operators import commissions as com
from reckon.operators import defects, hygiene, reports
from reckon.operators import reconciliation as rec
from reckon.sources.seed import price, rate


def one(df):
    return tuple(df.first())


def by(df, *columns):
    return {row[0]: tuple(row[1:]) if len(row) > 2 else row[1] for row in df.select(*columns).collect()}


def test_table_sizes(seed):
    assert seed.users.count() == 55
    assert seed.merchants.count() == 22
    assert seed.commissions.count() == 31
    assert seed.ledger.count() == 5200
    assert seed.vouchers.count() == 4720
    assert seed.vouchers.agg(F.max("VoucherID")).first()[0] == 4720


def plain_ledger(seed):
    """(entry, wallet, product, provider, amount, status) by the rules of the platform."""
    provider = by(seed.products, "ProductID", "ProviderID")
    rows = []
    for t in range(1, 5201):
        product = (t - 1) % 10 + 1
        status = "Failed" if t % 200 == 0 else "Pending" if t % 75 == 0 else "Completed"
        rows.append((t, (t - 1) % 55 + 1, product, provider[product], price(product), status))
    return rows


def plain_ghosts(seed):
    """Completed rows without a voucher: every thirteenth, from the oldest on."""
    paid = sorted((r for r in plain_ledger(seed) if r[5] == "Completed"), key=lambda r: -r[0])  # higher entries are older
    return paid[12::13]


def test_statuses(seed):
    totals = by(reports.status_totals(seed.ledger), "ProcessingStatus", "TotalTransactions", "TotalValue")
    expected = {}
    for *_, amount, status in plain_ledger(seed):
        n, total = expected.get(status, (0, 0))
        expected[status] = n + 1, total + amount
    assert totals == expected and expected["Completed"][0] == 5113


def test_ghosts(seed):
    plain = plain_ghosts(seed)
    assert one(rec.ghost_count(seed.ledger, seed.vouchers)) == (len(plain),) == (393,)
    assert one(rec.ghost_total_impact(seed.ledger, seed.vouchers)) == (sum(r[4] for r in plain),)
    providers = rec.ghost_by_provider(seed.ledger, seed.vouchers, seed.products, seed.providers)
    assert by(providers, "ProviderName", "GhostCount", "TotalAmount") == {
        f"Carrier {p}": (sum(r[3] == p for r in plain), sum(r[4] for r in plain if r[3] == p)) for p in range(1, 5)
    }
    products = rec.ghost_by_product(seed.ledger, seed.vouchers, seed.products).select("GhostCount").collect()
    assert sorted(r[0] for r in products) == sorted(Counter(r[2] for r in plain).values())
    assert by(rec.ghost_by_status(seed.ledger, seed.vouchers), "ProcessingStatus", "GhostCount") == {
        "Completed": 393, "Pending": 61, "Failed": 26
    }
    assert rec.ghost_duplicate_refs(seed.ledger, seed.vouchers).count() == 0
    low = rec.ghost_low_balance(seed.ledger, seed.vouchers, seed.wallets)
    assert by(low, "WalletID", "GhostCount") == {w: n for w in (10, 30) if (n := sum(r[1] == w for r in plain))}
    assert rec.ghost_negative_balance(seed.ledger, seed.vouchers, seed.wallets).count() == sum(r[1] == 30 for r in plain)


def test_ghost_reports_agree(seed):
    total = one(rec.ghost_count(seed.ledger, seed.vouchers))[0]
    impact = one(rec.ghost_total_impact(seed.ledger, seed.vouchers))[0]
    wallets = rec.ghost_by_wallet(seed.ledger, seed.vouchers)
    assert one(wallets.agg(F.sum("GhostCount"), F.sum("TotalLostAmount"))) == (total, impact)
    for report in (
        rec.ghost_by_product(seed.ledger, seed.vouchers, seed.products),
        rec.ghost_daily(seed.ledger, seed.vouchers),
        rec.ghost_by_user(seed.ledger, seed.vouchers, seed.wallets, seed.users),
    ):
        assert one(report.agg(F.sum("GhostCount"))) == (total,)


def test_reports_over_stored_ghosts(seed):
    from reckon.operators.shared import ghosts

    stored = ghosts(seed.ledger, seed.vouchers)
    assert one(rec.ghost_count(stored, None)) == (393,)
    assert by(rec.ghost_by_status(stored, None), "ProcessingStatus", "GhostCount")["Pending"] == 61


def test_commissions(seed):
    """Commissions are paid at the Standard rate, so all rows of the other tiers are wrong."""
    tables = (seed.ledger, seed.wallets, seed.merchants, seed.commissions)
    total, correct, percentage = one(com.commission_accuracy(*tables))
    tiers = by(com.mismatches_by_tier(*tables), "EffectiveTier", "TotalTransactions", "Mismatches")
    assert tiers["Premium"][0] == tiers["Premium"][1] > 0 and tiers["Enterprise"][0] == tiers["Enterprise"][1] > 0
    # rows of the product with two Standard rules are charged by both, and one of them does not fit
    newest = [t for t in range(1, 1001)]
    of_standard = [t for t in newest if not 11 <= (t - 1) % 55 + 1 <= 25]
    twice = sum((t - 1) % 10 + 1 == 4 for t in of_standard)
    assert tiers["Standard"] == (len(of_standard) + twice, twice)
    assert (total, correct) == (1000 + twice, len(of_standard)) and percentage == round(Decimal(100 * correct) / total, 2)
    assert one(com.enterprise_tier_check(*tables))[:2] == (sum(19 <= r[1] <= 25 for r in plain_ledger(seed)),) * 2
    assert one(com.premium_tier_check(*tables)) == (sum(11 <= r[1] <= 18 for r in plain_ledger(seed)),) * 2
    assert one(com.duplicate_rule_impact(seed.ledger))[1:] == (0, None)
    pending = [r for r in plain_ledger(seed) if r[5] == "Pending"]
    assert one(com.pending_with_commission(seed.ledger)) == (61, sum(r[4] * rate(r[2], 0) / 100 for r in pending))


def test_hygiene(seed):
    duplicates = hygiene.duplicate_references(seed.ledger)
    assert duplicates.count() == 10
    assert duplicates.filter("ExternalReference = 'TXN-499'").first()["AffectedEntryIDs"] == "499, 500"
    rules = hygiene.duplicate_commission_rules(seed.commissions).collect()
    low, high = rate(4, 0).normalize(), (rate(4, 0) + 2).normalize()
    assert [tuple(r) for r in rules] == [(4, "Standard", 2, 1, 1, f"{low:f}, {high:f}", "4, 31")]
    invalid = by(hygiene.invalid_msisdn(seed.users), "UserID", "Length", "IssueType")
    assert invalid == {40: (9, "Wrong length"), 45: (13, "Wrong length"), 50: (11, "Other issue")}
    today = seed.now.date()
    assert hygiene.expired_vouchers(seed.vouchers, seed.ledger, seed.products, today).count() == 174
    assert 0 < hygiene.float_precision(seed.ledger).count() < 5200
    assert hygiene.orphaned_transactions(seed.ledger, seed.wallets).count() == 0
    dashboard = hygiene.hygiene_dashboard(
        seed.ledger, seed.users, seed.commissions, seed.wallets, seed.vouchers, today
    )
    assert by(dashboard, "CheckName", "IssueCount") == {
        "Duplicate External References": 10,
        "Invalid MSISDN Formats": 3,
        "Duplicate Commission Rules": 1,
        "Negative Balances": 1,
        "Expired Vouchers": 174,
    }


def test_reports_and_defects(seed):
    revenue = by(reports.revenue_by_provider(seed.ledger, seed.products, seed.providers), "ProviderName", "TotalRevenue")
    paid = [r for r in plain_ledger(seed) if r[5] == "Completed"]
    assert revenue == {f"Carrier {p}": sum(r[4] for r in paid if r[3] == p) for p in range(1, 5)}
    assert defects.settlement_math_mismatch(seed.settlements).count() == 3
    assert defects.null_balances(seed.wallets.withColumn("Balance", F.nullif("Balance", F.lit(5))), seed.users).count() == 1


def test_balance_on_the_limit_is_normal(seed):
    wallets = seed.wallets.filter("WalletID <= 3").withColumn(
        "Balance", F.element_at(F.array(*[F.lit(Decimal(v)).cast("decimal(18,2)") for v in (10, 0, 9)]), F.col("WalletID").cast("int"))
    )
    statuses = by(hygiene.low_balances(wallets, seed.users), "WalletID", "BalanceStatus")
    assert statuses == {1: "Normal", 2: "Zero Balance", 3: "Critically Low"}


def test_larger_seed_scales_by_rule(spark):
    from reckon.sources.seed import Seed

    tables = Seed(spark, datetime.datetime(2025, 6, 1), transactions=20_000)
    assert tables.ledger.count() == 20_000
    completed = tables.ledger.filter("ProcessingStatus = 'Completed'").count()
    assert tables.vouchers.count() == completed - completed // 13
