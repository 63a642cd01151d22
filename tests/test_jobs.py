import bisect
import datetime
import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from reckon.plans import changes, merchants, rules, settlements, validation, wallets
from reckon.sources import tables

T0 = datetime.datetime(2025, 1, 1)


@pytest.fixture(scope="module")
def busy(spark):
    """Merchant 1 owns two wallets and two thirds of the ledger."""
    rng = random.Random(11)
    entries = []
    for i in range(1500):
        minute = rng.choice([0, 0, rng.randrange(1440)])
        at = T0 + datetime.timedelta(days=rng.randrange(200), minutes=minute)
        status = rng.choice(["Completed", "Completed", "Failed"])
        entries.append((i, rng.choice([1, 1, 2, 3]), Decimal(rng.randrange(1, 900)), Decimal(rng.randrange(1, 90)), status, at))
    ledger = spark.createDataFrame(
        entries,
        "EntryID INT, WalletID INT, Amount DECIMAL(18,2), CommissionAmount DECIMAL(18,4), ProcessingStatus STRING,"
        " CreatedTimestamp TIMESTAMP_NTZ",
    )
    held = spark.createDataFrame([(1, 10), (2, 10), (3, 30)], "WalletID INT, UserID INT")
    owned = spark.createDataFrame([(1, 10), (3, 30), (4, 40)], "MerchantID INT, UserID INT")
    return ledger, held, owned


def brute(busy, requests):
    ledger, held, owned = (df.collect() for df in busy)
    user_of = {r["WalletID"]: r["UserID"] for r in held}
    merchant_of = {r["UserID"]: r["MerchantID"] for r in owned}
    result = {}
    for number, merchant, start, end in requests:
        lo, hi = (x if isinstance(x, datetime.datetime) else datetime.datetime.combine(x, datetime.time()) for x in (start, end))
        rows = [
            r for r in ledger
            if r["ProcessingStatus"] == "Completed" and merchant_of[user_of[r["WalletID"]]] == merchant
            and lo <= r["CreatedTimestamp"] <= hi
        ]
        gross = sum((r["Amount"] for r in rows), Decimal(0))
        commission = sum((r["CommissionAmount"] for r in rows), Decimal(0))
        result[number] = (gross, commission, gross - commission)
    return result


@pytest.mark.parametrize("kind, hot_rows", [("DATE", 10**6), ("TIMESTAMP_NTZ", 10**6), ("TIMESTAMP_NTZ", 50)])
def test_settlement_periods(spark, busy, kind, hot_rows):
    rng = random.Random(5)
    requests = []
    for number in range(120):
        start = T0 + datetime.timedelta(days=rng.randrange(-20, 220), minutes=rng.randrange(1440))
        end = start + datetime.timedelta(days=rng.randrange(-3, 150), minutes=rng.randrange(1440))
        if kind == "DATE":
            start, end = start.date(), end.date()
        requests.append((number, rng.choice([1, 1, 3, 4]), start, end))
    asked = spark.createDataFrame(requests, f"RequestID INT, MerchantID INT, PeriodStart {kind}, PeriodEnd {kind}")
    found = settlements.calculate_settlements(*busy, asked, T0.date(), hot_rows).collect()
    assert {r["SettlementID"]: (r["GrossAmount"], r["CommissionAmount"], r["NetAmount"]) for r in found} == brute(busy, requests)


@pytest.mark.parametrize("hot_rows", [10**6, 500])
def test_many_overlapping_periods_cost_one_pass(spark, hot_rows):
    """10,000 periods of one merchant: no row meets a period, every row is sorted once."""
    rng = random.Random(8)
    minute = lambda k: T0 + datetime.timedelta(minutes=k)
    rows = [(k, 1, Decimal(k % 17), Decimal(k % 5), "Completed", minute(rng.randrange(500) * 3)) for k in range(4000)]
    ledger = spark.createDataFrame(
        rows, "EntryID INT, WalletID INT, Amount DECIMAL(18,2), CommissionAmount DECIMAL(18,4), ProcessingStatus STRING, CreatedTimestamp TIMESTAMP_NTZ"
    )
    periods = [(k, 1, minute(a := rng.randrange(-5, 1500)), minute(a + rng.randrange(-3, 1200))) for k in range(10_000)]
    requests = spark.createDataFrame(periods, "RequestID INT, MerchantID INT, PeriodStart TIMESTAMP_NTZ, PeriodEnd TIMESTAMP_NTZ")
    held = spark.createDataFrame([(1, 1)], "WalletID INT, UserID INT"), spark.createDataFrame([(1, 1)], "UserID INT, MerchantID INT")
    found = settlements.calculate_settlements(ledger, *held, requests, T0.date(), hot_rows)
    times = sorted((r[5], r[2], r[3]) for r in rows)
    upto = lambda t, side: (bisect.bisect_left if side else bisect.bisect_right)(times, t, key=lambda r: r[0])
    totals = [(Decimal(0), Decimal(0))]
    for _, gross, commission in times:
        totals.append((totals[-1][0] + gross, totals[-1][1] + commission))
    expected = {}
    for k, _, start, end in periods:
        (a, b), (c, d) = totals[upto(start, True)], totals[upto(end, False)]
        expected[k] = (c - a, d - b) if start <= end else (0, 0)
    assert {r["SettlementID"]: (r["GrossAmount"], r["CommissionAmount"]) for r in found.collect()} == expected
    text = found._jdf.queryExecution().toString()
    assert "Generate" not in text and "PeriodEnd" not in "".join(line for line in text.splitlines() if "Join" in line)


def test_topups(spark, seed):
    requests = spark.createDataFrame(
        [(1, 1, Decimal("10.50"), T0), (2, 1, Decimal("4.50"), T0 + datetime.timedelta(days=1)), (3, 1, Decimal(0), T0),
         (4, 999, Decimal(5), T0), (5, 2, None, T0)],
        "RequestID INT, WalletID INT, Amount DECIMAL(18,2), RequestedAt TIMESTAMP_NTZ",
    )
    after = wallets.apply_topups(seed.wallets, requests).filter("WalletID <= 2").orderBy("WalletID").collect()
    assert [r["Balance"] for r in after] == [Decimal("530.50"), Decimal("531.00")]
    for hot_rows in (10**6, 1):
        audit = wallets.topup_audit(seed.wallets, requests, 7, hot_rows).orderBy("RequestID").collect()
        assert [(r["RequestID"], r["OldValue"], r["NewValue"]) for r in audit] == [(1, "515.5", "526"), (2, "526", "530.5")]
    outcomes = {r["RequestID"]: r["Reason"] for r in wallets.topup_outcomes(seed.wallets, requests).collect()}
    assert outcomes == {1: None, 2: None, 3: "nothing to add", 4: "wallet not found",
                        5: "nothing to add"}


def test_latest_status_wins(spark, seed):
    day = datetime.timedelta(days=1)
    requests = spark.createDataFrame(
        [(1, 1, "Suspended", T0 + day), (2, 1, "Deactivated", T0), (3, 2, "Closed", T0), (4, 99, "Active", T0)],
        "RequestID INT, MerchantID INT, NewStatus STRING, RequestedAt TIMESTAMP_NTZ",
    )
    after = merchants.change_merchant_status(seed.merchants, requests)
    changed = changes.table_diff(seed.merchants, after, "MerchantID", ["MerchantStatus"]).collect()
    assert [tuple(r) for r in changed] == [("1", "update", "MerchantStatus", "Active", "Suspended")]
    assert merchants.status_audit(seed.merchants, requests, 1).count() == 2
    reasons = {r["RequestID"]: r["Reason"] for r in merchants.status_rejections(seed.merchants, requests).collect()}
    assert reasons == {3: "unknown status", 4: "merchant not found"}


def test_diff_is_null_safe(spark):
    before = spark.createDataFrame([(1, "a", None), (2, None, 2), (3, "c", 3)], "id INT, x STRING, y INT")
    after = spark.createDataFrame([(1, None, None), (2, None, 2), (4, None, 9)], "id INT, x STRING, y INT")
    diff = {(r["RecordID"], r["Change"], r["ColumnName"], r["OldValue"], r["NewValue"])
            for r in changes.table_diff(before, after, "id", ["x", "y"]).collect()}
    assert diff == {("1", "update", "x", "a", None), ("3", "delete", "x", "c", None), ("3", "delete", "y", "3", None),
                    ("4", "insert", "y", None, "9")}


def test_diff_joins_only_buckets_that_differ(spark):
    before = spark.range(20_000).selectExpr("id", "id % 7 AS x", "CAST(id AS STRING) AS y")
    after = before.withColumn("x", F.expr("IF(id = 17, 100, x)")).filter("id <> 4000").union(spark.sql("SELECT 30000L, 1L, NULL"))
    buckets = {r[0] for r in changes.changed_buckets(before, after, "id", ["x", "y"], 512).collect()}
    of = spark.createDataFrame([(17,), (4000,), (30000,)], "id LONG").select(changes._bucket("id", 512))
    assert buckets == {r[0] for r in of.collect()}
    found = changes.table_diff(before, after, "id", ["x", "y"], 512)
    assert {tuple(r) for r in found.collect()} == {
        ("17", "update", "x", "3", "100"), ("4000", "delete", "x", "3", None), ("4000", "delete", "y", "4000", None), ("30000", "insert", "x", None, "1"),
    }
    text = found._sc._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "simple")
    assert text.count("LeftSemi") >= 2
    assert changes.table_diff(before, before, "id", ["x", "y"]).isEmpty()
    swapped = before.withColumns({"x": F.col("y").cast("long"), "y": F.col("x").cast("string")})
    assert changes.table_diff(before, swapped, "id", ["x", "y"], 1).count() == 2 * before.filter("x <> CAST(y AS LONG)").count()


def test_tier_adjustment(seed):
    after = rules.adjust_tier_rates(seed.commissions, {"Premium": Decimal("1.5"), "Standard": Decimal("-1")})
    rates = {(r["ProductID"], r["MerchantTier"]): r["CommissionPercentage"] for r in after.collect() if r["CommissionID"] != 31}
    assert rates[(1, "Premium")] == 5 and rates[(1, "Standard")] == 1 and rates[(1, "Enterprise")] == 5
    audit = rules.rate_adjustment_audit(seed.commissions, {"Premium": Decimal("1.50")}, 1).first()
    assert (audit["RulesUpdated"], audit["NewValue"]) == (10, "Tier Premium adjusted by 1.5%")
    with pytest.raises(ValueError, match="0.125"):
        rules.adjust_tier_rates(seed.commissions, {"Premium": Decimal("0.125")})
    assert rules.adjust_tier_rates(seed.commissions, {"Premium": Decimal("0.500")}).count() == 31


def test_accepted_and_rejected_partition_the_requests(data):
    checked = validation.validate_requests(data.voucher_requests, validation.voucher_rules())
    total = data.voucher_requests.count()
    assert validation.accepted(checked).count() + validation.rejected(checked).count() == total


def test_validation_rules(spark):
    sales = spark.createDataFrame(
        [("072 123 4567", Decimal(5), "1234567890123456"), ("+27123456789", Decimal(1000), "1234"), ("0000000000", Decimal("4.99"), None),
         (None, None, "1" * 17)],
        "Phone STRING, Amount DECIMAL(18,2), VoucherPin STRING",
    )
    reasons = [r["Reasons"] for r in validation.validate_requests(sales, validation.sale_rules()).collect()]
    assert [len(r) for r in reasons] == [0, 2, 3, 3]


def test_tables_round_trip(spark, seed, tmp_path):
    folder = str(tmp_path)
    for name in ("ledger", "vouchers", "wallets", "settlements"):
        tables.write_table(tables.conform(getattr(seed, name), name), folder, name)
    stored = tables.read_table(spark, folder, "ledger")
    assert stored.schema == seed.ledger.select(*stored.columns).schema or stored.count() == 5200
    assert stored.exceptAll(tables.conform(seed.ledger, "ledger")).count() == 0
    day = seed.now.date()
    last = tables.ledger_between(spark, folder, day, day)
    assert last.count() == seed.ledger.filter(F.to_date("CreatedTimestamp") == F.lit(day)).count() > 0
    tables.write_table(tables.conform(seed.ledger.limit(10), "ledger"), folder, "ledger", mode="append")
    assert tables.read_table(spark, folder, "ledger").count() == 5210


def test_json_export(spark, seed, tmp_path):
    tables.export_json(seed.ledger.filter("EntryID = 1"), str(tmp_path / "out"))
    line = spark.read.text(str(tmp_path / "out")).first()[0]
    assert '"Amount":5.00' in line and "T11:57:00.000" in line


def test_rule_requests_in_order(spark, seed):
    """Update 6, update 7, delete, update 8, delete: two audit rows and two rejections."""
    rule = seed.commissions.orderBy("CommissionID").first()
    asked = [("update", "6"), ("update", "7"), ("delete", None), ("update", "8"), ("delete", None)]
    rows = [
        (n, action, rule["CommissionID"], None, None, value and Decimal(value), None, T0 + datetime.timedelta(minutes=n))
        for n, (action, value) in enumerate(asked)
    ]
    columns = "RequestID LONG, Action STRING, CommissionID LONG, ProductID LONG, MerchantTier STRING, "
    requests = spark.createDataFrame(rows, columns + "CommissionPercentage DECIMAL(5,2), IsActive BOOLEAN, RequestedAt TIMESTAMP_NTZ")
    out = rules.rule_request_outcomes(seed.commissions, seed.products, requests).orderBy("RequestID").collect()
    assert [r["Outcome"] for r in out] == ["updated", "updated", "deleted", "rejected", "rejected"]
    assert [r["Reason"] for r in out[3:]] == ["rule not found"] * 2
    audit = rules.rule_audit(seed.commissions, seed.products, requests, 1).collect()
    before = f"{rule['CommissionPercentage'].normalize():f}"
    assert sorted((r["OldValue"], r["NewValue"]) for r in audit) == sorted([(before, "6"), ("6", "7")])


def test_settlements_read_asked_months_only(spark, data, tmp_path):
    from reckon.catalogue import QUERIES

    for attribute in ("ledger", "wallets", "merchants"):
        tables.write_table(getattr(data, attribute), str(tmp_path), attribute)
    one = data.settlement_requests.filter("PeriodStart >= DATE'1996-03-01' AND PeriodEnd <= DATE'1996-03-31'")
    tables.write_table(one, str(tmp_path), "settlement_requests")
    stored = tables.StoredTables(spark, str(tmp_path), data.as_of)
    plan = QUERIES["calculate_settlements"](stored)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*LedgerMonth", plan)


def test_line_breaks_do_not_pass(spark):
    from reckon.operators.defects import REFERENCE_PATTERN
    from reckon.plans import merchants, validation

    good = {
        validation.PHONE_PATTERN: "0721234567", validation.PIN_PATTERN: "1234567890123456", validation.MSISDN_PATTERN: "27821234567",
        merchants.REGISTRATION_PATTERN: "REG-2025-0001", REFERENCE_PATTERN: "TXN-17",
    }
    for pattern, text in good.items():
        found = spark.createDataFrame([(text,), (text + "\n",)], "t STRING").select(F.col("t").rlike(pattern)).collect()
        assert [r[0] for r in found] == [True, False], pattern


@pytest.mark.parametrize("newest", [True, False])
def test_ghosts_beyond_the_first_window(spark, newest):
    """Over a month of rows at the edge have vouchers, so the window must be widened."""
    from reckon.operators.reconciliation import ghost_most_recent, ghost_oldest

    rows = [(i, 1, Decimal(i), "Completed", T0 + datetime.timedelta(hours=i)) for i in range(3000)]
    columns = "EntryID INT, WalletID INT, Amount DECIMAL(18,2), ProcessingStatus STRING, CreatedTimestamp TIMESTAMP_NTZ"
    ledger = spark.createDataFrame(rows, columns)
    without = {5, 700, 1500, 2990} if newest else {2995, 1400, 900, 40}
    vouchers = spark.createDataFrame([(i,) for i in range(3000) if i not in without], "EntryID INT")
    found = (ghost_most_recent if newest else ghost_oldest)(ledger, vouchers, 3).collect()
    assert [r["EntryID"] for r in found] == sorted(without, reverse=newest)[:3]
    assert (ghost_most_recent if newest else ghost_oldest)(ledger, vouchers, 10).count() == 4
