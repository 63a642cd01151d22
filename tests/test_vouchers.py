"""Spending a balance in order: the fold, the rounds and a plain loop must agree."""

import datetime
import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from reckon.plans.vouchers import affordable, debit_wallets, issue_vouchers, issue_vouchers_checked

T0 = datetime.datetime(2025, 1, 1)


@pytest.fixture(scope="module")
def lines(spark):
    rng = random.Random(3)
    data = []
    for request in range(900):
        wallet = 1 if request % 3 == 0 else rng.randrange(2, 12)
        price = Decimal(rng.choice([5, 10, 15, 25, 30, 50, 100, 200]))
        for unit in range(1, rng.randrange(2, 6)):
            data.append((request, unit, f"e{request}-{unit}", wallet, price, T0 + datetime.timedelta(seconds=rng.randrange(400))))
    rng.shuffle(data)
    schema = "RequestID BIGINT, Unit INT, EntryID STRING, WalletID BIGINT, Amount DECIMAL(18,2), RequestedAt TIMESTAMP_NTZ"
    return spark.createDataFrame(data, schema)


@pytest.fixture(scope="module")
def wallets(spark):
    balances = [(1, "2613.00"), (2, "99999.00"), (3, "0.00"), (4, "-5.00"), (5, "12.50"), (6, "777.00"), (7, None),
                (8, "1234.00"), (9, "4.99"), (10, "310.00"), (11, "55.00")]
    return spark.createDataFrame([(w, b and Decimal(b)) for w, b in balances], "WalletID BIGINT, Balance DECIMAL(18,2)")


@pytest.fixture(scope="module")
def expected(lines, wallets):
    left = {r["WalletID"]: r["Balance"] for r in wallets.collect()}
    accepted = set()
    for line in sorted(lines.collect(), key=lambda r: (r["RequestedAt"], r["RequestID"], r["Unit"])):
        balance = left[line["WalletID"]]
        if balance is not None and line["Amount"] <= balance:
            left[line["WalletID"]] -= line["Amount"]
            accepted.add(line["EntryID"])
    return accepted


@pytest.mark.parametrize("fold_rows, hot_rows", [(10**6, 10**6), (300, 10**6), (0, 10**6), (0, 50)])
def test_affordable(lines, wallets, expected, settings, fold_rows, hot_rows):
    settings(spark__sql__adaptive__coalescePartitions__enabled="false", spark__sql__shuffle__partitions="5")
    found = affordable(lines, wallets, fold_rows, hot_rows)
    assert Counter(r["EntryID"] for r in found.collect()) == Counter(expected)


def test_debits_add_up_to_the_ledger(data):
    issued = issue_vouchers(data.voucher_requests, data.wallets, data.products, data.commissions)
    after = debit_wallets(data.wallets, issued)
    spent = data.wallets.agg(F.sum("Balance")).first()[0] - after.agg(F.sum("Balance")).first()[0]
    assert spent == issued.agg(F.sum("Amount")).first()[0]
    assert issued.select("EntryID").distinct().count() == issued.count()


def test_checked_issue_never_overdraws(data):
    issued = issue_vouchers_checked(
        data.voucher_requests, data.wallets, data.users, data.products, data.commissions
    )
    after = debit_wallets(data.wallets, issued).select("WalletID", F.col("Balance").alias("after"))
    worse = data.wallets.join(after, "WalletID").filter("after < Balance AND after < 0")
    assert issued.count() > 0 and worse.count() == 0


def test_single_request_keeps_its_reference(spark, seed):
    requests = spark.createDataFrame(
        [(1, 1, 1, None, "REF-1", T0), (2, 1, 2, 2, "REF-2", T0), (3, 0, 1, 1, "REF-3", T0), (4, 1, 1, 21, "REF-4", T0),
         (5, 1, 99, 1, "REF-5", T0)],
        "RequestID BIGINT, WalletID BIGINT, ProductID BIGINT, Quantity BIGINT, Reference STRING, RequestedAt TIMESTAMP_NTZ",
    )
    issued = issue_vouchers(requests, seed.wallets, seed.products, seed.commissions).orderBy("RequestID", "Unit")
    assert [(r["ExternalReference"], r["Amount"], r["CommissionAmount"]) for r in issued.collect()] == [
        ("REF-1", 5, Decimal("0.25")), ("REF-2-1", 10, Decimal("0.5")), ("REF-2-2", 10, Decimal("0.5"))
    ]


def test_falling_prices_need_few_rounds(spark):
    """One wallet, 2,000 prices that fall between cheap ones: rounds follow the balance, not the prices."""
    from reckon.plans.vouchers import _in_rounds

    left, data, expected = Decimal(2100), [], set()
    for n in range(4000):
        price = Decimal(2100 - n // 2) if n % 2 else Decimal(1)
        data.append((n, 1, f"e{n}", 1, price, T0 + datetime.timedelta(seconds=n)))
        if price <= left:
            left -= price
            expected.add(f"e{n}")
    schema = "RequestID BIGINT, Unit INT, EntryID STRING, WalletID BIGINT, Amount DECIMAL(18,2), RequestedAt TIMESTAMP_NTZ"
    funds = spark.createDataFrame([(1, Decimal(2100))], "WalletID BIGINT, _left DECIMAL(38,2)")
    rounds = _in_rounds(spark.createDataFrame(data, schema), funds, 10**6)
    assert len(rounds) <= 13
    assert Counter(r["EntryID"] for found in rounds for r in found.collect()) == Counter(expected)
