"""Look-ups by id read only the files that can hold it."""

import re

import pytest
from compare import rows_of_spark
from pyspark.sql import functions as F

import __spark_entry__ as entry
from reckon.catalogue import QUERIES
from reckon.sources import tables, versions
from reckon.sources.tables import StoredTables, seek

LEDGER = "TransactionLedger"


def plan(df, mode="formatted"):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def scanned(df):
    """Rows that came out of the file scans, after skipped files and row groups."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    total, todo = 0, [leaves.apply(i) for i in range(leaves.size())]
    while todo:
        node = todo.pop()
        if "QueryStage" in node.nodeName():
            inner = node.plan().collectLeaves()
            todo += [inner.apply(i) for i in range(inner.size())]
        elif "Scan" in node.nodeName():
            total += node.metrics().apply("numOutputRows").value()
    return total


@pytest.fixture(scope="module")
def folder(spark, data, tmp_path_factory):
    target = str(tmp_path_factory.mktemp("lookups"))
    for name in tables.NAMES:
        tables.write_table(tables.conform(getattr(data, name), name), target, name, wallet_buckets=8 if name == "ledger" else 0)
    for name in tables.REQUESTS:
        tables.write_table(getattr(data, name), target, name)
    return target


@pytest.fixture
def stored(spark, data, folder):
    return StoredTables(spark, folder, data.as_of, data.options)


def ids(spark, name, values):
    return spark.createDataFrame([(v,) for v in values], f"{name} BIGINT")


def test_wallet_rows_are_sought_in_their_bucket(spark, data, stored):
    wallet = data.ledger.filter("WalletID IS NOT NULL").first()["WalletID"]
    found = stored.rows_of("ledger", "WalletID", ids(spark, "WalletID", [wallet, wallet, None]))
    text = plan(found)
    assert re.search(r"PartitionFilters: \[.*WalletOf8", text) and re.search(r"PushedFilters: \[.*\(WalletID", text)
    expected = data.ledger.filter(F.col("WalletID") == wallet)
    assert found.columns == expected.columns and found.count() == expected.count()
    assert scanned(found) < data.ledger.count() / 4


def test_other_buckets_are_not_opened(spark, data, tmp_path):
    tables.write_table(tables.conform(data.ledger, "ledger"), str(tmp_path), "ledger", wallet_buckets=4)
    stored = StoredTables(spark, str(tmp_path), data.as_of)
    wallet = data.ledger.first()["WalletID"]
    keys = ids(spark, "WalletID", [wallet])
    own = keys.select(tables._bucket(4)).first()[0]
    for path in tmp_path.glob(f"{LEDGER}/LedgerMonth=*/WalletOf4={(own + 1) % 4}"):
        (path / "part-broken.parquet").write_bytes(b"no parquet")
    assert stored.rows_of("ledger", "WalletID", keys).count() == data.ledger.filter(F.col("WalletID") == wallet).count()


def test_bloom_filters_skip_entries(spark, data, stored):
    """Entry ids lie in any order, so only the bloom filters tell where one is."""
    some = [r["EntryID"] for r in data.ledger.orderBy(F.xxhash64("EntryID")).limit(3).collect()]
    found = stored.rows_of("ledger", "EntryID", ids(spark, "EntryID", some))
    assert sorted(r["EntryID"] for r in found.collect()) == sorted(some)
    assert scanned(found) < data.ledger.count() / 4
    none = stored.rows_of("ledger", "EntryID", ids(spark, "EntryID", [10**12 + k for k in range(5)]))
    assert none.count() == 0 and scanned(none) < data.ledger.count() / 4


def test_many_keys_are_joined(spark, data, stored):
    keys = data.ledger.select("WalletID").limit(40)
    few, many = (seek(stored.ledger, "WalletID", keys, stored._ledger_parts(), most) for most in (1000, 3))
    assert "LeftSemi" in plan(many, "simple") and "LeftSemi" not in plan(few, "simple")
    assert rows_of_spark(entry._published(few)) == rows_of_spark(entry._published(many))
    assert seek(stored.ledger, "WalletID", keys.limit(0), stored._ledger_parts()).count() == 0


KEYED = [
    "user_with_wallet_of_users", "merchant_transactions_of_merchants", "merchant_balance_of_merchants", "wallet_history_of_wallets",
    "transaction_detail", "voucher_detail", "ghost_most_recent", "accuracy_by_month",
]


@pytest.mark.parametrize("name", KEYED)
def test_results_do_not_depend_on_the_layout(data, stored, name):
    dates = lambda df: df.withColumns({f.name: F.to_date(f.name) for f in df.schema.fields if "timestamp" in f.dataType.simpleString()})
    as_dates = [dates(entry._published(QUERIES[name](t))) for t in (stored, data)]
    kinds = [{f.name: f.dataType.simpleString() for f in df.schema.fields} for df in as_dates]
    assert kinds[0] == kinds[1]
    assert rows_of_spark(as_dates[0]) == rows_of_spark(as_dates[1])


def test_asked_keys(spark, data, stored):
    wallet = data.ledger.first()["WalletID"]
    stored.options = {"wallets": ids(spark, "WalletID", [wallet])}
    found = QUERIES["wallet_history_of_wallets"](stored)
    assert {r["WalletID"] for r in found.collect()} == {wallet}
    assert re.search(r"PartitionFilters: \[.*WalletOf8", plan(found))


def test_versions_keep_the_buckets(spark, data, tmp_path):
    text = {k: getattr(data, k).withColumn("EntryID", F.col("EntryID").cast("string")) for k in ("ledger", "vouchers")}
    store = versions.Versions(spark, str(tmp_path), wallet_buckets=4)
    store.commit("import", versions.Changes(replace=text | {"wallets": data.wallets}), store.manifest())
    t = versions.VersionedTables(spark, str(tmp_path), data.as_of)
    wallet = data.ledger.first()["WalletID"]
    found = t.rows_of("ledger", "WalletID", ids(spark, "WalletID", [wallet]))
    assert re.search(r"PartitionFilters: \[.*WalletOf4", plan(found))
    assert found.count() == data.ledger.filter(F.col("WalletID") == wallet).count()
    assert t.rows_of("ledger", "EntryID", data.ledger.limit(5).select(F.col("EntryID").cast("string"))).count() == 5
