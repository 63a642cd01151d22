"""The physical plans keep the properties that matter at scale."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from reckon.catalogue import QUERIES as OWN
from reckon.functions.ordered import frozen
from reckon.operators import commissions as com
from reckon.operators import reconciliation as rec
from reckon.operators import reports
from reckon.operators.readmodels import pick
from reckon.operators.shared import Timeline, between, days_of, first_rows, ghosts, listed, owners, recent, time_windows
from reckon.plans.wallets import topup_outcomes
from reckon.sources import tables

SMALL = "/root/testdata/sf0.001"
# These number new rows, which broadcasts one offset per sort partition, or broadcast groups they counted.
BOUNDED = {
    "duplicate_references", "duplicate_commission_rules",
    "vouchers_skip_nth", "register_users", "register_users_wallets", "register_merchants", "upsert_products",
    "upsert_products_audit", "change_commission_rules", "audit_rows",
}


def plan(df, mode="formatted"):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


@pytest.fixture(scope="module")
def stored(spark, seed, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    for name in ("ledger", "vouchers", "wallets", "merchants", "products", "commissions", "users", "providers"):
        tables.write_table(tables.conform(getattr(seed, name), name), folder, name)
    return folder


def read(spark, stored):
    names = ("ledger", "vouchers", "wallets", "merchants", "products", "commissions")
    return [tables.read_table(spark, stored, name) for name in names]


def test_ghosts_push_the_status_and_prune_columns(spark, stored):
    ledger, vouchers, *_ = read(spark, stored)
    text = plan(rec.ghost_total_impact(ledger, vouchers))
    assert "EqualTo(ProcessingStatus,Completed)" in text
    assert "LeftAnti" in text
    assert "ReadSchema: struct<EntryID:bigint,Amount:decimal(18,2),ProcessingStatus:string>" in text
    assert "ReadSchema: struct<EntryID:bigint>" in text


def test_period_reads_only_its_months(spark, stored):
    text = plan(tables.ledger_between(spark, stored, datetime.date(2025, 6, 1), datetime.date(2025, 6, 30)))
    assert re.search(r"PartitionFilters: \[.*LedgerMonth", text)


def test_no_query_forces_a_broadcast_or_crosses_or_leaves_the_jvm(spark, settings):
    settings(spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1")
    queries = entry.queries()
    for name in OWN:
        text = plan(queries[name](spark, SMALL), "simple")
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name
        assert "Python" not in text and "InPandas" not in text, name
        assert name in BOUNDED or "BroadcastHashJoin" not in text, name


def test_totals_are_taken_before_the_join(spark, stored, settings):
    settings(spark__sql__autoBroadcastJoinThreshold="-1")
    ledger, _, wallets, merchants, *_ = read(spark, stored)
    text = plan(reports.revenue_by_tier(ledger, wallets, merchants), "simple")
    below_join = text[text.index("SortMergeJoin"):]
    assert "partial_sum(Amount" in below_join


def test_newest_rows_come_from_the_count_table(spark, stored, settings):
    """Only months of the window are read, in the window itself and in every job that finds it."""
    settings(spark__sql__autoBroadcastJoinThreshold="-1")
    timeline = tables.StoredTables(spark, stored, datetime.date(2025, 6, 1)).timeline
    window, whole = next(time_windows(timeline, 10))
    assert not whole and re.search(r"PartitionFilters: \[.*LedgerMonth#\d+ >= ", plan(window))
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(CreatedTimestamp", plan(window))
    window, _ = next(time_windows(timeline, 10, newest=False))
    assert re.search(r"PartitionFilters: \[.*LedgerMonth#\d+ <= ", plan(window))
    assert re.search(r"PushedFilters: \[.*LessThan\(CreatedTimestamp", plan(window))


def test_other_months_are_not_read(spark, seed, tmp_path):
    """A file that cannot be read lies in a month between the newest and the oldest rows."""
    folder = str(tmp_path)
    day = F.expr("make_interval(0, 0, 0, CAST(EntryID % 900 AS INT))")
    ledger = seed.ledger.withColumn("CreatedTimestamp", F.lit(datetime.datetime(2022, 1, 1)).cast("timestamp_ntz") + day)
    for name in ("vouchers", "wallets", "merchants", "commissions"):
        tables.write_table(tables.conform(getattr(seed, name), name), folder, name)
    tables.write_table(tables.conform(ledger, "ledger"), folder, "ledger")
    stored = tables.StoredTables(spark, folder, datetime.date(2025, 6, 1))
    days = stored.timeline.days
    assert sum(n for _, n in days) == ledger.count() and days == sorted(days)
    months = sorted((tmp_path / "TransactionLedger").glob("LedgerMonth=*"))
    (months[len(months) // 2] / "part-broken.parquet").write_bytes(b"no parquet")
    expected = OWN["ghost_most_recent"](stored).collect(), OWN["ghost_oldest"](stored).collect()
    assert [len(rows) for rows in expected] == [10, 10]
    assert [r["EntryID"] for r in expected[0]] == [r["EntryID"] for r in rec.ghost_most_recent(ledger, seed.vouchers).collect()]
    assert [r["EntryID"] for r in expected[1]] == [r["EntryID"] for r in rec.ghost_oldest(ledger, seed.vouchers).collect()]
    few = com.commission_accuracy(stored.timeline, stored.wallets, stored.merchants, stored.commissions, 20)
    assert few.collect() == com.commission_accuracy(ledger, seed.wallets, seed.merchants, seed.commissions, 20).collect()


def test_busy_day_is_cut_to_the_minute(spark):
    rows = spark.range(20_000).select(
        F.col("id").alias("EntryID"), F.expr("TIMESTAMP_NTZ'2025-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id * 4)").alias("CreatedTimestamp")
    )
    for newest, first in ((True, 19_999), (False, 0)):
        window, whole = next(time_windows(Timeline.of(rows), 5, newest))
        assert not whole and 10 <= window.count() <= 30
        found = first_rows(rows, 5, lambda window, _: window, newest).collect()
        assert [r["EntryID"] for r in found] == [first - k if newest else k for k in range(5)]


@pytest.mark.parametrize("days", [[], [("1999-01-01", 7)], [("2025-01-01", 1_000_000)], [("2030-01-01", 5), (None, 3)]])
def test_counts_that_are_not_up_to_date(spark, tiny, days):
    """They place the window badly, but the rows found stay right."""
    ledger, wallets, merchants = tiny
    counts = spark.createDataFrame(days, "Day STRING, Entries LONG").selectExpr("CAST(Day AS DATE) AS Day", "Entries")
    timeline = Timeline(lambda first, last: between(ledger, first, last), listed(lambda: counts))
    assert newest(recent(timeline, wallets, merchants, 4)) == [(5, None), (4, 5), (4, 6), (3, None)]
    assert newest(recent(timeline, wallets, merchants, 50))[0] == (5, None)


@pytest.mark.parametrize("size", [1, 3, 7, 500])
def test_pages_make_up_the_list(spark, data, size):
    """Page after page, the list comes out whole and in order; rows of one instant are split between pages."""
    from reckon.operators.readmodels import global_ledger, global_ledger_page

    ledger = data.ledger.filter("EntryID % 50 = 1").withColumn("CreatedTimestamp", F.date_trunc("year", "CreatedTimestamp").cast("timestamp_ntz"))
    rows = frozen(ledger.limit(20 if size < 500 else 2000))
    tables = (data.wallets, data.users, data.products)
    whole = [r["EntryID"] for r in global_ledger(rows, *tables).collect()]
    timeline, found, after = Timeline.of(rows), [], None
    while True:
        page = global_ledger_page(timeline, *tables, size, after).collect()
        assert len(page) <= size
        if not page:
            break
        found += [r["EntryID"] for r in page]
        after = page[-1]["CreatedTimestamp"], page[-1]["EntryID"]
    assert found == whole


def test_counts_are_appended_with_the_rows(spark, tiny, tmp_path):
    ledger = tables.conform(tiny[0].withColumns({"ExternalReference": F.lit("x"), "ProcessingStatus": F.lit("Completed")}), "ledger")
    for mode in ("overwrite", "append"):
        tables.write_table(ledger, str(tmp_path), "ledger", mode)
    stored = tables.StoredTables(spark, str(tmp_path), datetime.date(2025, 6, 1))
    assert stored.timeline.days == [(row["Day"], row["Entries"]) for row in days_of(stored.ledger).orderBy("Day").collect()]


def test_bucketed_tables_join_without_shuffle(spark, seed, settings, tmp_path):
    settings(spark__sql__autoBroadcastJoinThreshold="-1")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS bucketed LOCATION '{tmp_path}'")
    ledger, vouchers = tables.save_by_entry(seed.ledger, seed.vouchers, "bucketed.by_entry", 4)
    text = plan(ghosts(ledger, vouchers), "simple")
    assert "LeftAnti" in text and "Exchange" not in text
    assert rec.ghost_count(ledger, vouchers).first()[0] == 393
    spark.sql("DROP DATABASE bucketed CASCADE")


@pytest.fixture
def small_partitions(settings):
    """Make a few thousand rows look skewed, and keep Spark from broadcasting them."""
    settings(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="20KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="20KB",
        spark__sql__shuffle__partitions="12",
    )


@pytest.fixture
def wide(spark):
    """A ledger in which wallet 1 holds a third of the rows."""
    n = F.col("id")
    return spark.range(0, 60_000, 1, 12).select(
        n.alias("EntryID"),
        F.when(n % 3 == 0, 1).otherwise(n % 500).alias("WalletID"),
        (n % 50).alias("ProductID"),
        (n % 100).cast("decimal(18,2)").alias("Amount"),
        (n % 7).cast("decimal(18,4)").alias("CommissionAmount"),
        F.lit(datetime.datetime(2025, 1, 1)).cast("timestamp_ntz").alias("CreatedTimestamp"),
    )


def test_hot_wallet_join_is_split(spark, small_partitions, wide):
    """Adaptive execution spreads the hot wallet over several tasks."""
    n = F.col("id")
    wallets = spark.range(500).select(n.alias("WalletID"), n.alias("UserID"))
    merchants = spark.range(0, 500, 2).select(
        n.alias("MerchantID"), n.alias("UserID"), n.cast("string").alias("BusinessName"),
        F.lit("Premium").alias("MerchantTier"),
    )
    rules = spark.range(50).select(
        n.alias("CommissionID"), n.alias("ProductID"),
        F.explode(F.array(F.lit("Premium"), F.lit("Standard"))).alias("MerchantTier"),
        F.lit(3).cast("decimal(5,2)").alias("CommissionPercentage"), F.lit(True).alias("IsActive"),
    )
    report = com.accuracy_by_month(wide, wallets, merchants, rules)
    assert report.collect()[0]["TotalTransactions"] == 60_000
    assert "SortMergeJoin(skew=true)" in plan(report, "simple")


def test_hot_wallet_lookup_is_split(spark, small_partitions, wide):
    keys = spark.range(0, 4000).select((F.col("id") % 400).alias("WalletID"))
    found = pick(wide, "WalletID", keys)
    assert len(found.collect()) == wide.filter("WalletID < 400").count()
    assert "SortMergeJoin(skew=true)" in plan(found, "simple")


def test_hot_wallet_in_requests_is_split(spark, small_partitions, wide):
    requests = wide.select(F.col("EntryID").alias("RequestID"), "WalletID", "Amount")
    outcomes = topup_outcomes(spark.range(400).select(F.col("id").alias("WalletID")), requests)
    reasons = outcomes.collect()
    assert sum(r["Reason"] == "wallet not found" for r in reasons) > 0 and len(reasons) == 60_000
    assert "SortMergeJoin(skew=true)" in plan(outcomes, "simple")


@pytest.fixture(scope="module")
def tiny(spark):
    ledger = spark.createDataFrame(
        [(i, 1 + i % 2, 1 + i % 3, datetime.datetime(2025, 1, 1 + i)) for i in range(6)],
        "EntryID INT, WalletID INT, ProductID INT, CreatedTimestamp TIMESTAMP_NTZ",
    ).withColumns({"Amount": F.lit(1), "CommissionAmount": F.lit(1)})
    wallets = spark.createDataFrame([(1, 1), (2, 2)], "WalletID INT, UserID INT")
    merchants = spark.createDataFrame(
        [(5, 1, "x", "Premium"), (6, 1, "y", "Standard")],
        "MerchantID INT, UserID INT, BusinessName STRING, MerchantTier STRING",
    )
    return ledger, wallets, merchants


def newest(df):
    return [(r["EntryID"], r["MerchantID"]) for r in df.collect()]


def test_owners_repeat_for_several_profiles(tiny):
    ledger, wallets, merchants = tiny
    assert owners(wallets, merchants).count() == 3
    assert newest(recent(ledger, wallets, merchants, 4)) == [(5, None), (4, 5), (4, 6), (3, None)]


def test_recent_looks_further_back_for_rows_that_count(spark, tiny):
    ledger, wallets, merchants = tiny
    only_first = wallets.filter("WalletID = 1")
    assert newest(recent(ledger, only_first, merchants, 1)) == [(4, 5)]
    products = spark.createDataFrame([(1,)], "ProductID INT")
    assert newest(recent(ledger, wallets, merchants, 1, products=products)) == [(3, None)]
    assert newest(recent(ledger, wallets.filter("WalletID > 5"), merchants, 1)) == []
    orphans = spark.range(6, 400).select(
        F.col("id").cast("int").alias("EntryID"), F.lit(99).alias("WalletID"), F.lit(1).alias("ProductID"),
        F.lit(datetime.datetime(2026, 1, 1)).cast("timestamp_ntz").alias("CreatedTimestamp"),
        F.lit(1).alias("Amount"), F.lit(1).alias("CommissionAmount"),
    )
    assert newest(recent(ledger.unionByName(orphans), wallets, merchants, 1)) == [(5, None)]
