"""Ghosts that are kept up to date equal a full anti join."""

import datetime
import random

import pytest
from compare import rows_of_spark
from pyspark.sql import functions as F

import __spark_entry__ as entry
from reckon.catalogue import QUERIES
from reckon.operators.shared import ghosts
from reckon.plans import ghosts as kept
from reckon.sources import tables
from reckon.sources.versions import Changes, VersionedTables, Versions

AS_OF = datetime.date(2025, 6, 2)


def plan(df, mode="formatted"):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def rows(spark, entries, vouchers):
    at = datetime.datetime(2025, 1, 1)
    ledger = spark.createDataFrame([(e, at + datetime.timedelta(days=e)) for e in entries], "EntryID LONG, CreatedTimestamp TIMESTAMP_NTZ")
    for name in ("WalletID", "ProductID", "Amount", "CommissionAmount", "ExternalReference", "ProcessingStatus"):
        ledger = ledger.withColumn(name, F.lit("Completed") if name == "ProcessingStatus" else F.lit(None).cast("string"))
    issued = spark.createDataFrame(vouchers, "VoucherID LONG, EntryID LONG").withColumns({"PinData": F.lit("1"), "ExpiryDate": F.lit(at)})
    return {"ledger": tables.conform(ledger, "ledger"), "vouchers": tables.conform(issued, "vouchers")}


@pytest.mark.parametrize("seed", [1, 2])
def test_increments_give_the_full_result(spark, tmp_path, seed):
    """Entries before, with and after their vouchers, entries without, vouchers without, several vouchers an entry, empty increments."""
    rng = random.Random(seed)
    entries = [(rng.randrange(4), e) for e in range(60)]
    vouchers = [(rng.randrange(4), v, rng.randrange(90)) for v in range(70)] + [(2, 100, None)]
    store = Versions(spark, str(tmp_path))
    for step in range(5):
        part = rows(spark, [e for s, e in entries if s == step], [(v, e) for s, v, e in vouchers if s == step])
        store.commit(f"step-{step}", Changes(append=part), store.manifest())
        kept.keep_ghosts(store, AS_OF)
        t = VersionedTables(spark, str(tmp_path), AS_OF)
        assert sorted(t.ghosts.collect()) == sorted(ghosts(t.ledger, t.vouchers).collect())
        number = t.version.number
        assert kept.keep_ghosts(store, AS_OF).number == number  # nothing new
    # compaction moves the rows to another folder: all is joined once more, with the same result
    store.compact("ledger", AS_OF)
    before = sorted(t.ghosts.collect())
    kept.keep_ghosts(store, AS_OF)
    assert sorted(VersionedTables(spark, str(tmp_path), AS_OF).ghosts.collect()) == before


def test_only_increments_are_read(spark, tmp_path):
    store = Versions(spark, str(tmp_path))
    store.commit("one", Changes(append=rows(spark, range(50), [(v, v) for v in range(0, 50, 2)])), store.manifest())
    first = kept.keep_ghosts(store, AS_OF)
    store.commit("two", Changes(append=rows(spark, range(50, 60), [(100, 1), (101, 51)])), store.manifest())
    t = VersionedTables(spark, str(tmp_path), AS_OF)
    changes = kept.changes_since(t)
    text = plan(changes.replace["ghosts"]) + plan(changes.replace["loose_vouchers"])
    old = [f.split("/")[1] for f in (first.folders["ledger"][0], first.folders["vouchers"][0])]
    new = [f.split("/")[1] for f in (t.version.folders["ledger"][1], t.version.folders["ghosts"][0])]
    assert not any(name in text for name in old) and all(name in text for name in new)
    assert changes.replace["ghosts"].count() == 25 - 1 + 10 - 1


def test_parts_are_joined_at_once(spark, settings):
    """One join for what was there and what came, so that a small part does not take all vouchers into few tasks; no row is lost or doubled."""
    settings(spark__sql__autoBroadcastJoinThreshold="-1")
    old, new = rows(spark, [1, 2, 2], [(9, 80), (8, None)]), rows(spark, [3, 4, 80], [(1, 1), (5, 3), (6, 3), (7, 90), (7, 90)])
    found, loose = kept.updated(old["ledger"], old["vouchers"], new["ledger"], new["vouchers"])
    assert plan(found, "simple").count("Join ") == plan(loose, "simple").count("Join ") == 1
    assert sorted(r["EntryID"] for r in found.collect()) == [2, 2, 4]
    assert sorted((r["VoucherID"], r["EntryID"] or 0) for r in loose.collect()) == [(7, 90), (7, 90), (8, 0)]
    assert found.columns == old["ledger"].columns and loose.columns == old["vouchers"].columns


@pytest.mark.parametrize("name", [name for name in QUERIES if name.startswith("ghost_")])
def test_reports_over_kept_ghosts(spark, data, tmp_path_factory, name):
    folder = tmp_path_factory.getbasetemp() / "kept-ghosts"
    store = Versions(spark, str(folder))
    if not store.numbers():
        tables_of = {k: getattr(data, k) for k in ("ledger", "vouchers", "wallets", "users", "products", "providers")}
        store.commit("import", Changes(replace=tables_of), store.manifest())
        kept.keep_ghosts(store, data.as_of)
    t = kept.OfGhosts(VersionedTables(spark, str(folder), data.as_of))
    dates = lambda df: df.withColumns({f.name: F.to_date(f.name) for f in df.schema.fields if "timestamp" in f.dataType.simpleString()})
    found, expected = (rows_of_spark(dates(entry._published(QUERIES[name](x)))) for x in (t, data))
    assert found == expected
