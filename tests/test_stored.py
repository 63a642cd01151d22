"""The catalogue gives the same results over stored canonical tables as over the star-schema files."""

import pytest
from compare import rows_of_spark
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as entry
from reckon.catalogue import QUERIES
from reckon.run import run
from reckon.sources import tables

# One or more of every family; the ones left out show dates that are stored as timestamps.
NAMES = [
    "ghost_by_provider", "ghost_negative_balance", "mismatches_by_tier", "accuracy_by_month", "duplicate_references",
    "expired_vouchers", "revenue_report", "merchant_transactions", "overdrawn_transactions",
    "issue_vouchers_checked", "calculate_settlements", "apply_topups", "register_users", "audit_rows",
]


@pytest.fixture(scope="module")
def folder(data, tmp_path_factory):
    target = str(tmp_path_factory.mktemp("stored"))
    for name in tables.NAMES:
        tables.write_table(tables.conform(getattr(data, name), name), target, name)
    for name in tables.REQUESTS:
        tables.write_table(getattr(data, name), target, name)
    return target


def without_times(df):
    """Dates of the star-schema tables are timestamps once stored."""
    kinds = (T.DateType, T.TimestampNTZType)
    return df.withColumns({f.name: F.to_date(f.name) for f in df.schema.fields if isinstance(f.dataType, kinds)})


@pytest.mark.parametrize("name", NAMES)
def test_stored_equals_derived(spark, data, folder, name):
    stored = QUERIES[name](tables.StoredTables(spark, folder, data.as_of, data.options))
    derived = QUERIES[name](data)
    if name == "audit_rows":
        stored, derived = (df.filter("ColumnName <> 'EffectiveDate'") for df in (stored, derived))
    found, expected = (rows_of_spark(without_times(entry._published(df))) for df in (stored, derived))
    assert found == expected


def test_run_writes_the_result(spark, data, folder, tmp_path):
    for form in ("parquet", "json"):
        out = str(tmp_path / form)
        run(spark, "monthly_revenue", folder, out, data.as_of, form)
        assert spark.read.format(form).load(out).count() == QUERIES["monthly_revenue"](data).count()


def test_sql_over_views(spark, data, folder):
    tables.register_views(tables.StoredTables(spark, folder, data.as_of, data.options))
    found = spark.sql("SELECT ProcessingStatus, count(*) AS n FROM TransactionLedger GROUP BY ProcessingStatus")
    expected = QUERIES["status_totals"](data).select("ProcessingStatus", "TotalTransactions")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))


def test_unknown_table(spark, data, folder):
    with pytest.raises(AttributeError):
        tables.StoredTables(spark, folder, data.as_of).nothing
