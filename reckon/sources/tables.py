"""The canonical tables as Parquet.

The ledger is partitioned by month so that period jobs read only their months, and comes with the number of rows of each day, so that its
newest and oldest rows are found without reading the rest. Look-ups by id skip the files that cannot hold it, by bloom filters and, where
the ledger is also partitioned by wallet, by that. For repeated reconciliation, ledger and vouchers can also be saved bucketed by entry, which lets every join
between them run without a shuffle.
"""

from __future__ import annotations

import datetime
import re
from functools import cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reckon.operators.readmodels import pick
from reckon.operators.shared import Timeline, between, days_of, listed
from reckon.schemas import SCHEMAS

# Attribute of a table set -> folder name.
NAMES = {
    "providers": "ServiceProviders",
    "users": "Users",
    "merchants": "Merchants",
    "wallets": "Wallets",
    "products": "Products",
    "commissions": "Commissions",
    "ledger": "TransactionLedger",
    "vouchers": "DigitalVouchers",
    "settlements": "Settlements",
    "audit": "AuditLog",
}
REQUESTS = {
    "topup_requests": "TopupRequests",
    "voucher_requests": "VoucherRequests",
    "status_requests": "StatusRequests",
    "registration_requests": "RegistrationRequests",
    "merchant_requests": "MerchantRequests",
    "product_requests": "ProductRequests",
    "rule_requests": "RuleRequests",
    "sale_requests": "SaleRequests",
    "settlement_requests": "SettlementRequests",
    "timed_settlement_requests": "TimedSettlementRequests",
}
# Tables that follow from others: the table whose columns they have, and their folder.
DERIVED = {"ghosts": ("ledger", "Ghosts"), "loose_vouchers": ("vouchers", "LooseVouchers")}
MONTH = "LedgerMonth"
BUCKET = re.compile(r"WalletOf(\d+)")  # partitions the ledger further, by a hash of WalletID into so many parts
MOST_KEYS = 1000  # so many ids are looked up by a filter that reaches the files, more by a join
# Columns that rows are looked up by: Parquet keeps a bloom filter of each, so files without an id are skipped.
LOOKED_UP = {
    "ledger": ["EntryID"], "vouchers": ["VoucherID", "EntryID"], "wallets": ["WalletID", "UserID"], "users": ["UserID"],
    "merchants": ["MerchantID", "UserID"],
}
DAYS = "LedgerDays"  # Day, Entries: the rows of each day, one or more counts a day


def folder_name(attribute: str) -> str:
    return DERIVED[attribute][1] if attribute in DERIVED else (NAMES | REQUESTS)[attribute]


def conform(df: DataFrame, attribute: str, entry_type: T.DataType | None = None) -> DataFrame:
    """Columns of the canonical schema, cast to its types. Entry ids may be kept as text."""
    columns = []
    for field in SCHEMAS[NAMES[attribute]].fields:
        kind = entry_type if field.name == "EntryID" and entry_type is not None else field.dataType
        columns.append(F.col(field.name).cast(kind))
    return df.select(*columns)


def write_table(df: DataFrame, folder: str, attribute: str, mode: str = "overwrite", wallet_buckets: int = 0) -> None:
    """Write one table; ``append`` adds new ledger or audit rows. With the ledger the rows of each day are counted.

    With wallet_buckets the months of the ledger are dealt further by wallet and sorted by it, for look-ups by wallet.
    """
    target = f"{folder}/{folder_name(attribute)}"
    blooms = {f"parquet.bloom.filter.enabled#{name}": "true" for name in LOOKED_UP.get(attribute, [])}
    blooms["parquet.bloom.filter.adaptive.enabled"] = "true"
    if attribute == "ledger":
        parts = {MONTH: F.trunc(F.to_date("CreatedTimestamp"), "month")}
        if wallet_buckets:
            parts[f"WalletOf{wallet_buckets}"] = _bucket(wallet_buckets)
        # Rebalancing gathers a month's rows into few files and still splits a month too large for one task.
        rows = df.withColumns(parts).hint("rebalance", *[F.col(name) for name in parts])
        if wallet_buckets:
            rows = rows.sortWithinPartitions(*parts, "WalletID")
        rows.write.mode(mode).options(**blooms).partitionBy(*parts).parquet(target)
        if mode != "append":  # the folder holds these rows alone, so they need not be computed once more
            df = df.sparkSession.read.schema(df.schema).parquet(target)
        days_of(df).coalesce(1).write.mode(mode).parquet(f"{folder}/{DAYS}")
    else:
        df.write.mode(mode).options(**blooms).parquet(target)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col("WalletID").cast("bigint")), F.lit(buckets)).cast("int")


def read_table(spark: SparkSession, folder: str, attribute: str) -> DataFrame:
    if attribute in REQUESTS:
        return spark.read.parquet(f"{folder}/{REQUESTS[attribute]}")
    if attribute == "ledger":
        return ledger_between(spark, folder)
    if attribute in DERIVED:
        return spark.read.schema(SCHEMAS[NAMES[DERIVED[attribute][0]]]).parquet(f"{folder}/{folder_name(attribute)}")
    return spark.read.schema(SCHEMAS[NAMES[attribute]]).parquet(f"{folder}/{NAMES[attribute]}")


class StoredTables:
    """Canonical and request tables of a folder as lazy attributes, as the query catalogue expects them."""

    def __init__(self, spark: SparkSession, folder: str, as_of: datetime.date, options: dict | None = None):
        self.spark, self.as_of, self.options, self._folder = spark, as_of, options or {}, folder
        self.ledger_between = lambda first=None, last=None: ledger_between(spark, folder, first, last)
        self.timeline = self.timeline_amounts = Timeline(self.ledger_between, listed(lambda: ledger_days(spark, folder)))
        self._read = cache(lambda attribute: read_table(spark, folder, attribute))

    def rows_of(self, attribute: str, key: str, keys: DataFrame) -> DataFrame:
        """The rows of a table whose ``key`` occurs in ``keys``. Few keys are sought in the files that can hold them."""
        return seek(getattr(self, attribute), key, keys, self._ledger_parts() if attribute == "ledger" else None)

    def _ledger_parts(self) -> DataFrame:
        return ledger_in(self.spark, [f"{self._folder}/{NAMES['ledger']}"], SCHEMAS["TransactionLedger"], with_parts=True)

    def __getattr__(self, attribute: str) -> DataFrame:
        attribute = "ledger" if attribute == "ledger_amounts" else attribute
        if attribute not in NAMES and attribute not in REQUESTS and attribute not in DERIVED:
            raise AttributeError(attribute)
        return self._read(attribute)


def register_views(tables) -> None:
    """Temporary views under the canonical names, for ad-hoc SQL over any table set."""
    for attribute, name in NAMES.items():
        getattr(tables, attribute).createOrReplaceTempView(name)


def ledger_between(
    spark: SparkSession, folder: str, first: datetime.date | None = None, last: datetime.date | None = None
) -> DataFrame:
    """The ledger from ``first`` to ``last``, both inclusive; other months are not read."""
    return ledger_in(spark, [f"{folder}/{NAMES['ledger']}"], SCHEMAS["TransactionLedger"], first, last)


def ledger_in(
    spark: SparkSession,
    folders: list[str],
    schema: T.StructType,
    first: datetime.date | None = None,
    last: datetime.date | None = None,
    with_parts: bool = False,
) -> DataFrame:
    """The ledger in one or more folders, each partitioned by month and perhaps by wallet; with_parts shows these columns."""
    with_month = T.StructType([*schema.fields, T.StructField(MONTH, T.DateType())])
    found = [spark.read.schema(with_month).parquet(folder) for folder in folders]
    shared = [name for name in found[0].columns if all(name in part.columns for part in found)]
    ledger = reduce(DataFrame.unionByName, [part.select(*shared) for part in found])
    if first is not None:
        ledger = ledger.filter(F.col(MONTH) >= F.lit(first.replace(day=1)))
    if last is not None:
        ledger = ledger.filter(F.col(MONTH) <= F.lit(last))
    rows = between(ledger, first, last)
    return rows if with_parts else rows.select(*schema.fieldNames())


def seek(table: DataFrame, key: str, keys: DataFrame, parts: DataFrame | None = None, most: int = MOST_KEYS) -> DataFrame:
    """The rows of a table whose ``key`` occurs in ``keys``.

    Up to ``most`` different keys become a filter, which Spark holds against partitions, row group statistics and bloom filters; more
    are joined. ``parts`` is the ledger with its partition columns.
    """
    wanted = keys.select(F.col(key).cast(table.schema[key].dataType)).filter(F.col(key).isNotNull()).distinct()
    bucketed = {name: int(found[1]) for name in (parts.columns if parts is not None else []) if (found := BUCKET.fullmatch(name))}
    if key != "WalletID":
        bucketed = {}
    few = wanted.select(key, *[_bucket(n).alias(name) for name, n in bucketed.items()]).limit(most + 1).collect()
    if len(few) > most:
        return pick(table, key, keys)
    rows = parts if bucketed else table
    for name in [key, *bucketed]:
        rows = rows.filter(F.col(name).isin(sorted({row[name] for row in few})))
    return rows.select(*table.columns)


def ledger_days(spark: SparkSession, folder: str) -> DataFrame:
    """Day, Entries, as kept with the ledger."""
    return days_in(spark, [f"{folder}/{DAYS}"])


def days_in(spark: SparkSession, folders: list[str]) -> DataFrame:
    return spark.read.schema("Day DATE, Entries BIGINT").parquet(*folders)


def save_by_entry(ledger: DataFrame, vouchers: DataFrame, prefix: str, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Save both as catalog tables bucketed and sorted by EntryID and read them back."""
    saved = []
    for df, name in ((ledger, f"{prefix}_ledger"), (vouchers, f"{prefix}_vouchers")):
        writer = df.repartition(buckets, "EntryID").write.mode("overwrite").bucketBy(buckets, "EntryID")
        writer.sortBy("EntryID").saveAsTable(name)
        saved.append(df.sparkSession.table(name))
    return saved[0], saved[1]


def export_json(df: DataFrame, folder: str) -> None:
    """Results as JSON lines with ISO timestamps, the form the platform's API answers in."""
    df.write.mode("overwrite").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSS").option(
        "ignoreNullFields", "false"
    ).json(folder)
