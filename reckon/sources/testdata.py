"""The canonical tables derived from the star-schema Parquet files (rules: FIXTURES.md, section 2).

Everything is lazy; a query reads only the files and columns its tables need.
"""

from __future__ import annotations

import datetime
from decimal import Decimal
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reckon import schemas as s
from reckon.operators.shared import Timeline, between, days_of, listed

AS_OF = datetime.date(1999, 1, 1)
FIRST_PERIOD = datetime.date(1995, 1, 1)

# Fixed values: (rule number, tier, base percentage); rule 4 is the planted duplicate.
RULES = [
    (1, s.STANDARD, Decimal("3.00")),
    (2, s.PREMIUM, Decimal("5.50")),
    (3, s.ENTERPRISE, Decimal("8.00")),
]
DUPLICATE_RULE = (4, s.STANDARD, Decimal("6.75"))
DUPLICATE_RULE_OFFSET = 1_000_000_000

MERCHANT_SEGMENTS = {"BUILDING": s.STANDARD, "MACHINERY": s.PREMIUM, "AUTOMOBILE": s.ENTERPRISE}

_FILES = {
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT",
    "part": "p_partkey BIGINT, p_name STRING, p_size INT, p_retailprice DOUBLE",
    "customer": "c_custkey BIGINT, c_name STRING, c_acctbal DOUBLE, c_mktsegment STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE,"
    " o_orderdate TIMESTAMP_NTZ",
    "lineitem": "l_orderkey BIGINT, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE",
}


def _text(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")


def _padded(prefix: str, column: str | Column, width: int) -> Column:
    return F.concat(F.lit(prefix), F.lpad(_text(column), width, "0"))


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _choose(column: Column, choices: dict, otherwise) -> Column:
    chosen = None
    for value, result in choices.items():
        test = column == value
        chosen = F.when(test, result) if chosen is None else chosen.when(test, result)
    return chosen.otherwise(otherwise)


class TestData:
    __test__ = False  # not a pytest class

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    as_of = AS_OF
    # The ledger has whole days only, so rows are rapid within a year here.
    options = {"rapid_seconds": 365 * 86400, "tier_changes": {s.STANDARD: Decimal("1.5")}, "status": s.FAILED}

    def file(self, name: str) -> DataFrame:
        return self.spark.read.schema(_FILES[name]).parquet(f"{self.folder}/{name}.parquet")

    def _rows_of(self, name: str) -> Column:
        return self.file(name).agg(F.count("*")).scalar()

    # -- dimensions -------------------------------------------------------------------------------

    @cached_property
    def providers(self) -> DataFrame:
        return self.file("supplier").select(
            F.col("s_suppkey").alias("ProviderID"),
            F.col("s_name").alias("ProviderName"),
            F.when(F.col("s_nationkey") % 5 == 0, "Utility").otherwise("Mobile").alias("Category"),
            F.lit(True).alias("IsActive"),
        )

    @cached_property
    def products(self) -> DataFrame:
        key = F.col("p_partkey")
        return self.file("part").select(
            key.alias("ProductID"),
            (key % self._rows_of("supplier")).alias("ProviderID"),
            F.concat(F.lit("SKU-"), _text(key)).alias("SKU"),
            F.col("p_name").alias("Description"),
            F.col("p_retailprice").cast(s.AMOUNT).alias("FaceValue"),
            (key % 10 != 9).alias("IsActive"),
        )

    @cached_property
    def commissions(self) -> DataFrame:
        """Every product has one rule per tier; every hundredth a second Standard rule."""
        key, step = F.col("p_partkey"), (F.col("p_size") % 6).cast("decimal(2,0)") * F.lit(Decimal("0.5"))

        def rule(identifier: Column, tier: str, rate: Column) -> Column:
            return F.struct(
                identifier.alias("CommissionID"),
                F.lit(tier).alias("MerchantTier"),
                rate.cast(s.PERCENT).alias("CommissionPercentage"),
            )

        regular = [rule(key * 3 + k, tier, F.lit(base) + step) for k, tier, base in RULES]
        _, tier, base = DUPLICATE_RULE
        extra = F.when(key % 100 == 2, rule(key + DUPLICATE_RULE_OFFSET, tier, F.lit(base)))
        return (
            self.file("part")
            .select(key.alias("ProductID"), F.explode(F.array_compact(F.array(*regular, extra))).alias("r"))
            .select(
                "r.CommissionID",
                "ProductID",
                "r.MerchantTier",
                "r.CommissionPercentage",
                F.lit(datetime.date(1995, 1, 1)).alias("EffectiveDate"),
                F.lit(True).alias("IsActive"),
            )
        )

    @cached_property
    def users(self) -> DataFrame:
        key, slot = F.col("c_custkey"), F.col("c_custkey") % 50
        segment = F.col("c_mktsegment")
        return self.file("customer").select(
            key.alias("UserID"),
            F.col("c_name").alias("FullName"),
            F.when(slot == 40, _padded("271", key, 6))
            .when(slot == 45, _padded("2711", key, 9))
            .when(slot == 49, _padded("27AB", key, 7))
            .otherwise(_padded("2771", key, 7))
            .alias("MSISDN"),
            F.concat(F.lit("user"), _text(key), F.lit("@example.org")).alias("Email"),
            F.when(key % 100 == 1, "Admin")
            .when(segment.isin(*MERCHANT_SEGMENTS), "Merchant")
            .otherwise("User")
            .alias("Role"),
            _choose(segment, {"MACHINERY": s.PREMIUM, "AUTOMOBILE": s.ENTERPRISE}, s.STANDARD).alias("AccountTier"),
            F.when(slot.isin(5, 18, 33), s.DISABLED).when(slot == 12, s.SUSPENDED).otherwise(s.ACTIVE)
            .alias("ServiceStatus"),
            F.lit(datetime.date(1995, 1, 1)).alias("CreatedAt"),
        )

    @cached_property
    def wallets(self) -> DataFrame:
        return self.file("customer").filter(F.col("c_custkey") % 100 != 7).select(
            F.col("c_custkey").alias("WalletID"),
            F.col("c_custkey").alias("UserID"),
            F.col("c_acctbal").cast(s.AMOUNT).alias("Balance"),
            F.lit("ZAR").alias("CurrencyCode"),
            F.lit(datetime.date(1998, 12, 31)).alias("LastUpdated"),
        )

    @cached_property
    def merchants(self) -> DataFrame:
        key, segment = F.col("c_custkey"), F.col("c_mktsegment")
        return self.file("customer").filter(segment.isin(*MERCHANT_SEGMENTS)).select(
            key.alias("MerchantID"),
            key.alias("UserID"),
            F.concat(F.lit("Business_"), _text(key)).alias("BusinessName"),
            _padded("REG-2024-", key % 10000, 4).alias("RegistrationNumber"),
            _choose(key % 22, {13: s.SUSPENDED, 14: s.DEACTIVATED, 9: s.PENDING}, s.ACTIVE).alias("MerchantStatus"),
            _choose(segment, {"BUILDING": s.STANDARD, "MACHINERY": s.PREMIUM}, s.ENTERPRISE).alias("MerchantTier"),
            F.lit(datetime.date(1995, 1, 1)).alias("CreatedAt"),
            F.lit(datetime.date(1995, 1, 1)).alias("UpdatedAt"),
        )

    # -- facts ------------------------------------------------------------------------------------

    @cached_property
    def ledger_amounts(self) -> DataFrame:
        """The ledger without CommissionAmount, which alone needs the product file."""
        key = F.col("o_orderkey")
        reference = (
            F.when((key > 0) & (key % 169 == 0), key - 13).when((key > 0) & (key % 500 == 0), key - 1).otherwise(key)
        )
        return self.file("orders").select(
            key.alias("EntryID"),
            F.col("o_custkey").alias("WalletID"),
            (key % self._rows_of("part")).alias("ProductID"),
            F.col("o_totalprice").cast(s.AMOUNT).alias("Amount"),
            F.concat(F.lit("TXN-"), _text(reference)).alias("ExternalReference"),
            _choose(F.col("o_orderstatus"), {"F": s.COMPLETED, "P": s.PENDING}, s.FAILED).alias("ProcessingStatus"),
            F.col("o_orderdate").alias("CreatedTimestamp"),
        )

    def ledger_between(self, first: datetime.date | None = None, last: datetime.date | None = None) -> DataFrame:
        """The ledger from ``first`` to ``last``, both inclusive."""
        return between(self.ledger, first, last)

    @cached_property
    def _days(self):
        """The files keep no counts of days, so they are taken once for a table set."""
        return listed(lambda: days_of(self.ledger_amounts))

    @property
    def timeline_amounts(self) -> Timeline:
        return Timeline(lambda first, last: between(self.ledger_amounts, first, last), self._days)

    @property
    def timeline(self) -> Timeline:
        return Timeline(self.ledger_between, self._days)

    @cached_property
    def ledger(self) -> DataFrame:
        first_rate = self.commissions.filter(
            (F.col("MerchantTier") == s.STANDARD) & (F.col("CommissionID") < DUPLICATE_RULE_OFFSET)
        ).select("ProductID", "CommissionPercentage")
        commission = F.col("Amount") * F.col("CommissionPercentage") * F.lit(Decimal("0.01"))
        return self.ledger_amounts.join(first_rate, "ProductID").select(
            "EntryID",
            "WalletID",
            "ProductID",
            "Amount",
            commission.cast(s.COMMISSION).alias("CommissionAmount"),
            "ExternalReference",
            "ProcessingStatus",
            "CreatedTimestamp",
        )

    @cached_property
    def vouchers(self) -> DataFrame:
        """One voucher per order with lines. Grouping by EntryID, which is one-to-one with the order key,
        leaves the rows partitioned the way the joins with the ledger need them."""
        order = F.col("l_orderkey")
        entry = F.col("EntryID")
        voucher = F.when(entry < 0, -entry - 1).otherwise(entry)
        return (
            self.file("lineitem")
            .filter(order % 13 != 0)
            .select(F.when(order % 499 == 0, -order - 1).otherwise(order).alias("EntryID"), "l_shipdate")
            .groupBy("EntryID")
            .agg(F.min("l_shipdate").alias("_shipped"))
            .select(
                voucher.alias("VoucherID"),
                "EntryID",
                _text(voucher * 7919 % 1000000007).alias("PinData"),
                (F.col("_shipped") + F.expr("INTERVAL '1' YEAR")).alias("ExpiryDate"),
            )
        )

    @cached_property
    def settlements(self) -> DataFrame:
        month = F.col("PeriodStart")
        owners = self.wallets.join(self.merchants, "UserID").select("WalletID", "MerchantID")
        monthly = (
            self.ledger.filter(F.col("ProcessingStatus") == s.COMPLETED)
            .groupBy("WalletID", F.trunc(F.to_date("CreatedTimestamp"), "month").alias("PeriodStart"))
            .agg(F.sum("Amount").alias("_gross"), F.sum("CommissionAmount").alias("_commission"))
        )
        return (
            monthly.join(owners, "WalletID")
            .groupBy("MerchantID", "PeriodStart")
            .agg(F.sum("_gross").alias("GrossAmount"), F.sum("_commission").alias("CommissionAmount"))
            .select(
                (F.col("MerchantID") * 1000000 + F.year(month) * 100 + F.month(month)).alias("SettlementID"),
                "MerchantID",
                "PeriodStart",
                F.last_day(month).alias("PeriodEnd"),
                "GrossAmount",
                "CommissionAmount",
                (
                    F.col("GrossAmount")
                    - F.col("CommissionAmount")
                    - F.when(F.col("MerchantID") % 11 == 0, 125).otherwise(0)
                ).alias("NetAmount"),
                F.lit("Processed").alias("SettlementStatus"),
                F.add_months(month, 1).alias("CreatedAt"),
            )
        )

    @cached_property
    def audit(self) -> DataFrame:
        key = F.col("event_id")
        return self.file("events").select(
            key.alias("LogID"),
            F.when(key % 50 == 0, -1).otherwise(F.col("user_id")).alias("UserID"),
            F.upper("event_type").alias("Action"),
            F.lit("Events").alias("TableAffected"),
            _text(key).alias("RecordID"),
            _null("string").alias("OldValue"),
            F.col("event_type").alias("NewValue"),
            F.col("ts").alias("Timestamp"),
        )

    # -- requests for the batch jobs --------------------------------------------------------------

    def _requests(self, kind: str, *columns: Column) -> DataFrame:
        return (
            self.file("events")
            .filter(F.col("event_type") == kind)
            .select(F.col("event_id").alias("RequestID"), *columns, F.col("ts").alias("RequestedAt"))
        )

    @cached_property
    def topup_requests(self) -> DataFrame:
        amount = F.when(F.col("event_id") % 29 == 0, 0).otherwise(F.col("value"))
        return self._requests("purchase", F.col("user_id").alias("WalletID"), amount.cast(s.AMOUNT).alias("Amount"))

    @cached_property
    def voucher_requests(self) -> DataFrame:
        key = F.col("event_id")
        return self._requests(
            "click",
            F.when(key % 41 == 0, -1).otherwise(F.col("user_id")).alias("WalletID"),
            (key % self._rows_of("part")).alias("ProductID"),
            (key % 23).alias("Quantity"),
            F.when(key % 37 != 0, F.concat(F.lit("REF-"), _text(key))).alias("Reference"),
        )

    @cached_property
    def status_requests(self) -> DataFrame:
        return self._requests(
            "error",
            F.col("user_id").alias("MerchantID"),
            _choose(F.col("event_id") % 3, {0: s.ACTIVE, 1: s.SUSPENDED}, s.DEACTIVATED).alias("NewStatus"),
        )

    @cached_property
    def registration_requests(self) -> DataFrame:
        key = F.col("event_id")
        return self._requests(
            "signup",
            F.when(key % 3 == 0, _padded("2771", "user_id", 7)).otherwise(_padded("2782", key % 1500, 7))
            .alias("MSISDN"),
            F.when(key % 31 == 0, "").otherwise(F.concat(F.lit("Applicant "), _text(key))).alias("FullName"),
            F.when(key % 17 == 0, "a_morg").otherwise(F.concat(F.lit("a"), _text(key), F.lit("@example.org")))
            .alias("Email"),
            (key % 20).alias("PasswordLength"),
            _choose(key % 4, {0: "Merchant", 1: "Admin"}, "User").alias("Role"),
        )

    @cached_property
    def merchant_requests(self) -> DataFrame:
        """Profiles asked for by any user; every eleventh registration number is malformed."""
        key = F.col("event_id")
        return self._requests(
            "view",
            (key % self._rows_of("customer")).alias("UserID"),
            F.when(key % 43 != 0, F.concat(F.lit("Shop "), _text(key))).alias("BusinessName"),
            F.when(key % 11 == 0, F.concat(F.lit("REG-"), _text(key)))
            .otherwise(_padded("REG-2025-", key % 10000, 4))
            .alias("RegistrationNumber"),
        )

    @cached_property
    def product_requests(self) -> DataFrame:
        """A quarter asks for new products, the rest changes some fields of existing or unknown ones."""
        key = F.col("event_id")
        create = key % 4 == 0
        existing_sku = F.concat(F.lit("SKU-"), _text(key % self._rows_of("part")))
        return self._requests(
            "view",
            F.when(~create, key % (self._rows_of("part") + 25)).alias("ProductID"),
            F.when(create & (key % 52 != 0), key % self._rows_of("supplier")).alias("ProviderID"),
            F.when(create & (key % 28 == 0), existing_sku)
            .when(create, F.concat(F.lit("NEW-"), _text(key % 800)))
            .alias("SKU"),
            F.when(create | (key % 3 == 0), F.concat(F.lit("Item "), _text(key))).alias("Description"),
            F.when(key % 5 != 0, F.col("value").cast(s.AMOUNT)).alias("FaceValue"),
            F.when(~create & (key % 7 == 0), F.lit(False)).alias("IsActive"),
        )

    @cached_property
    def rule_requests(self) -> DataFrame:
        """New rules, partial changes and deletions of commission rules."""
        key = F.col("event_id")
        action = _choose(key % 5, {0: "create", 1: "delete"}, "update")
        known_rules = self._rows_of("part") * 3
        return self._requests(
            "view",
            action.alias("Action"),
            F.when(action != "create", key * 17 % (known_rules + 30) + 1).alias("CommissionID"),
            F.when(action == "create", key % (self._rows_of("part") + 10)).alias("ProductID"),
            F.when(action == "create", _choose(key % 3, {0: s.STANDARD, 1: s.PREMIUM}, s.ENTERPRISE))
            .alias("MerchantTier"),
            F.when((action != "delete") & (key % 8 != 0), ((key % 90).cast("decimal(5,0)") * F.lit(Decimal("0.1"))))
            .cast(s.PERCENT)
            .alias("CommissionPercentage"),
            F.when((action == "update") & (key % 6 == 0), F.lit(False)).alias("IsActive"),
        )

    @cached_property
    def sale_requests(self) -> DataFrame:
        key = F.col("event_id")
        return self._requests(
            "purchase",
            F.when(key % 19 == 0, "abc123xyz").otherwise(_padded("072", key % 10000000, 7)).alias("Phone"),
            F.col("value").cast(s.AMOUNT).alias("Amount"),
            F.when(key % 23 == 0, "1234").otherwise(_padded("", key, 16)).alias("VoucherPin"),
        )

    @cached_property
    def settlement_requests(self) -> DataFrame:
        """Periods from a day to a quarter, some for merchants that do not exist; periods of a merchant may overlap."""
        key = F.col("RequestID")
        month = F.add_months(F.lit(FIRST_PERIOD), (key % 80).cast("int"))
        start = F.when(key % 4 > 1, F.date_add(month, (key % 28).cast("int"))).otherwise(month)
        quarter = F.date_sub(F.add_months("PeriodStart", 3), 1)
        asked = F.col("event_type").isin("error", "signup")
        rows = self.file("events").filter(asked).select(F.col("event_id").alias("RequestID"), F.col("user_id").alias("MerchantID"))
        return rows.withColumn("PeriodStart", start).withColumn(
            "PeriodEnd", F.when(key % 4 == 0, quarter).otherwise(F.date_add("PeriodStart", (key % 97).cast("int")))
        )

    @cached_property
    def timed_settlement_requests(self) -> DataFrame:
        """The same periods from and to a full hour."""
        later = lambda day, hours: F.col(day).cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("RequestID") % hours)
        return self.settlement_requests.withColumns({"PeriodStart": later("PeriodStart", 24), "PeriodEnd": later("PeriodEnd", 19)})
