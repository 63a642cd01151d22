"""Rule sets for request tables: every request with the rules it breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reckon.plans.requests import given, given_id

# Limits and forms the platform states.
MIN_QUANTITY, MAX_QUANTITY = 1, 20
MIN_TOPUP = 10
MIN_SALE, MAX_SALE = 5, 1000
MIN_PASSWORD = 8
PHONE_PATTERN = r"^0[1-9][0-9]{8}\z"
PIN_PATTERN = r"^[0-9]{16}\z"
EMAIL_PATTERN = r"^[^@ ]+@[^@ ]+[.][^@ ]+\z"
MSISDN_PATTERN = r"^[0-9]{11}\z"


def voucher_rules() -> dict[str, Column]:
    return {
        "walletId required": given_id("WalletID"),
        "productId required": given_id("ProductID"),
        "reference required": given("Reference"),
        "quantity between 1 and 20": F.col("Quantity").between(MIN_QUANTITY, MAX_QUANTITY),
    }


def topup_rules() -> dict[str, Column]:
    return {
        "walletId required": given_id("WalletID"),
        "amount must be positive": F.col("Amount") > 0,
        "minimum top-up is 10": F.col("Amount") >= MIN_TOPUP,
    }


def sale_rules() -> dict[str, Column]:
    return {
        "valid phone number required": F.regexp_replace("Phone", " ", "").rlike(PHONE_PATTERN),
        "amount between 5 and 1000": F.col("Amount").between(MIN_SALE, MAX_SALE),
        "16-digit voucher pin required": F.col("VoucherPin").rlike(PIN_PATTERN),
    }


def registration_rules() -> dict[str, Column]:
    return {
        "msisdn of 11 digits required": F.col("MSISDN").rlike(MSISDN_PATTERN),
        "fullName required": given("FullName"),
        "valid email required": F.col("Email").rlike(EMAIL_PATTERN),
        "password of 8 characters required": F.col("PasswordLength") >= MIN_PASSWORD,
    }


def validate_requests(requests: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add Accepted and Reasons, the array of broken rules. A rule that cannot be decided is broken."""
    broken = [F.when(~F.coalesce(holds, F.lit(False)), name) for name, holds in rules.items()]
    return requests.withColumn("Reasons", F.array_compact(F.array(*broken))).withColumn(
        "Accepted", F.size("Reasons") == 0
    )


def accepted(validated: DataFrame) -> DataFrame:
    return validated.filter(F.col("Accepted")).drop("Accepted", "Reasons")


def rejected(validated: DataFrame) -> DataFrame:
    return validated.filter(~F.col("Accepted")).drop("Accepted")


def request_report(vouchers: DataFrame, topups: DataFrame, sales: DataFrame, registrations: DataFrame) -> DataFrame:
    """One row per request of any kind; reasons joined to text."""
    checked = {
        "voucher": (vouchers, voucher_rules()),
        "top-up": (topups, topup_rules()),
        "sale": (sales, sale_rules()),
        "registration": (registrations, registration_rules()),
    }
    report = None
    for kind, (requests, rules) in checked.items():
        rows = validate_requests(requests, rules).select(
            F.lit(kind).alias("Kind"), "RequestID", "Accepted", F.array_join("Reasons", "; ").alias("Reasons")
        )
        report = rows if report is None else report.unionByName(rows)
    return report
