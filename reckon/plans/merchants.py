"""Merchant status changes and registrations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reckon import schemas as s
from reckon.plans.requests import ARRIVAL, audit, first_of_each, first_reason, given, known, numbered

# Audit action per new status.
ACTIONS = {s.ACTIVE: "ACTIVATE", s.SUSPENDED: "SUSPEND", s.DEACTIVATED: "DEACTIVATE"}
REGISTRATION_PATTERN = r"^REG-[0-9]{4}-[0-9]{4}\z"


def _valid(requests: DataFrame) -> DataFrame:
    return requests.filter(F.col("NewStatus").isin(*ACTIONS))


def change_merchant_status(merchants: DataFrame, requests: DataFrame) -> DataFrame:
    """The merchant table after all requests; the latest request of a merchant decides."""
    latest = (
        _valid(requests)
        .groupBy("MerchantID")
        .agg(
            F.max_by("NewStatus", F.struct(*ARRIVAL)).alias("_status"),
            F.max("RequestedAt").alias("_at"),
        )
    )
    return merchants.join(latest, "MerchantID", "left").select(
        "MerchantID",
        "UserID",
        "BusinessName",
        "RegistrationNumber",
        F.coalesce("_status", "MerchantStatus").alias("MerchantStatus"),
        "MerchantTier",
        "CreatedAt",
        F.coalesce("_at", F.col("UpdatedAt").cast("timestamp_ntz")).alias("UpdatedAt"),
    )


def status_audit(merchants: DataFrame, requests: DataFrame, by: int) -> DataFrame:
    """One audit row per request for a known merchant."""
    action = F.coalesce(*[F.when(F.col("NewStatus") == status, name) for status, name in ACTIONS.items()])
    applied = _valid(requests).join(merchants.select("MerchantID"), "MerchantID", "left_semi")
    return audit(
        applied, action, "Merchants", F.col("MerchantID"), F.lit(None), F.col("NewStatus"), by, "RequestID"
    )


def status_rejections(merchants: DataFrame, requests: DataFrame) -> DataFrame:
    reason = first_reason(
        (F.col("NewStatus").isin(*ACTIONS), "unknown status"), (F.col("_known"), "merchant not found")
    )
    return (
        known(requests, "MerchantID", merchants, "_known")
        .select("RequestID", "MerchantID", "NewStatus", reason.alias("Reason"))
        .filter(F.col("Reason").isNotNull())
    )


def merchant_registration_outcomes(merchants: DataFrame, users: DataFrame, requests: DataFrame) -> DataFrame:
    """Every request with Accepted and Reason.

    The first valid request of a user wins unless the user has a profile. Whether there is one is asked
    once per user, not once per request.
    """
    checked = requests.join(users.select("UserID", "Role"), "UserID", "left").withColumn(
        "_reason",
        first_reason(
            (given("BusinessName") & given("RegistrationNumber"), "name and number required"),
            (F.col("RegistrationNumber").rlike(REGISTRATION_PATTERN), "malformed registration number"),
            (F.col("Role").isin("Merchant", "Admin"), "role not allowed"),
        ),
    )
    winners = first_of_each(checked.filter(F.col("_reason").isNull()), "UserID").join(
        merchants.select("UserID").distinct(), "UserID", "left_anti"
    )
    won = winners.select("RequestID", F.lit(True).alias("_won"))
    accepted = F.col("_won").isNotNull()
    return checked.join(won, "RequestID", "left").select(
        *requests.columns,
        "Role",
        accepted.alias("Accepted"),
        F.when(~accepted, F.coalesce("_reason", F.lit("profile exists"))).alias("Reason"),
    )


def register_merchants(merchants: DataFrame, users: DataFrame, requests: DataFrame) -> DataFrame:
    """The new merchant rows: pending, Enterprise tier for admins and Standard for the rest."""
    accepted = merchant_registration_outcomes(merchants, users, requests).filter(F.col("Accepted"))
    return numbered(accepted, merchants, "MerchantID").select(
        "MerchantID",
        "UserID",
        "BusinessName",
        "RegistrationNumber",
        F.lit(s.PENDING).alias("MerchantStatus"),
        F.when(F.col("Role") == "Admin", s.ENTERPRISE).otherwise(s.STANDARD).alias("MerchantTier"),
        F.col("RequestedAt").alias("CreatedAt"),
        F.col("RequestedAt").alias("UpdatedAt"),
    )
