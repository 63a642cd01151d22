"""User registrations. Passwords never enter the tables; requests carry only their length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reckon import schemas as s
from reckon.plans.requests import first_of_each, first_reason, given, given_id, numbered
from reckon.plans.validation import MIN_PASSWORD


def registration_outcomes(users: DataFrame, requests: DataFrame) -> DataFrame:
    """Every request with Accepted, Reason and the role it gets.

    An MSISDN goes to the first valid request unless a user already holds it. Whether it is held is
    asked once per MSISDN, not once per request.
    """
    required = given("MSISDN") & given("FullName") & given("Email") & given_id("PasswordLength")
    checked = requests.withColumn(
        "_reason",
        first_reason(
            (required, "missing field"), (F.col("PasswordLength") >= MIN_PASSWORD, "password too short")
        ),
    )
    winners = first_of_each(checked.filter(F.col("_reason").isNull()), "MSISDN").join(
        users.select("MSISDN").distinct(), "MSISDN", "left_anti"
    )
    won = winners.select("RequestID", F.lit(True).alias("_won"))
    accepted = F.col("_won").isNotNull()
    return checked.join(won, "RequestID", "left").select(
        "RequestID",
        "MSISDN",
        "FullName",
        "Email",
        F.when(F.col("Role").isin("User", "Merchant"), F.col("Role")).otherwise("User").alias("Role"),
        "RequestedAt",
        accepted.alias("Accepted"),
        F.when(~accepted, F.coalesce("_reason", F.lit("msisdn already registered"))).alias("Reason"),
    )


def register_users(users: DataFrame, requests: DataFrame) -> DataFrame:
    """The new user rows."""
    accepted = registration_outcomes(users, requests).filter(F.col("Accepted"))
    return numbered(accepted, users, "UserID").select(
        "UserID",
        "MSISDN",
        "FullName",
        "Email",
        "Role",
        F.lit(s.STANDARD).alias("AccountTier"),
        F.lit(s.ACTIVE).alias("ServiceStatus"),
        F.col("RequestedAt").alias("CreatedAt"),
    )


def wallets_for(new_users: DataFrame, wallets: DataFrame) -> DataFrame:
    """An empty wallet for every new user."""
    return numbered(new_users, wallets, "WalletID", ["UserID"]).select(
        "WalletID",
        "UserID",
        F.lit(0).cast(s.AMOUNT).alias("Balance"),
        F.lit("ZAR").alias("CurrencyCode"),
        F.col("CreatedAt").alias("LastUpdated"),
    )
