"""Commission rules: creation, partial change, deletion and tier-wide adjustment.

A batch is applied in the order of its requests: after the deletion of a rule there is nothing left to change or delete.
"""

from __future__ import annotations

import datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reckon import schemas as s
from reckon.functions.money import plain_number
from reckon.functions.ordered import with_last_before
from reckon.plans.requests import ARRIVAL, audit, first_reason, given, given_id, known, numbered

_FIELDS = ["CommissionPercentage", "IsActive"]


def _of(action: str) -> Column:
    return F.col("Action") == action


def rule_request_outcomes(commissions: DataFrame, products: DataFrame, requests: DataFrame) -> DataFrame:
    """Every request with Outcome (created, updated, deleted, rejected) and Reason.

    A request for a rule that an earlier request of the batch deleted finds no rule.
    """
    create = first_reason(
        (given_id("ProductID") & given("MerchantTier") & F.col("CommissionPercentage").isNotNull(), "missing field"),
        (F.col("_product"), "product not found"),
    )
    supplied = F.coalesce(*[F.col(c).cast("string") for c in _FIELDS]).isNotNull()
    there = F.col("_rule") & (F.col("_deletion").isNull() | (F.struct(*ARRIVAL) <= F.col("_deletion")))
    update = first_reason((supplied, "nothing to update"), (there, "rule not found"))
    delete = first_reason((there, "rule not found"))
    reason = (
        F.when(_of("create"), create)
        .when(_of("update"), update)
        .when(_of("delete"), delete)
        .otherwise("unknown action")
    )
    return (
        requests.transform(known, "ProductID", products, "_product")
        .transform(known, "CommissionID", commissions, "_rule")
        .join(_deletions(requests), "CommissionID", "left")
        .withColumn("Reason", reason)
        .withColumn(
            "Outcome",
            F.when(F.col("Reason").isNotNull(), "rejected").otherwise(F.concat("Action", F.lit("d"))),
        )
        .select(*requests.columns, "Outcome", "Reason")
    )


def _deletions(requests: DataFrame) -> DataFrame:
    """Per rule the arrival of its first deletion."""
    return requests.filter(_of("delete")).groupBy("CommissionID").agg(F.min(F.struct(*ARRIVAL)).alias("_deletion"))


def _latest_changes(requests: DataFrame) -> DataFrame:
    """Per rule and field the last supplied value."""
    arrival = F.struct(*ARRIVAL)
    return (
        requests.filter(_of("update") & F.coalesce(*[F.col(c).cast("string") for c in _FIELDS]).isNotNull())
        .groupBy("CommissionID")
        .agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), arrival)).alias(f"_{c}") for c in _FIELDS])
    )


def change_commission_rules(
    commissions: DataFrame, products: DataFrame, requests: DataFrame, effective: datetime.date
) -> DataFrame:
    """The rule table after all requests."""
    changed = commissions.join(_latest_changes(requests), "CommissionID", "left").withColumns(
        {c: F.coalesce(f"_{c}", c) for c in _FIELDS}
    )
    deleted = requests.filter(_of("delete")).select("CommissionID").distinct()
    kept = changed.join(deleted, "CommissionID", "left_anti")
    created = rule_request_outcomes(commissions, products, requests).filter(F.col("Outcome") == "created")
    new = numbered(created.drop("CommissionID"), commissions, "CommissionID").withColumns(
        {"EffectiveDate": F.lit(effective), "IsActive": F.lit(True)}
    )
    return kept.select(*commissions.columns).unionByName(new.select(*commissions.columns))


def rule_audit(commissions: DataFrame, products: DataFrame, requests: DataFrame, by: int) -> DataFrame:
    """One audit row per applied update: the percentage before and after it.

    Before is the last percentage that an earlier update set, or that of the table.
    """
    outcomes = rule_request_outcomes(commissions, products, requests)
    applied = outcomes.filter(F.col("Outcome") == "updated").select(*ARRIVAL, "CommissionID", "CommissionPercentage")
    traced = with_last_before(applied, ["CommissionID"], ARRIVAL, "CommissionPercentage", "_before")
    table = commissions.select("CommissionID", F.col("CommissionPercentage").alias("_initial"))
    before = F.coalesce("_before", "_initial")
    return audit(
        traced.join(table, "CommissionID"),
        F.lit("UPDATE_COMMISSION"),
        "Commissions",
        F.col("CommissionID"),
        plain_number(before),
        plain_number(F.coalesce(F.col("CommissionPercentage"), before)),
        by,
    )


def adjust_tier_rates(commissions: DataFrame, adjustments: dict[str, Decimal]) -> DataFrame:
    """Add each adjustment to the active rules of its tier. A column expression: no join on the few tiers.

    Percentages have two decimals; an adjustment with more is refused, as it could not be applied whole.
    """
    for value in adjustments.values():
        if value != round(value, 2):
            raise ValueError(f"an adjustment of {value} has more than two decimals")
    return commissions.withColumn(
        "CommissionPercentage",
        (F.col("CommissionPercentage") + F.when(F.col("IsActive"), _adjustment(adjustments)).otherwise(0)).cast(
            s.PERCENT
        ),
    )


def _adjustment(adjustments: dict[str, Decimal]) -> Column:
    amount = F.lit(Decimal(0))
    for tier, value in adjustments.items():
        amount = F.when(F.col("MerchantTier") == tier, F.lit(value)).otherwise(amount)
    return amount


def rate_adjustment_audit(commissions: DataFrame, adjustments: dict[str, Decimal], by: int) -> DataFrame:
    """One audit row per adjusted tier, with the number of rules it reached."""
    rows = [
        F.struct(
            F.lit(f"Tier {tier} adjusted by {value.normalize():f}%").alias("_text"),
            F.count_if(F.col("IsActive") & (F.col("MerchantTier") == tier)).alias("RulesUpdated"),
        )
        for tier, value in adjustments.items()
    ]
    exploded = commissions.agg(F.array(*rows).cast("array<struct<_text:string,RulesUpdated:bigint>>").alias("_rows")).select(F.inline("_rows"))
    return audit(
        exploded,
        F.lit("BULK_RATE_UPDATE"),
        "Commissions",
        F.lit("ALL"),
        F.lit(None),
        F.col("_text"),
        by,
        "RulesUpdated",
    )
