"""New products and partial product changes. A request without ProductID asks for a new product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reckon.plans.requests import (
    ARRIVAL,
    audit,
    first_of_each,
    first_reason,
    given,
    given_id,
    known,
    numbered,
)

_FIELDS = ["Description", "FaceValue", "IsActive"]


def _is_new() -> Column:
    return F.col("ProductID").isNull()


def product_request_outcomes(products: DataFrame, providers: DataFrame, requests: DataFrame) -> DataFrame:
    """Every request with Outcome (created, updated, rejected) and Reason. SKUs stay unique: the first
    valid request for a new SKU wins."""
    complete = given_id("ProviderID") & given("SKU") & given("Description") & F.col("FaceValue").isNotNull()
    create_reason = first_reason(
        (complete, "missing field"), (F.col("_provider"), "provider not found"), (~F.col("_sku"), "sku exists")
    )
    supplied = F.coalesce(*[F.col(c).cast("string") for c in _FIELDS]).isNotNull()
    update_reason = first_reason((supplied, "nothing to update"), (F.col("_product"), "product not found"))
    checked = (
        requests.transform(known, "ProviderID", providers, "_provider")
        .transform(known, "SKU", products, "_sku")
        .transform(known, "ProductID", products, "_product")
        .withColumn("_reason", F.when(_is_new(), create_reason).otherwise(update_reason))
    )
    winners = first_of_each(checked.filter(_is_new() & F.col("_reason").isNull()), "SKU")
    won = winners.select("RequestID", F.lit(True).alias("_won"))
    reason = F.coalesce("_reason", F.when(_is_new() & F.col("_won").isNull(), "sku exists"))
    return checked.join(won, "RequestID", "left").select(
        *requests.columns,
        F.when(reason.isNotNull(), "rejected").when(_is_new(), "created").otherwise("updated").alias("Outcome"),
        reason.alias("Reason"),
    )


def created_products(products: DataFrame, providers: DataFrame, requests: DataFrame) -> DataFrame:
    created = product_request_outcomes(products, providers, requests).filter(F.col("Outcome") == "created")
    return numbered(created.drop("ProductID"), products, "ProductID").select(
        "ProductID",
        "ProviderID",
        "SKU",
        "Description",
        "FaceValue",
        F.coalesce("IsActive", F.lit(True)).alias("IsActive"),
    )


def upsert_products(products: DataFrame, providers: DataFrame, requests: DataFrame) -> DataFrame:
    """The product table after all requests; per field the latest supplied value counts."""
    latest = (
        requests.filter(~_is_new())
        .groupBy("ProductID")
        .agg(*[_latest(c).alias(f"_{c}") for c in _FIELDS])
    )
    updated = products.join(latest, "ProductID", "left").withColumns(
        {c: F.coalesce(f"_{c}", c) for c in _FIELDS}
    )
    return updated.select(*products.columns).unionByName(
        created_products(products, providers, requests).select(*products.columns)
    )


def _latest(field: str) -> Column:
    """Last non-null value; rows that leave the field out sort before all others."""
    return F.max_by(field, F.when(F.col(field).isNotNull(), F.struct(*ARRIVAL)))


def product_audit(created: DataFrame, by: int) -> DataFrame:
    """Audit rows of created products; updates leave none."""
    return audit(
        created, F.lit("CREATE_PRODUCT"), "Products", F.col("ProductID"), F.lit(None), F.col("Description"), by
    )
