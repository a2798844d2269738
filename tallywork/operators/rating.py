"""Rating: readings to charges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywork import schemas
from tallywork.functions.keys import charge_id, entries_key, sorted_entries
from tallywork.functions.money import fits, tier_cost


def covering_tier(pricing_type: Column, quantity: Column, tiers: Column) -> Column:
    """The tier that decides a price: the first whose limit, included, covers the quantity.

    FLAT prices use the first tier whatever its limit. An unknown type fails the job.
    """
    unknown = F.raise_error(F.concat(F.lit("unknown pricing type: "), pricing_type))
    covers = F.filter(tiers, lambda tier: tier["up_to"].isNull() | (quantity <= tier["up_to"]))
    return (
        F.when(pricing_type == "FLAT", F.get(tiers, F.lit(0)))
        .when(pricing_type.isin("TIERED", "VOLUME"), F.get(covers, F.lit(0)))
        .otherwise(unknown)
    )


def price_in_tier(pricing_type: Column, quantity: Column, tier: Column) -> Column:
    """Price of a quantity, given its covering tier.

    FLAT and VOLUME price every unit at the tier's rate. TIERED prices the units
    above the tier's lower bound and adds what the full blocks below cost, each
    rounded on its own; that sum depends on the ladder only and is part of the
    price model.
    """
    graduated = pricing_type == "TIERED"
    units = F.when(graduated, quantity - tier["lower_bound"]).otherwise(quantity)
    below = F.when(graduated, tier["below_minor"]).otherwise(F.lit(0).cast("bigint"))
    return tier_cost(units, tier["unit_price_minor"], tier["per_units"]) + fits(below)


def price(pricing_type: Column, quantity: Column, tiers: Column) -> Column:
    """Price of a quantity on a ladder."""
    chosen = F.array(covering_tier(pricing_type, quantity, tiers))
    return F.get(
        F.transform(chosen, lambda tier: price_in_tier(pricing_type, quantity, tier)), F.lit(0)
    )


def with_plan(readings: DataFrame, tenant_plan: DataFrame) -> DataFrame:
    """Readings of tenants that have a plan."""
    return readings.join(tenant_plan, "tenant_id")


def with_model(planned: DataFrame, models: DataFrame) -> DataFrame:
    """Readings whose meter the plan prices."""
    return planned.join(models, ["plan_code", "meter_code"])


def to_charges(priced: DataFrame) -> DataFrame:
    """Project priced readings to the charge contract."""
    kind, quantity = F.col("pricing_type"), F.col("quantity")
    staged = priced.select(
        "tenant_id",
        "meter_code",
        "window",
        "dimensions",
        "quantity",
        "currency",
        "plan_version",
        "pricing_type",
        covering_tier(kind, quantity, F.col("tiers")).alias("tier"),
        sorted_entries(F.col("dimensions")).alias("entries"),
    )
    return staged.select(
        F.lit(schemas.SCHEMA_VERSION).alias("schema_version"),
        charge_id(
            F.col("tenant_id"),
            F.col("meter_code"),
            F.col("window"),
            F.col("entries"),
            F.col("plan_version"),
        ).alias("charge_id"),
        "tenant_id",
        "meter_code",
        "window",
        "dimensions",
        F.col("quantity").alias("quantity_billed"),
        price_in_tier(kind, quantity, F.col("tier")).alias("amount_minor"),
        "currency",
        "plan_version",
    )


def rate(readings: DataFrame, tenant_plan: DataFrame, models: DataFrame) -> DataFrame:
    """Charge every reading whose tenant has a plan that prices its meter.

    Narrow while the two catalogs are below the broadcast threshold.
    """
    return to_charges(with_model(with_plan(readings, tenant_plan), models))


def unrated(readings: DataFrame, tenant_plan: DataFrame, models: DataFrame) -> DataFrame:
    """Readings that :func:`rate` leaves without a charge, with the reason."""
    plans = models.select("plan_code", F.lit(True).alias("_plan")).distinct()
    priced = models.select("plan_code", "meter_code", F.lit(True).alias("_priced"))
    reason = F.when(F.col("_plan").isNull(), "no_plan").when(
        F.col("_priced").isNull(), "unpriced_meter"
    )
    return (
        readings.join(tenant_plan, "tenant_id", "left")
        .join(plans, "plan_code", "left")
        .join(priced, ["plan_code", "meter_code"], "left")
        .withColumn("reason", reason)
        .filter(F.col("reason").isNotNull())
        .drop("_plan", "_priced", "plan_code")
    )


def ladder_violations(documents: DataFrame) -> DataFrame:
    """Price tiers of plan documents that break the rules of a ladder, with the first rule broken.

    A price has at least one tier. Quanta are at least one, prices and limits at
    least zero; limits strictly increase; exactly the last tier is unbounded. The
    last two rules do not apply to FLAT prices. Narrow: a tier's neighbours come
    from its array.
    """
    from tallywork.sources.catalogs import plan_tiers

    laddered = F.col("pricing_type") != "FLAT"
    last = F.col("is_last")
    problem = (
        F.when(F.col("tier_no").isNull(), "empty_ladder")
        .when(F.col("per_units") < 1, "per_units_below_one")
        .when(F.col("unit_price_minor") < 0, "negative_price")
        .when(F.col("up_to") < 0, "negative_limit")
        .when(laddered & last & F.col("up_to").isNotNull(), "last_tier_bounded")
        .when(laddered & ~last & F.col("up_to").isNull(), "unbounded_before_last")
        .when(
            laddered & ~last & (F.col("next_up_to") <= F.col("up_to")), "limits_not_increasing"
        )
    )
    return (
        plan_tiers(documents)
        .withColumn("violation", problem)
        .filter(F.col("violation").isNotNull())
        .select(
            "plan_code", "plan_version", "meter_code", "tier_no", "up_to", "next_up_to", "violation"
        )
    )


def checked_models(documents: DataFrame) -> DataFrame:
    """Price models from plan documents, refused as a whole if a ladder is malformed."""
    from tallywork.sources.catalogs import models_from_documents

    broken = ladder_violations(documents).first()
    if broken is not None:
        raise ValueError(f"malformed price ladder: {broken.asDict()}")
    return models_from_documents(documents)


def rerating_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Compare the charges of two rating runs by billing coordinates.

    Same plan version: same id, and an amount that differs is a fault. New plan
    version: new id.
    """

    def side(charges: DataFrame, name: str) -> DataFrame:
        return charges.select(
            "tenant_id",
            "meter_code",
            "window",
            entries_key(sorted_entries(F.col("dimensions"))).alias("dimension_key"),
            F.col("charge_id").alias(f"{name}_charge_id"),
            F.col("amount_minor").alias(f"{name}_amount_minor"),
        )

    keys = ["tenant_id", "meter_code", "window", "dimension_key"]
    zero = F.lit(0).cast("bigint")
    return (
        side(before, "old")
        .join(side(after, "new"), keys, "full_outer")
        .withColumn("same_id", F.col("old_charge_id").eqNullSafe(F.col("new_charge_id")))
        .withColumn(
            "delta_minor",
            F.coalesce("new_amount_minor", zero) - F.coalesce("old_amount_minor", zero),
        )
    )
