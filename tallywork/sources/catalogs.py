"""Reference data: price plans, tenants, meters and API keys.

Tables built from configuration become local relations, so Catalyst knows their
size and broadcasts them on its own when they are below
``spark.sql.autoBroadcastJoinThreshold``. No join here carries a broadcast hint:
a catalog that has outgrown the threshold is joined by shuffle, and AQE splits a
tenant that dominates it.
"""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywork import schemas
from tallywork.functions.money import try_tier_cost

TIER = T.StructType(
    [
        T.StructField("up_to", T.LongType()),
        T.StructField("unit_price_minor", T.LongType()),
        T.StructField("per_units", T.LongType()),
    ]
)
METER_PRICE = T.StructType(
    [T.StructField("type", T.StringType()), T.StructField("tiers", T.ArrayType(TIER))]
)
PLAN_DOCUMENT = T.StructType(
    [
        T.StructField("plan_code", T.StringType()),
        T.StructField("version", T.IntegerType()),
        T.StructField("currency", T.StringType()),
        T.StructField("meters", T.MapType(T.StringType(), METER_PRICE)),
    ]
)


def _local(spark: SparkSession, columns: dict[str, list], types: list[pa.DataType]) -> DataFrame:
    arrays = [pa.array(v, type=t) for v, t in zip(columns.values(), types, strict=True)]
    return spark.createDataFrame(pa.table(arrays, names=list(columns)))


def plan_documents(spark: SparkSession, plans: dict) -> DataFrame:
    """One nested document per plan, from a configuration mapping."""
    docs = [json.dumps({"plan_code": code, **plan}) for code, plan in plans.items()]
    text = _local(spark, {"doc": docs}, [pa.string()])
    return text.select(F.from_json("doc", PLAN_DOCUMENT).alias("d")).select("d.*")


def read_plan_documents(spark: SparkSession, path: str) -> DataFrame:
    """Plan documents from JSON files, one plan per line."""
    return spark.read.schema(PLAN_DOCUMENT).json(path)


def plan_tiers(documents: DataFrame) -> DataFrame:
    """One row per price tier with its neighbours' limits; a price without tiers has one of nulls.

    The neighbours are read from the array, so the step is narrow and needs
    neither shuffle nor window.
    """
    meters = documents.select(
        "plan_code",
        F.col("version").alias("plan_version"),
        F.coalesce("currency", F.lit("AUD")).alias("currency"),
        F.explode("meters").alias("meter_code", "price"),
    )
    tiers = meters.select(
        "plan_code",
        "plan_version",
        "currency",
        "meter_code",
        F.col("price.type").alias("pricing_type"),
        F.col("price.tiers").alias("tiers"),
        F.posexplode_outer("price.tiers").alias("tier_no", "tier"),
    )
    before = F.get("tiers", F.col("tier_no") - 1)["up_to"]
    return tiers.select(
        "plan_code",
        "plan_version",
        "currency",
        "meter_code",
        "pricing_type",
        "tier_no",
        F.coalesce(before, F.lit(0).cast("bigint")).alias("lower_bound"),
        F.col("tier.up_to").alias("up_to"),
        F.col("tier.unit_price_minor").alias("unit_price_minor"),
        F.col("tier.per_units").alias("per_units"),
        F.get("tiers", F.col("tier_no") + 1)["up_to"].alias("next_up_to"),
        (F.col("tier_no") == F.size("tiers") - 1).alias("is_last"),
    )


def flatten_plans(documents: DataFrame) -> DataFrame:
    """Plan documents to one row per price tier; a tier starts where the one before it ends."""
    tiers = plan_tiers(documents).filter(F.col("tier_no").isNotNull())
    return tiers.drop("next_up_to", "is_last")


def _with_blocks_below(ladder: Column) -> Column:
    """Add to each tier of a ladder what the full blocks below it cost.

    Null where that does not fit a ``bigint``: only a quantity that reaches such a
    tier fails.
    """

    def block(total: Column, tier: Column) -> Column:
        units = tier["up_to"] - tier["lower_bound"]
        cost = try_tier_cost(units, tier["unit_price_minor"], tier["per_units"])
        return F.try_add(total, cost)

    return F.transform(
        ladder,
        lambda tier, i: tier.withField(
            "below_minor", F.aggregate(F.slice(ladder, 1, i), F.lit(0).cast("bigint"), block)
        ),
    )


def price_models(tiers: DataFrame) -> DataFrame:
    """One row per (plan, meter) with its ladder as an array, ready to join to readings."""
    ladder = F.array_sort(
        F.collect_list(
            F.struct("tier_no", "lower_bound", "up_to", "unit_price_minor", "per_units")
        )
    )
    return (
        tiers.groupBy("plan_code", "plan_version", "currency", "meter_code", "pricing_type")
        .agg(ladder.alias("tiers"))
        .withColumn("tiers", _with_blocks_below(F.col("tiers")))
    )


def models_from_documents(documents: DataFrame) -> DataFrame:
    """Price models straight from plan documents, without a shuffle."""
    meters = documents.select(
        "plan_code",
        F.col("version").alias("plan_version"),
        F.coalesce("currency", F.lit("AUD")).alias("currency"),
        F.explode("meters").alias("meter_code", "price"),
    )
    ladder = F.transform(
        "price.tiers",
        lambda tier, i: F.struct(
            i.alias("tier_no"),
            F.coalesce(
                F.when(i > 0, F.get(F.col("price.tiers"), i - 1)["up_to"]),
                F.lit(0).cast("bigint"),
            ).alias("lower_bound"),
            tier["up_to"].alias("up_to"),
            tier["unit_price_minor"].alias("unit_price_minor"),
            tier["per_units"].alias("per_units"),
        ),
    )
    return meters.select(
        "plan_code",
        "plan_version",
        "currency",
        "meter_code",
        F.col("price.type").alias("pricing_type"),
        ladder.alias("tiers"),
    ).withColumn("tiers", _with_blocks_below(F.col("tiers")))


def tenant_plans(spark: SparkSession, plans: dict[str, str]) -> DataFrame:
    return _local(
        spark,
        {"tenant_id": list(plans), "plan_code": list(plans.values())},
        [pa.string(), pa.string()],
    )


def tenants(spark: SparkSession, names: dict[str, str], plans: dict[str, str]) -> DataFrame:
    return _local(
        spark,
        {
            "id": list(names),
            "name": list(names.values()),
            "status": ["ACTIVE"] * len(names),
            "plan_code": [plans.get(t) for t in names],
        },
        [pa.string()] * 4,
    )


def meter_catalog(spark: SparkSession, meters: dict[str, str]) -> DataFrame:
    unknown = set(meters.values()) - set(schemas.AGGREGATIONS)
    if unknown:
        raise ValueError(f"unknown aggregation: {sorted(unknown)}")
    return _local(
        spark,
        {"meter_code": list(meters), "aggregation": list(meters.values())},
        [pa.string(), pa.string()],
    )


def api_keys(spark: SparkSession, keys: dict[str, list[str]]) -> DataFrame:
    """Tenant keys stored as SHA-256 digests; a tenant has at most two."""
    rows = [(k, t) for t, tenant_keys in keys.items() for k in tenant_keys]
    if any(len(tenant_keys) > 2 for tenant_keys in keys.values()):
        raise ValueError("a tenant may hold at most two API keys")
    return _local(
        spark,
        {
            "api_key_hash": [hashlib.sha256(k.encode()).hexdigest() for k, _ in rows],
            "tenant_id": [t for _, t in rows],
        },
        [pa.string(), pa.string()],
    )
