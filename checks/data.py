"""Usage tables derived from the test tables, on Spark.

``checks/oracle.py`` derives the same tables in SQL. All rows of the source
tables take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywork import configure
from tallywork.functions.keys import dimension_key, iso_instant
from tallywork.operators import ingest, metering, rating
from tallywork.plans import standard
from tallywork.sources import catalogs

T1, T2, T3 = standard.TENANT_PLANS
T9 = "99999999-9999-9999-9999-999999999999"

# Two keys for the first tenant, one for each other; "key-5" belongs to nobody,
# and the last tenant has no plan.
API_KEYS = {T1: ["key-0", "key-1"], T2: ["key-2"], T3: ["key-3"], T9: ["key-4"]}

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
FREIGHT_METERS = ("AF", "AO", "NF", "NO", "RF")
PRICING = ("FLAT", "TIERED", "VOLUME")


def freight_plans() -> dict:
    """A plan per market segment; one meter is left unpriced on purpose."""
    plans = {}
    for s, segment in enumerate(SEGMENTS):
        meters = {}
        for m, meter in enumerate(FREIGHT_METERS):
            meters[meter] = {
                "type": PRICING[(s + m) % 3],
                "tiers": [
                    {"up_to": 20 + s, "unit_price_minor": 700 + 13 * m, "per_units": 3},
                    {"up_to": 60 + s, "unit_price_minor": 600 + 11 * m, "per_units": 4},
                    {"up_to": None, "unit_price_minor": 500 + 7 * m, "per_units": 7},
                ],
            }
        plans[segment] = {"version": 1 + s, "currency": "AUD", "meters": meters}
    return plans


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A test table; its zone-less times are UTC instants."""
    configure(spark)
    return in_utc(spark.read.parquet(f"{sf}/{name}.parquet"))


def in_utc(df: DataFrame) -> DataFrame:
    """Zone-less times, read as UTC, to instants."""
    naive = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive})


def k_value() -> Column:
    return F.regexp_extract("props", "([0-9]+)", 1).cast("int")


def shifted(ts: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + seconds.cast("bigint") * 1_000_000)


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """Usage requests: every event, with skewed clocks, out-of-order arrival and reused keys."""
    return requests_of(table(spark, sf, "events"))


def requests_of(events: DataFrame) -> DataFrame:
    """:func:`requests` of a table or stream of events."""
    e = in_utc(events).withColumn("k", k_value())
    meter = (
        F.when(F.col("event_type") == "click", "llm.tokens.input")
        .when(F.col("event_type") == "view", "llm.tokens.output")
        .when(F.col("event_type") == "purchase", "llm.requests")
        .when(F.col("event_type") == "signup", "storage.gb")
        .otherwise("no.such.meter")
    )
    region = F.when(F.col("k") % 3 == 0, "ap-southeast-2").otherwise("us-east-1")
    model = F.when(F.col("k") % 2 == 0, "small").otherwise("large")
    dims = F.create_map(F.lit("region"), region, F.lit("model"), model)
    user = F.col("user_id").cast("string")
    return e.select(
        F.concat_ws(":", user, F.date_format("ts", "yyyy-MM-dd")).alias("request_id"),
        "event_id",
        F.concat(F.lit("key-"), (F.col("user_id") % 6).cast("string")).alias("api_key"),
        F.concat_ws(
            ":", user, F.col("event_type"), F.floor(F.col("k") / 20).cast("string")
        ).alias("idempotency_key"),
        meter.alias("meter_code"),
        (F.round(F.col("value") * 1000).cast("bigint") - 500).alias("quantity"),
        F.when(F.col("k") >= 10, dims).alias("dimensions"),
        shifted(F.col("ts"), F.col("k") * 4 - 60).alias("occurred_at"),
        shifted(F.col("ts"), F.col("event_id") % 120).alias("received_at"),
    )


def keys(spark: SparkSession) -> DataFrame:
    return catalogs.api_keys(spark, API_KEYS)


def meters(spark: SparkSession) -> DataFrame:
    return catalogs.meter_catalog(spark, {**standard.METERS, "storage.gb": "MAX"})


def tenant_plan(spark: SparkSession) -> DataFrame:
    return catalogs.tenant_plans(spark, standard.TENANT_PLANS)


def models(spark: SparkSession, version: int | None = None) -> DataFrame:
    plans = standard.PRICE_PLANS
    if version is not None:
        plans = {code: {**plan, "version": version} for code, plan in plans.items()}
    return catalogs.models_from_documents(catalogs.plan_documents(spark, plans))


def tenants(spark: SparkSession) -> DataFrame:
    names = {**standard.TENANT_NAMES, T9: "Umbrella"}
    return catalogs.tenants(spark, names, standard.TENANT_PLANS)


def validated(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.validate(requests(spark, sf), keys(spark), meters(spark))


def clean_of(rows: DataFrame, spark: SparkSession) -> DataFrame:
    """The requests that pass every check without state."""
    return ingest.validate(rows, keys(spark), meters(spark)).filter(
        F.col("static_reason").isNull() & F.col("business_reason").isNull()
    )


def clean(spark: SparkSession, sf: str) -> DataFrame:
    return clean_of(requests(spark, sf), spark)


def ingested(spark: SparkSession, sf: str) -> ingest.Ingested:
    return ingest.ingest(requests(spark, sf), keys(spark), meters(spark))


def readings(spark: SparkSession, sf: str, window: str = "1 day") -> DataFrame:
    return metering.meter(clean(spark, sf), meters(spark), window)


def charges(
    spark: SparkSession, sf: str, window: str = "1 day", version: int | None = None
) -> DataFrame:
    return rating.rate(
        readings(spark, sf, window), tenant_plan(spark), models(spark, version)
    )


def freight_events(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as usage: customers are tenants, return flag and status the meter."""
    line = table(spark, sf, "lineitem")
    order = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return line.join(order, line.l_orderkey == order.o_orderkey).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("idempotency_key"),
        F.col("o_custkey").cast("string").alias("tenant_id"),
        F.concat("l_returnflag", "l_linestatus").alias("meter_code"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        F.create_map(F.lit("priority"), F.col("o_orderpriority")).alias("dimensions"),
        F.col("l_shipdate").alias("occurred_at"),
        F.col("l_shipdate").alias("received_at"),
    )


def freight_tenant_plan(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("tenant_id"),
        F.col("c_mktsegment").alias("plan_code"),
    )


def freight_tenants(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("id"),
        F.col("c_name").alias("name"),
        F.lit("ACTIVE").alias("status"),
        F.col("c_mktsegment").alias("plan_code"),
    )


def freight_meters(spark: SparkSession) -> DataFrame:
    return catalogs.meter_catalog(spark, {"AO": "MAX", "NF": "COUNT"})


def freight_models(spark: SparkSession) -> DataFrame:
    return catalogs.models_from_documents(catalogs.plan_documents(spark, freight_plans()))


def freight_readings(spark: SparkSession, sf: str, window: str = "7 days") -> DataFrame:
    return metering.meter(freight_events(spark, sf), freight_meters(spark), window)


def freight_charges(spark: SparkSession, sf: str, window: str = "7 days") -> DataFrame:
    return rating.rate(
        freight_readings(spark, sf, window), freight_tenant_plan(spark, sf), freight_models(spark)
    )


def plan_documents(spark: SparkSession, sf: str) -> DataFrame:
    """One plan document per order, its lines read as price tiers, well-formed or not."""
    tier = F.struct(
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.when(F.col("l_discount") > 0.04, F.col("l_quantity").cast("bigint") - 1).alias("up_to"),
        F.round(F.col("l_tax") * 100).cast("bigint").alias("unit_price_minor"),
        F.col("l_linenumber").cast("bigint").alias("per_units"),
    )
    ladder = F.transform(
        F.array_sort(F.collect_list(tier)),
        lambda t: F.struct(t["up_to"].alias("up_to"), t["unit_price_minor"].alias("unit_price_minor"),
                           t["per_units"].alias("per_units")),
    )
    kind = F.when(F.min("l_linestatus") == "O", "TIERED").otherwise("VOLUME")
    prices = (
        table(spark, sf, "lineitem")
        .groupBy("l_orderkey", "l_returnflag")
        .agg(F.struct(kind.alias("type"), ladder.alias("tiers")).alias("price"))
    )
    return prices.groupBy("l_orderkey").agg(
        F.map_from_entries(F.collect_list(F.struct("l_returnflag", "price"))).alias("meters")
    ).select(
        F.concat(F.lit("order-"), F.col("l_orderkey").cast("string")).alias("plan_code"),
        F.lit(1).alias("version"),
        F.lit("AUD").alias("currency"),
        "meters",
    )


def request_log(spark: SparkSession, sf: str) -> DataFrame:
    """Requests with latency and status, from the events."""
    e = table(spark, sf, "events").withColumn("k", k_value())
    status = F.when(F.col("k") >= 97, 429).when(F.col("k") >= 95, 503).otherwise(202)
    return e.select(
        "event_id",
        "ts",
        F.col("event_type").alias("application"),
        F.when(F.col("user_id") % 2 == 0, "threads").otherwise("reactive").alias("gateway"),
        (F.lit(500) * (F.col("k") % 4 + 1)).cast("int").alias("target_rate"),
        status.alias("status"),
        F.col("value").alias("latency_ms"),
    )


def metric_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Counter samples with resets, from the events."""
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("sample_id"),
        "ts",
        F.col("event_type").alias("application"),
        F.concat(F.lit("client-"), (F.col("user_id") % 10).cast("string")).alias("client_id"),
        F.col("user_id").cast("string").alias("topic_partition"),
        k_value().cast("bigint").alias("value"),
    )


def text_of(df: DataFrame) -> DataFrame:
    """Replace times, windows and dimension maps by their wire text, for comparison."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampType):
            out.append(iso_instant(c).alias(f.name))
        elif isinstance(f.dataType, T.MapType):
            out.append(dimension_key(c).alias("dimension_key"))
        elif isinstance(f.dataType, T.StructType) and f.dataType.names == ["start", "end"]:
            out.append(iso_instant(c["start"]).alias("window_start"))
            out.append(iso_instant(c["end"]).alias("window_end"))
        else:
            out.append(c)
    return df.select(*out)


JANUARY = "2024-01"


def deliveries(spark: SparkSession, sf: str, window: str = "1 day") -> DataFrame:
    """Charges as an at-least-once topic delivers them: each twice, corrected the second time."""
    once = charges(spark, sf, window)
    again = once.withColumn("amount_minor", F.col("amount_minor") + F.col("quantity_billed") % 2)
    return once.withColumn("delivery", F.lit(1)).unionByName(again.withColumn("delivery", F.lit(2)))
