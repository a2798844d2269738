"""Queries over sources, the wire format and ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import data
from checks.oracle import iso_us, sql
from checks.registry import query
from tallywork import schemas
from tallywork.operators import ingest, metering, ratelimit
from tallywork.sources import catalogs, streams, wire

Bucket = ratelimit.Bucket
DIMS_JSON = (
    "CASE WHEN dimension_key = '' THEN '{}' ELSE '{\"model\":\"' || CASE WHEN k % 2 = 0 "
    "THEN 'small' ELSE 'large' END || '\",\"region\":\"' || CASE WHEN k % 3 = 0 "
    "THEN 'ap-southeast-2' ELSE 'us-east-1' END || '\"}' END"
)


def _wire_text(spark, sf):
    """Usage events as JSON text; the clean ones valid, the rest cut off in the middle."""
    rows = data.validated(spark, sf)
    good = F.col("static_reason").isNull() & F.col("business_reason").isNull()
    text = rows.select(
        "event_id",
        good.alias("good"),
        F.lit(1).alias("schema_version"),
        "idempotency_key",
        "tenant_id",
        "meter_code",
        "quantity",
        "dimensions",
        "occurred_at",
        "received_at",
    ).withColumn("value", wire.encode_value(schemas.USAGE_EVENT))
    cut = F.col("value").substr(F.lit(1), F.length("value") - 7)
    return text.select("event_id", F.when(F.col("good"), F.col("value")).otherwise(cut).alias("value"))


@query(
    sql(
        "SELECT 1 AS schema_version, idempotency_key, tenant_id, meter_code, quantity, "
        f"dimension_key, {iso_us('occurred_at')} AS occurred_at, "
        f"{iso_us('received_at')} AS received_at FROM clean",
        "clean",
    )
)
def decode_events(spark, sf):
    good, _ = wire.decode(_wire_text(spark, sf), schemas.USAGE_EVENT)
    return good


@query(sql("SELECT event_id FROM checked WHERE reject_reason IS NOT NULL", "checked"))
def decode_quarantine(spark, sf):
    _, bad = wire.decode(_wire_text(spark, sf), schemas.USAGE_EVENT)
    return bad.select("event_id")


@query(
    sql(
        "SELECT c.tenant_id AS key, '{\"schemaVersion\":1,\"idempotencyKey\":\"' || "
        "c.idempotency_key || '\",\"tenantId\":\"' || c.tenant_id || '\",\"meterCode\":\"' || "
        "c.meter_code || '\",\"quantity\":' || c.quantity || ',\"dimensions\":' || "
        f"{DIMS_JSON} || ',\"occurredAt\":\"' || {iso_us('c.occurred_at')} || "
        f"'\",\"receivedAt\":\"' || {iso_us('c.received_at')} || '\"}}' AS value "
        "FROM clean c JOIN req0 USING (event_id)",
        "clean",
        "req0",
    )
)
def encode_events(spark, sf):
    return wire.encode(ingest.stamp(data.clean(spark, sf)), schemas.USAGE_EVENT)


@query(
    sql(
        "SELECT tenant_id, meter_code, dimension_key, "
        "strftime(window_start, '%Y-%m-%dT%H:%M:%SZ') AS window_start, "
        "strftime(window_end, '%Y-%m-%dT%H:%M:%SZ') AS window_end, quantity, event_count, "
        "1 AS schema_version FROM readings",
        "readings",
    )
)
def reading_round_trip(spark, sf):
    text = wire.encode(data.readings(spark, sf), schemas.METER_READING)
    return wire.decode(text, schemas.METER_READING)[0]


@query(
    sql(
        "SELECT charge_id, tenant_id, meter_code, dimension_key, "
        "strftime(window_start, '%Y-%m-%dT%H:%M:%SZ') AS window_start, "
        "strftime(window_end, '%Y-%m-%dT%H:%M:%SZ') AS window_end, "
        "quantity AS quantity_billed, amount_minor, 'AUD' AS currency, plan_version, "
        "1 AS schema_version FROM charges",
        "charges",
    )
)
def charge_round_trip(spark, sf):
    text = wire.encode(data.charges(spark, sf), schemas.CHARGE)
    return wire.decode(text, schemas.CHARGE)[0]


@query(
    sql(
        "SELECT plan_code, 1 AS plan_version, 'AUD' AS currency, meter_code, pricing_type, tier_no, "
        "coalesce(prev_up, 0) AS lower_bound, up_to, unit_price_minor, per_units FROM ladder",
        "ladder",
    )
)
def flatten_plan_documents(spark, sf):
    return catalogs.flatten_plans(data.plan_documents(spark, sf))


@query(
    sql(
        "SELECT plan_code, meter_code, pricing_type, count(*) AS tiers, "
        "CAST(sum(coalesce(prev_up, 0)) AS BIGINT) AS bounds, "
        "CAST(sum(unit_price_minor) AS BIGINT) AS prices FROM ladder GROUP BY ALL",
        "ladder",
    )
)
def load_price_models(spark, sf):
    models = catalogs.models_from_documents(data.plan_documents(spark, sf))
    add = lambda part: F.aggregate(
        "tiers", F.lit(0).cast("bigint"), lambda s, t: s + t[part]
    )
    return models.select(
        "plan_code",
        "meter_code",
        "pricing_type",
        F.size("tiers").cast("bigint").alias("tiers"),
        add("lower_bound").alias("bounds"),
        add("unit_price_minor").alias("prices"),
    )


@query(
    "SELECT c_mktsegment AS plan_code, count(*) AS tenants, min(c_name) AS first_name "
    "FROM customer GROUP BY ALL"
)
def load_tenants(spark, sf):
    plans = data.freight_tenant_plan(spark, sf).withColumnRenamed("tenant_id", "id")
    return (
        data.freight_tenants(spark, sf)
        .join(plans, ["id", "plan_code"])
        .groupBy("plan_code")
        .agg(F.count(F.lit(1)).alias("tenants"), F.min("name").alias("first_name"))
    )


@query(sql("SELECT tenant_id, count(*) AS events, 1 AS partitions FROM clean GROUP BY ALL", "clean"))
def tenant_layout(spark, sf):
    laid_out = streams.by_tenant(data.clean(spark, sf), 8, "idempotency_key")
    seen = laid_out.select("tenant_id", F.spark_partition_id().alias("p"))
    return seen.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("events"),
        (F.max("p") - F.min("p") + 1).alias("partitions"),
    )


@query(
    sql(
        "SELECT event_id, CASE WHEN quantity < 0 THEN 'validation_failed' END AS reject_reason "
        "FROM req",
        "req",
    )
)
def static_validation(spark, sf):
    return data.requests(spark, sf).select(
        "event_id", ingest.static_problem().alias("reject_reason")
    )


@query(
    sql(
        "SELECT request_id, count(*) AS batch_size FROM req GROUP BY ALL HAVING count(*) > 3", "req"
    )
)
def oversized_batches(spark, sf):
    return ingest.oversized_batches(data.requests(spark, sf), limit=3).select("request_id", "batch_size")


@query(sql("SELECT event_id, meter_code FROM req WHERE meter_code <> 'no.such.meter'", "req"))
def known_meters(spark, sf):
    rows = data.requests(spark, sf).select("event_id", "meter_code")
    return ingest.known_meters(rows, data.meters(spark))


@query(sql("SELECT event_id, meter_code FROM req WHERE meter_code = 'no.such.meter'", "req"))
def unknown_meters(spark, sf):
    rows = data.requests(spark, sf).select("event_id", "meter_code")
    return ingest.unknown_meters(rows, data.meters(spark))


@query(
    sql(
        "SELECT event_id, occurred_at > received_at + INTERVAL 5 MINUTE AS too_far_ahead FROM req",
        "req",
    )
)
def future_skew(spark, sf):
    return data.requests(spark, sf).select(
        "event_id", ingest.too_far_ahead().alias("too_far_ahead")
    )


@query(sql("SELECT event_id, tenant_id FROM resolved", "resolved"))
def resolve_tenants(spark, sf):
    rows = ingest.resolve_tenants(data.requests(spark, sf), data.keys(spark))
    return rows.select("event_id", "tenant_id")


RATE = Bucket(capacity=3, refill=3, period="2 hours")
_cost_us = 2 * 3600 * 1_000_000


@query(
    sql(
        ", demand AS (SELECT tenant_id, request_id, epoch_us(max(received_at)) AS at_us, "
        "count(*) AS tokens FROM resolved WHERE tenant_id IS NOT NULL GROUP BY ALL), "
        "numbered AS (SELECT *, row_number() OVER (PARTITION BY tenant_id "
        "ORDER BY at_us, request_id) AS n FROM demand), "
        f"bucket AS (SELECT tenant_id, request_id, n, at_us, tokens, tokens <= 3 AS granted, "
        f"CAST(CASE WHEN tokens <= 3 THEN 3 - tokens ELSE 3 END * {_cost_us} AS BIGINT) AS level "
        "FROM numbered WHERE n = 1 UNION ALL "
        "SELECT d.tenant_id, d.request_id, d.n, d.at_us, d.tokens, "
        f"least(3 * {_cost_us}, b.level + (d.at_us - b.at_us) * 3) >= d.tokens * {_cost_us}, "
        f"CAST(least(3 * {_cost_us}, b.level + (d.at_us - b.at_us) * 3) - CASE WHEN "
        f"least(3 * {_cost_us}, b.level + (d.at_us - b.at_us) * 3) >= d.tokens * {_cost_us} "
        f"THEN d.tokens * {_cost_us} ELSE 0 END AS BIGINT) "
        "FROM bucket b JOIN numbered d ON d.tenant_id = b.tenant_id AND d.n = b.n + 1) "
        "SELECT tenant_id, request_id, tokens, granted FROM bucket",
        "resolved",
    )
)
def rate_limit(spark, sf):
    rows = ingest.resolve_tenants(data.requests(spark, sf), data.keys(spark))
    asked = ratelimit.requests_of(rows.filter(F.col("tenant_id").isNotNull()))
    return ratelimit.decide_requests(asked, RATE, chunk_slots=4).select(
        "tenant_id", "request_id", "tokens", "granted"
    )


@query(
    sql(
        "SELECT event_id, outcome = 'deduplicated' AS deduplicated FROM outcomes "
        "WHERE reject_reason IS NULL",
        "outcomes",
    )
)
def deduplicate(spark, sf):
    from tallywork.operators.dedup import flag_duplicates

    return flag_duplicates(data.clean(spark, sf)).select("event_id", "deduplicated")


@query(
    sql(
        "SELECT event_id, outcome = 'deduplicated' AS deduplicated FROM outcomes "
        "WHERE reject_reason IS NULL",
        "outcomes",
    )
)
def deduplicate_heavy_keys(spark, sf):
    from tallywork.operators.dedup import flag_duplicates

    return flag_duplicates(data.clean(spark, sf), max_folded=4).select("event_id", "deduplicated")


@query(
    sql(
        "SELECT 1 AS schema_version, idempotency_key, tenant_id, meter_code, quantity, "
        f"dimension_key, {iso_us('occurred_at')} AS occurred_at, "
        f"{iso_us('received_at')} AS received_at FROM accepted",
        "accepted",
    )
)
def accepted_events(spark, sf):
    return data.ingested(spark, sf).accepted


@query(sql("SELECT event_id, tenant_id, outcome, reject_reason FROM outcomes", "outcomes"))
def event_outcomes(spark, sf):
    return data.ingested(spark, sf).outcomes.select(
        "event_id", "tenant_id", "outcome", "reject_reason"
    )


@query(
    sql(
        "SELECT tenant_id, request_id, count(*) AS received, "
        "count(*) FILTER (outcome = 'accepted') AS accepted, "
        "count(*) FILTER (outcome = 'deduplicated') AS deduplicated FROM outcomes "
        "WHERE outcome <> 'rejected' GROUP BY ALL",
        "outcomes",
    )
)
def batch_responses(spark, sf):
    return ingest.batch_responses(data.ingested(spark, sf).outcomes)


@query(sql("SELECT tenant_id, outcome, count(*) AS events FROM outcomes GROUP BY ALL", "outcomes"))
def outcome_counts(spark, sf):
    return ingest.outcome_counts(data.ingested(spark, sf).outcomes)


@query(
    sql(
        "SELECT tenant_id, reject_reason, count(*) AS events FROM checked "
        "WHERE reject_reason IS NOT NULL GROUP BY ALL",
        "checked",
    )
)
def rejection_summary(spark, sf):
    return ingest.rejection_summary(data.ingested(spark, sf).outcomes)


@query(
    sql(
        "SELECT event_id, dimension_key, CAST(CASE WHEN dimension_key = '' THEN 0 ELSE 2 END "
        "AS INTEGER) AS entry_count, CASE WHEN dimension_key <> '' THEN 'model' END AS first_key "
        "FROM req",
        "req",
    )
)
def canonical_dimensions(spark, sf):
    from tallywork.functions import keys as K

    rows = data.requests(spark, sf).withColumn("c", K.canonical_dimensions(F.col("dimensions")))
    return rows.select(
        "event_id",
        K.dimension_key(F.col("dimensions")).alias("dimension_key"),
        F.size("c").alias("entry_count"),
        F.get(F.map_keys("c"), F.lit(0)).alias("first_key"),
    )


@query(
    sql(
        ", seen AS (SELECT event_id, tenant_id, occurred_at, "
        "make_timestamp((epoch_us(occurred_at) // 60000000 + 1) * 60000000) AS ends, "
        "max(occurred_at) OVER (PARTITION BY tenant_id ORDER BY received_at, event_id "
        "ROWS UNBOUNDED PRECEDING) AS stream_time FROM clean) "
        "SELECT event_id, CASE WHEN ends + INTERVAL 30 SECOND <= stream_time THEN 'dropped' "
        "WHEN ends <= stream_time THEN 'late' ELSE 'on_time' END AS lateness FROM seen",
        "clean",
    )
)
def lateness(spark, sf):
    return metering.classify_lateness(data.clean(spark, sf)).select("event_id", "lateness")
