import json

from pyspark.sql import functions as F

from conftest import ACME, at
from tallywork import schemas
from tallywork.operators import metering, rating
from tallywork.sources import streams, wire


def test_event_round_trip(events):
    df = events(("idem-123", ACME, "m", 4200, {"model": "gpt-4o", "region": "x"}, 0.5))
    text = wire.encode(df, schemas.USAGE_EVENT)
    row = text.first()
    assert row.key == ACME
    node = json.loads(row.value)
    assert node["tenantId"] == ACME and node["schemaVersion"] == 1
    assert node["occurredAt"] == "2026-07-08T00:00:00.500Z"
    good, bad = wire.decode(text, schemas.USAGE_EVENT)
    assert good.collect() == df.collect() and bad.isEmpty()


def test_charge_round_trip_keeps_money_exact(events, meters, tenant_plan, models):
    df = events(("a", ACME, "llm.tokens.input", 4200, {"model": "gpt-4o"}, 0))
    charges = rating.rate(metering.meter(df, meters), tenant_plan, models)
    text = wire.encode(charges, schemas.CHARGE)
    assert json.loads(text.first().value)["amount"] == {"amountMinor": 126, "currency": "AUD"}
    good, _ = wire.decode(text, schemas.CHARGE)
    assert good.select(charges.columns).collect() == charges.collect()


def test_malformed_and_unknown_fields(spark):
    rows = [
        '{"schemaVersion":1,"idempotencyKey":"a","quantity":5,"somethingNew":[1,2]}',
        '{"schemaVersion":1,"idempotencyKey":"b","quantity":"many"}',
        "{not json",
        None,
    ]
    raw = spark.createDataFrame([(r,) for r in rows], "value string")
    good, bad = wire.decode(raw, schemas.USAGE_EVENT)
    assert [(r.idempotency_key, r.quantity) for r in good.collect()] == [("a", 5)]
    assert {r.value for r in bad.collect()} == set(rows[1:])


def test_kafka_options():
    source = streams.kafka_options("h:9092", wire.USAGE_TOPIC)
    assert source["kafka.isolation.level"] == "read_committed"
    assert source["startingOffsets"] == "earliest"
    sink = streams.kafka_sink_options("h:9092", wire.CHARGE_TOPIC)
    assert sink["kafka.acks"] == "all" and sink["kafka.enable.idempotence"] == "true"


def test_layout_by_tenant(spark):
    rows = spark.range(4000).select(
        F.lit(ACME).alias("tenant_id"), F.col("id").cast("string").alias("key"), F.lit(at(0)).alias("t")
    )

    def parts(df):
        return df.select(F.spark_partition_id()).distinct().count()

    assert parts(streams.by_tenant(rows, 8, "key")) == 1
    assert parts(streams.by_tenant(rows, 8, "key", spread=64)) == 8
