"""Ingestion runs that follow each other decide like one run over all their requests."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import ACME, BASE, GLOBEX, at
from tallywork.operators import ingest, ratelimit
from tallywork.plans import ingestion
from tallywork.sources import catalogs
from tallywork.sources.sightings import SightingStore
from test_ingest import brute_bucket

REQUEST = "request_id string, event_id long, api_key string, idempotency_key string, meter_code string, quantity long, dimensions map<string,string>, occurred_at timestamp, received_at timestamp"


@pytest.fixture(scope="module")
def keys(spark):
    return catalogs.api_keys(spark, {ACME: ["acme-1"], GLOBEX: ["globex-1"]})


@pytest.fixture
def store(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "shared"))
    return SightingStore(spark, str(tmp_path / "store"), buckets=4, blocks=8)


def table(spark, rows):
    out = [(f"r{i:05d}", i, key, name, "llm.requests", 1, None, at(s), at(s)) for i, (key, name, s) in enumerate(rows)]
    return spark.createDataFrame(out, REQUEST)


def answers(outcomes):
    return {r.event_id: (r.outcome, r.reject_reason) for r in outcomes.select("event_id", "outcome", "reject_reason").collect()}


def test_runs_decide_like_one(spark, store, keys, meters):
    rng = random.Random(5)
    hour = 3600
    rows = sorted(
        ((rng.choice(["acme-1", "globex-1", "nobody"]), f"k{rng.randrange(60)}", rng.randrange(4 * 24 * hour)) for _ in range(500)),
        key=lambda r: r[2],
    )
    every = table(spark, rows)
    bucket = ratelimit.Bucket(6, 6, "5 hours")
    want = answers(ingest.ingest(every, keys, meters, bucket, max_batch=1000).outcomes)
    got = {}
    for k, (a, b) in enumerate([(0, 30), (30, 31), (31, 95), (95, 97)]):
        part = every.filter((F.col("received_at") >= F.lit(at(a * hour))) & (F.col("received_at") < F.lit(at(b * hour))))
        first = answers(ingestion.ingest_run(store, part, keys, meters, k, bucket).outcomes)
        assert answers(ingestion.ingest_run(store, part, keys, meters, k, bucket).outcomes) == first
        got.update(first)
    assert got == want
    assert {o for o, _ in want.values()} == {"accepted", "deduplicated", "rejected"}
    assert ("rejected", "rate_limited") in want.values()
    with pytest.raises(ValueError, match="other events"):
        ingestion.ingest_run(store, every, keys, meters, 2, bucket)


def test_failed_and_empty_runs_leave_nothing(spark, store, keys, meters, monkeypatch):
    part = table(spark, [("acme-1", "a", 0), ("acme-1", "b", 1)])
    monkeypatch.setattr(store.tables, "commit", lambda *_, **__: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        ingestion.ingest_run(store, part, keys, meters, 1)
    monkeypatch.undo()
    assert {o for o, _ in answers(ingestion.ingest_run(store, part, keys, meters, 1).outcomes).values()} == {"accepted"}
    assert ingestion.ingest_run(store, part.limit(0), keys, meters, 2).outcomes.isEmpty()
    again = ingestion.ingest_run(store, table(spark, [("acme-1", "a", 60), ("globex-1", "a", 60)]), keys, meters, 3)
    assert sorted(o for o, _ in answers(again.outcomes).values()) == ["accepted", "deduplicated"]


def test_filters_skip_keys_and_buckets(spark, store):
    seen = spark.range(2000).select(
        F.lit("t").alias("tenant_id"), F.concat(F.lit("old"), "id").alias("idempotency_key"),
        F.lit(BASE).alias("received_at"), F.col("id").alias("event_id"),
    )
    attempt = store.tables.begin()
    store.record(seen, attempt)
    new = spark.range(4000).select(F.lit("t").alias("tenant_id"), F.concat(F.lit("new"), "id").alias("idempotency_key"))
    since = F.lit(BASE) - F.expr("interval 1 day")
    assert store.possible(seen, since).isEmpty()  # not committed
    store.tables.commit("ingesting", 1, attempt)
    assert store.possible(seen, since).count() == 2000
    assert store.possible(new, since).count() < 80
    assert store.possible(seen, since + F.expr("interval 3 days")).isEmpty()
    one = store.earlier(seen.where("event_id = 7").union(seen.where("event_id = 7")), since)
    assert [(r.idempotency_key, r.tie) for r in one.collect()] == [("old7", "7")]
    plan = store.earlier(seen.where("event_id = 7"), since)._jdf.queryExecution().executedPlan().toString()
    pruned = [line for line in plan.splitlines() if "PartitionFilters" in line and "of_buckets" in line]
    filters = pruned[0].split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert all(f"{c}#" in filters for c in ("day", "bucket", "of_buckets"))
    wider = SightingStore(spark, store.tables.root, buckets=5, blocks=16)
    assert wider.earlier(seen, since).count() == 2000


@pytest.mark.parametrize("fan_in,chunk_slots", [(2, 1), (3, 2), (64, 1)])
def test_level_functions_compose_up_a_tree(spark, tmp_path, monkeypatch, fan_in, chunk_slots):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    monkeypatch.setattr(ratelimit, "FAN_IN", fan_in)
    rng = random.Random(fan_in)
    bucket = ratelimit.Bucket(7, 5, "1 second")
    rows = []
    for tenant, n in [("hot", 1200), ("a", 200), ("b", 1)]:
        us = 0
        for i in range(n):
            us += int(rng.expovariate(1 / 250_000)) if i % 300 else 9_000_000
            rows.append((tenant, f"r{i:05d}", us, rng.choice([1, 1, 2, 5, 7, 8])))
    want = brute_bucket(rows, bucket)
    df = spark.createDataFrame(rows, "tenant_id string, request_id string, us bigint, tokens bigint").select(
        "tenant_id", "request_id", F.timestamp_micros("us").alias("received_at"), "tokens"
    )
    got, opening = {}, None
    for low, high in [(0, 90), (90, 95), (95, 10_000)]:
        part = df.where((F.unix_micros("received_at") >= low * 10**6) & (F.unix_micros("received_at") < high * 10**6))
        decided, opening = ratelimit.decide_run(part, bucket, chunk_slots, opening)
        got.update({(r.tenant_id, r.request_id): r.granted for r in decided.collect()})
        opening = opening.checkpoint()
    assert got == want and len(set(want.values())) == 2


def test_composition_is_one_after_the_other():
    rng = random.Random(1)
    bucket = ratelimit.Bucket(9, 4, "3 microseconds")
    for _ in range(200):
        parts = []
        for _ in range(2):
            pieces = [[0, bucket.full, 1, 0]]
            for _ in range(rng.randint(1, 6)):
                pieces = ratelimit._spend_pieces(pieces, rng.randint(1, 10) * bucket.unit)
                pieces = ratelimit._refill_pieces(pieces, rng.randint(0, 20), bucket.full)
            parts.append(pieces)
        gain = rng.randint(0, 15)
        both = ratelimit._composed(*parts[:1], gain, parts[1], bucket.full)
        for x in range(bucket.full + 1):
            middle = min(bucket.full, ratelimit._apply_pieces(parts[0], x) + gain)
            assert ratelimit._apply_pieces(both, x) == ratelimit._apply_pieces(parts[1], middle)
