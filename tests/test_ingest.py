import random
import time
from datetime import timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import ACME, GLOBEX, at
from tallywork import schemas
from tallywork.operators import dedup, ingest, ratelimit
from tallywork.sources import catalogs

KEYS = {ACME: ["acme-1", "acme-2"], GLOBEX: ["globex-1"]}
METER = "llm.tokens.input"


@pytest.fixture(scope="module")
def keys(spark):
    return catalogs.api_keys(spark, KEYS)


def request(event_id, key="k", api_key="acme-1", meter=METER, quantity=1, occurred=0, received=0, rid=None):
    return (
        rid or f"r{event_id}", event_id, api_key, key, meter, quantity, {},
        at(occurred) if occurred is not None else None, at(received),
    )


def decide(spark, keys, meters, *rows, **options):
    df = spark.createDataFrame(list(rows), schemas.USAGE_REQUEST)
    result = ingest.ingest(df, keys, meters, **options)
    return result, {
        r.event_id: (r.outcome, r.reject_reason)
        for r in result.outcomes.select("event_id", "outcome", "reject_reason").collect()
    }


def test_contract(spark, keys, meters):
    _, got = decide(
        spark, keys, meters,
        request(1, "a"),
        request(2, "a", received=1),
        request(3, "a", api_key="globex-1"),
        request(4, "b", meter="no.such.meter"),
        request(5, "c", occurred=360),
        request(6, "d", occurred=300),
        request(7, "e", quantity=-5),
        request(8, "f", api_key="nobody"),
        request(9, "g", api_key=None),
        request(10, " "),
        request(11, "h", occurred=None),
        request(12, "i", api_key="acme-2"),
    )
    assert got == {
        1: ("accepted", None),
        2: ("deduplicated", None),
        3: ("accepted", None),
        4: ("rejected", "invalid_event"),
        5: ("rejected", "invalid_event"),
        6: ("accepted", None),
        7: ("rejected", "validation_failed"),
        8: ("rejected", "unauthorized"),
        9: ("rejected", "unauthorized"),
        10: ("rejected", "validation_failed"),
        11: ("rejected", "validation_failed"),
        12: ("accepted", None),
    }


def test_accepted_events_are_stamped(spark, keys, meters):
    result, _ = decide(spark, keys, meters, request(1, "a"))
    row = result.accepted.first()
    assert result.accepted.columns == schemas.USAGE_EVENT.names
    assert (row.schema_version, row.tenant_id, row.dimensions) == (1, ACME, {})


def test_batch_response(spark, keys, meters):
    result, _ = decide(spark, keys, meters, request(1, "a", rid="r"), request(2, "b", rid="r"))
    row = ingest.batch_responses(result.outcomes, with_results=True).first()
    assert (row.received, row.accepted, row.deduplicated, len(row.results)) == (2, 2, 0, 2)


def test_oversized_request_is_refused_whole(spark, keys, meters):
    rows = [request(i, f"k{i}", rid="big") for i in range(3)] + [request(9, "k9", rid="small")]
    _, got = decide(spark, keys, meters, *rows, max_batch=2)
    assert got.pop(9) == ("accepted", None)
    assert set(got.values()) == {("rejected", "validation_failed")}


def test_explode_batches_checks_size(spark):
    rows = spark.createDataFrame(
        [("a", [(1,), (2,)]), ("b", []), ("c", [(i,) for i in range(4)]), ("d", None)],
        "request_id string, events array<struct<q:int>>",
    )
    good, refused = ingest.explode_batches(rows, limit=3)
    assert [r.q for r in good.orderBy("q").collect()] == [1, 2]
    assert {r.request_id for r in refused.collect()} == {"b", "c", "d"}


def test_rate_limit_in_ingest(spark, keys, meters):
    bucket = ratelimit.Bucket(2, 2, "1 minute")
    _, got = decide(
        spark, keys, meters,
        request(1, "a", received=0), request(2, "a", received=1), request(3, "b", received=2),
        request(4, "c", api_key="globex-1", received=2), request(5, "d", api_key="nobody"),
        bucket=bucket,
    )
    # The duplicate has spent a token, so the third request finds none.
    assert got[3] == ("rejected", "rate_limited")
    assert got[2] == ("deduplicated", None)
    assert got[4] == ("accepted", None)
    assert got[5] == ("rejected", "unauthorized")


def brute_dedup(rows, ttl):
    last, out = {}, {}
    for t, i, tenant, key in sorted(rows):
        k = (tenant, key)
        repeat = k in last and t < last[k] + ttl
        if not repeat:
            last[k] = t
        out[i] = repeat
    return out


@pytest.mark.parametrize(("max_folded", "max_giants"), [(1000, 9), (5, 10_000), (5, 4), (1, 1)])
def test_dedup_matches_brute_force(spark, max_folded, max_giants):
    rng = random.Random(3)
    rows = []
    for i in range(900):
        # One key holds a third of all rows.
        key = "hot" if i % 3 == 0 else f"k{rng.randrange(60)}"
        rows.append((at(rng.randrange(0, 5 * 86400)), i, rng.choice("ab"), key))
    df = spark.createDataFrame(
        [(t, i, tenant, key) for t, i, tenant, key in rows],
        "received_at timestamp, event_id bigint, tenant_id string, idempotency_key string",
    )
    got = {
        r.event_id: r.deduplicated
        for r in dedup.flag_duplicates(
            df, max_folded=max_folded, max_giants=max_giants
        ).collect()
    }
    assert got == brute_dedup(rows, timedelta(hours=24))


def test_dedup_passes_rows_that_do_not_take_part(spark):
    df = spark.createDataFrame(
        [(at(i), i, "t", "k", i % 2 == 0) for i in range(6)] + [(at(9), 9, None, None, False)],
        "received_at timestamp, event_id bigint, tenant_id string, idempotency_key string, ok boolean",
    )
    for max_folded in (1000, 1):
        rows = dedup.flag_duplicates(df, max_folded=max_folded, among=F.col("ok")).collect()
        got = {r.event_id: r.deduplicated for r in rows}
        assert got == {0: False, 1: False, 2: True, 3: False, 4: True, 5: False, 9: False}


def test_dedup_ttl_runs_from_the_accepted_sighting(spark):
    hours = [0, 23, 25, 47, 50]
    df = spark.createDataFrame(
        [(at(h * 3600), i, "t", "k") for i, h in enumerate(hours)],
        "received_at timestamp, event_id bigint, tenant_id string, idempotency_key string",
    )
    got = {r.event_id: r.deduplicated for r in dedup.flag_duplicates(df).collect()}
    assert got == {0: False, 1: True, 2: False, 3: True, 4: False}


def brute_bucket(rows, bucket):
    state, out = {}, {}
    for tenant, rid, us, tokens in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        level, last = state.get(tenant, (bucket.full, us))
        level = bucket.refilled(level, us - last)
        ok = level >= tokens * bucket.unit
        if ok:
            level -= tokens * bucket.unit
        state[tenant] = (level, us)
        out[tenant, rid] = ok
    return out


@pytest.mark.parametrize(
    ("capacity", "refill", "mean_gap_ms", "chunk_slots"),
    [(20, 20, 60, 1), (20, 20, 400, 2), (7, 3, 900, 4), (50, 13, 100, 64), (20, 20, 3000, 2)],
)
def test_rate_limit_matches_brute_force(spark, capacity, refill, mean_gap_ms, chunk_slots):
    rng = random.Random(capacity * 1000 + mean_gap_ms)
    bucket = ratelimit.Bucket(capacity, refill, "1 second")
    rows = []
    for tenant, n in [("hot", 1500), ("a", 300), ("b", 40)]:
        us = 0
        for i in range(n):
            us += int(rng.expovariate(1 / (mean_gap_ms * 1000)))
            rows.append((tenant, f"r{i:05d}", us, rng.choice([1, 1, 2, 5, capacity, capacity + 1])))
    df = spark.createDataFrame(
        rows, "tenant_id string, request_id string, us bigint, tokens bigint"
    ).select("tenant_id", "request_id", F.timestamp_micros("us").alias("received_at"), "tokens")
    want = brute_bucket(rows, bucket)
    got = {
        (r.tenant_id, r.request_id): r.granted
        for r in ratelimit.decide_requests(df, bucket, chunk_slots).collect()
    }
    assert got == want
    assert len(set(want.values())) == 2


@pytest.mark.parametrize("costs", [[1], list(range(1, 51))])
def test_long_overload_of_one_tenant(spark, costs):
    """Twice the refill for long: functions of a bounded number of pieces, same decisions."""
    rng = random.Random(5)
    bucket = ratelimit.Bucket()
    n = 256_000 if costs == [1] else 20_000
    gap = 1_000_000 * sum(costs) / len(costs) / (2 * bucket.refill)
    rows = [("hot", f"r{i:06d}", int(i * gap), rng.choice(costs)) for i in range(n)]
    frame = pd.DataFrame(rows, columns=["tenant_id", "request_id", "us", "tokens"])
    df = spark.createDataFrame(frame).select(
        "tenant_id", "request_id", F.timestamp_micros("us").alias("received_at"), "tokens"
    )
    start = time.monotonic()
    got = ratelimit.decide_requests(df, bucket).select("request_id", "granted").toPandas()
    assert time.monotonic() - start < 60
    want = {rid: ok for (_, rid), ok in brute_bucket(rows, bucket).items()}
    assert dict(zip(got["request_id"], got["granted"])) == want
    requests = pd.DataFrame(
        {"tenant_id": "hot", "chunk": 0, "at_us": frame["us"], "tokens": frame["tokens"]}
    )
    parts = pd.concat(ratelimit._chunk_functions(bucket)(iter([requests[:5000]])))
    # The request that ends a part may split every piece, by what it adds and by what it takes.
    assert parts["pieces"].map(len).max() <= 4 * ratelimit.MAX_PIECES


def test_quiet_tenants_are_not_simulated(spark):
    bucket = ratelimit.Bucket(10, 10, "1 second")
    rows = [("quiet", f"r{i}", i * 1_000_000, 3) for i in range(50)]
    rows += [("loud", f"r{i}", i * 1000, 3) for i in range(50)]
    df = spark.createDataFrame(
        rows, "tenant_id string, request_id string, us bigint, tokens bigint"
    ).select("tenant_id", "request_id", F.timestamp_micros("us").alias("received_at"), "tokens")
    slots = ratelimit.contested_slots(df, bucket)
    assert {r.tenant_id for r in slots.select("tenant_id").collect()} == {"loud"}


def test_requests_of_other_senders_may_share_an_id(spark):
    rows = spark.createDataFrame(
        [("r", "a", k, None) for k in range(3)] + [("r", "b", 9, None), ("r", None, 10, None)],
        "request_id string, tenant_id string, n int, static_reason string",
    )
    refused = ingest.refuse_oversized(rows, 2).filter("static_reason is not null")
    assert {(r.tenant_id, r.n) for r in refused.collect()} == {("a", 0), ("a", 1), ("a", 2)}
