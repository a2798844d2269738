import json
import time
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import ACME, GLOBEX, at
from tallywork import schemas
from tallywork.operators import ledger
from tallywork.operators.ratelimit import Bucket
from tallywork.plans import standard
from tallywork.plans.billing import verify_store
from tallywork.sources import catalogs, streams, wire
from tallywork.sources.tables import TableStore
from tallywork.streaming import jobs, state

METER = "llm.tokens.input"


class Feed:
    """A folder read one file per micro-batch, in the order written."""

    def __init__(self, path):
        self.path = path
        path.mkdir()
        self.n = 0

    def add(self, *rows):
        self.n += 1
        file = self.path / f"f{self.n:03d}.json"
        file.write_text("\n".join(json.dumps(r) for r in rows))
        # The source orders files by modification time.
        stamp = time.time() - 1000 + self.n
        import os

        os.utime(file, (stamp, stamp))


def event(key, second, quantity, meter=METER, tenant=ACME):
    text = at(second).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"
    return {
        "schema_version": 1, "idempotency_key": key, "tenant_id": tenant, "meter_code": meter,
        "quantity": quantity, "dimensions": {"model": "m"}, "occurred_at": text, "received_at": text,
    }


def late_sequence(feed):
    feed.add(event("a", 10, 100), event("b", 20, 200), event("b", 21, 999))
    feed.add(event("c", 80, 1))
    feed.add(event("d", 50, 50))
    feed.add(event("e", 90, 1, "zzz"))
    feed.add(event("f", 91, 1, "zzz"))
    feed.add(event("g", 59, 7))


def run(writer):
    query = writer.start()
    query.processAllAvailable()
    progress = [json.loads(p.json) for p in query.recentProgress]
    query.stop()
    return progress


@pytest.fixture
def feed(tmp_path):
    return Feed(tmp_path / "in")


def source(spark, feed, schema=schemas.USAGE_EVENT):
    return streams.read_files(spark, str(feed.path), schema, files_per_trigger=1)


def test_late_events_final_windows_and_dedup(spark, feed, meters, tmp_path):
    late_sequence(feed)
    readings = jobs.metered(source(spark, feed), meters, dedup_ttl="24 hours")
    progress = run(
        readings.writeStream.format("memory").queryName("late").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "cp"))
    )
    rows = spark.sql("select * from late").collect()
    assert [(r.quantity, r.event_count) for r in rows] == [(350, 3)]
    dropped = sum(
        op.get("numRowsDroppedByWatermark", 0) for p in progress for op in p["stateOperators"]
    )
    assert dropped == 1


def test_restart_from_the_checkpoint_emits_each_window_once(spark, feed, meters, tmp_path):
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")

    def go():
        readings = jobs.metered(source(spark, feed), meters)
        streams.write_stream(readings, "parquet", cp, {"path": out}, True).start().awaitTermination()
        return spark.read.schema(readings.schema).parquet(out)

    feed.add(event("a", 10, 100))
    feed.add(event("b", 20, 200))
    go()
    feed.add(event("c", 95, 1))
    go()
    feed.add(event("d", 300, 1))
    rows = go()
    assert sorted(r.quantity for r in rows.collect()) == [1, 300]
    assert go().count() == 2


def test_dedup_flags_and_ttl(spark, feed, tmp_path):
    day = 86400
    feed.add(event("k", 0, 1), event("k", 10, 2))
    feed.add(event("k", day - 1, 3), event("k", 5, 4, tenant=GLOBEX))
    feed.add(event("k", day, 5), event("k", 2 * day - 1, 6))
    feed.add(event("x", 4 * day, 7))
    feed.add(event("k", 4 * day + 1, 8))
    timed = source(spark, feed).withWatermark("occurred_at", "30 seconds")
    flagged = state.stream_duplicates(timed, tie="idempotency_key", keep_duplicates=True)
    run(
        flagged.writeStream.format("memory").queryName("flags").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "cp"))
    )
    got = {r.quantity: r.deduplicated for r in spark.sql("select * from flags").collect()}
    assert got == {1: False, 2: True, 3: True, 4: False, 5: False, 6: True, 7: False, 8: False}


class Handle:
    """State and timers of one group, in memory."""

    def __init__(self):
        self.held, self.timers = {}, set()

    def getMapState(self, name, key, value):
        return self

    def getValue(self, key):
        return self.held.get(key)

    def updateValue(self, key, value):
        self.held[key] = value

    def removeKey(self, key):
        del self.held[key]

    def iterator(self):
        return iter(list(self.held.items()))

    def listTimers(self):
        return iter(list(self.timers))

    def registerTimer(self, ms):
        self.timers.add(ms)


def test_one_call_decides_the_keys_of_a_group():
    """A call of Python a key took milliseconds; the group has one timer, which drops what has expired."""
    processor, handle = state.FirstSighting(1000_000, 0, "received_at", "event_id", True), Handle()
    processor.init(handle)

    def sight(*rows):
        columns = ["key_of", "received_at", "event_id"]
        frame = pd.DataFrame(rows, columns=columns).assign(group_of=0)
        frame["received_at"] = pd.to_datetime(frame["received_at"], unit="us")
        batches = [frame.iloc[k : k + 1000] for k in range(0, len(frame), 1000)]
        out = pd.concat(processor.handleInputRows((0,), iter(batches), None))
        assert not {"key_of", "group_of"} & set(out.columns)
        return dict(zip(out["event_id"], out["deduplicated"]))

    keys = 3000
    first = sight(*[(f"k{n}", n % 2, n) for n in range(keys)], ("k0", 500_000, keys), (None, 1, keys + 1), (None, 1, keys + 2))
    assert [n for n, repeat in first.items() if repeat] == [keys]
    assert len(handle.held) == keys and len(handle.timers) == 1
    assert sight(("k1", 1000_000, 1), ("k2", 1000_000, 2), ("new", 1000_000, 3)) == {1: True, 2: False, 3: False}
    timer = handle.timers.pop()
    at_ms = SimpleNamespace(getExpiryTimeInMs=lambda: timer, getCurrentWatermarkInMs=lambda: 1500)
    assert list(processor.handleExpiredTimer((0,), at_ms, at_ms)) == []
    # Accepted at 1 s: k2 and the new one; all others have expired.
    assert set(handle.held) == {("k2",), ("new",)}
    assert handle.timers == {2001}


@pytest.mark.parametrize("copies", [500, 30_000])
def test_dedup_order_does_not_depend_on_batches(spark, tmp_path, copies):
    """The earliest of one key's copies wins, also where they fill several Arrow batches."""
    folder = str(tmp_path / "in")
    base = int(at(0).timestamp())
    spark.range(copies).select(
        F.lit(ACME).alias("tenant_id"),
        F.lit("k").alias("idempotency_key"),
        F.col("id").alias("event_id"),
        F.timestamp_seconds(F.lit(base + copies) - F.col("id")).alias("received_at"),
    ).coalesce(1).write.parquet(folder)
    rows = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
    timed = rows.withWatermark("received_at", "10 minutes")
    for keep in (False, True):
        name = f"copies_{copies}_{keep}"
        run(
            state.stream_duplicates(timed, "received_at", keep_duplicates=keep)
            .writeStream.format("memory").queryName(name).outputMode("append")
            .option("checkpointLocation", str(tmp_path / name))
        )
        got = spark.table(name)
        assert got.count() == (copies if keep else 1)
        first = got.filter("not deduplicated") if keep else got
        assert [r.event_id for r in first.collect()] == [copies - 1]


def test_bucket_state_is_freed(spark, feed, tmp_path):
    from pyspark.sql.types import _parse_datatype_string

    schema = "tenant_id string, request_id string, received_at timestamp, tokens bigint"

    def ask(tenant, rid, second):
        stamp = at(second).strftime("%Y-%m-%dT%H:%M:%SZ")
        return {"tenant_id": tenant, "request_id": rid, "received_at": stamp, "tokens": 1}

    feed.add(ask("a", "1", 0))
    feed.add(ask("b", "2", 7200))
    feed.add(ask("b", "3", 7201))
    feed.add(ask("a", "4", 7202))
    requests = source(spark, feed, _parse_datatype_string(schema))
    progress = run(
        state.stream_rate_limit(requests, Bucket(1, 1, "1 minute"))
        .writeStream.format("memory").queryName("freed").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "cp"))
    )
    got = {r.request_id: r.granted for r in spark.table("freed").collect()}
    assert got == {"1": True, "2": True, "3": False, "4": True}
    removed = [op["numRowsRemoved"] for p in progress for op in p["stateOperators"]]
    assert sum(removed) >= 1


def test_token_bucket(spark, feed, tmp_path):
    schema = "tenant_id string, request_id string, received_at timestamp, tokens bigint"
    from pyspark.sql.types import _parse_datatype_string

    def ask(tenant, rid, second, tokens=1):
        return {
            "tenant_id": tenant, "request_id": rid, "tokens": tokens,
            "received_at": at(second).strftime("%Y-%m-%dT%H:%M:%SZ"),
        }

    feed.add(ask("a", "1", 0), ask("a", "2", 1), ask("a", "3", 2))
    feed.add(ask("b", "4", 2, 3), ask("a", "5", 31), ask("a", "6", 32))
    requests = source(spark, feed, _parse_datatype_string(schema))
    granted = state.stream_rate_limit(requests, Bucket(2, 2, "1 minute"))
    run(
        granted.writeStream.format("memory").queryName("bucket").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "cp"))
    )
    got = {r.request_id: r.granted for r in spark.sql("select * from bucket").collect()}
    assert got == {"1": True, "2": True, "3": False, "4": False, "5": True, "6": False}


def test_requests_are_admitted_or_refused(spark, feed, meters, tmp_path):
    keys = catalogs.api_keys(spark, {ACME: ["acme"]})

    def ask(event_id, key, api_key="acme", meter=METER, quantity=1, ahead=0):
        row = event(key, event_id + ahead, quantity, meter)
        row["received_at"] = event("", event_id, 0)["received_at"]
        return {**row, "event_id": event_id, "request_id": str(event_id), "api_key": api_key}

    feed.add(ask(1, "a"), ask(2, "a"), ask(3, "b", "nobody"), ask(4, "c", meter="unknown"))
    feed.add(ask(5, "a"), ask(9, "g", ahead=-90 * 86400), ask(6, "d", ahead=301), ask(7, "e", ahead=300), ask(8, "f", quantity=-1))
    requests = source(spark, feed, schemas.USAGE_REQUEST)

    def collect(rows, name):
        run(
            rows.writeStream.format("memory").queryName(name).outputMode("append")
            .option("checkpointLocation", str(tmp_path / name))
        )
        return spark.sql(f"select * from {name}")

    accepted = collect(jobs.admitted(requests, keys, meters), "admitted")
    assert accepted.columns == schemas.USAGE_EVENT.names
    assert sorted(r.idempotency_key for r in accepted.collect()) == ["a", "e", "g"]
    rejected = collect(jobs.refused(requests, keys, meters), "refused")
    assert {r.event_id: r.reject_reason for r in rejected.collect()} == {
        3: "unauthorized", 4: "invalid_event", 6: "invalid_event", 8: "validation_failed",
    }


def test_large_and_unpaid_requests_are_refused(spark, feed, meters, tmp_path):
    keys = catalogs.api_keys(spark, {ACME: ["acme"], GLOBEX: ["globex"]})

    def ask(event_id, request, second, api_key="acme", quantity=1):
        row = event(f"k{event_id}", second, quantity)
        return {**row, "event_id": event_id, "request_id": request, "api_key": api_key}

    feed.add(
        ask(1, "r1", 0), ask(2, "r1", 0), ask(3, "r1", 0),
        ask(4, "r1", 0, "globex"), ask(5, "r2", 1), ask(6, "r2", 1, quantity=-1),
    )
    feed.add(ask(7, "r3", 2), ask(8, "r3", 2), ask(9, "r4", 3), ask(10, "r5", 4))
    requests = source(spark, feed, schemas.USAGE_REQUEST)
    limits = {"bucket": Bucket(2, 2, "1 hour"), "max_batch": 2}

    def collect(rows, name):
        run(
            rows.writeStream.format("memory").queryName(name).outputMode("append")
            .option("checkpointLocation", str(tmp_path / name))
        )
        return spark.table(name).collect()

    accepted = collect(jobs.admitted(requests, keys, meters, **limits), "gate_admitted")
    # r1 of one tenant is too large and costs nothing; r2 pays for its sound event only, so r3
    # finds one token of the two it needs, r4 takes it, and r5 finds none.
    assert sorted(r.idempotency_key for r in accepted) == ["k4", "k5", "k9"]
    rejected = collect(jobs.refused(requests, keys, meters, **limits), "gate_refused")
    assert {r.event_id: r.reject_reason for r in rejected} == {
        1: "validation_failed", 2: "validation_failed", 3: "validation_failed",
        6: "validation_failed", 7: "rate_limited", 8: "rate_limited", 10: "rate_limited",
    }


def test_one_decision_for_all_sinks(spark, feed, meters, tmp_path):
    keys = catalogs.api_keys(spark, {ACME: ["acme"], GLOBEX: ["globex"]})

    def ask(event_id, request, second, key, api_key="acme", quantity=1):
        row = event(key, second, quantity)
        return {**row, "event_id": event_id, "request_id": request, "api_key": api_key}

    def gathered(*rows):
        feed.add(*rows)
        return len(rows)

    n = gathered(ask(1, "r1", 0, "a"), ask(2, "r2", 1, "a"), ask(3, "r3", 2, "b", "nobody"), ask(4, "r4", 3, "c", quantity=-1))
    n += gathered(ask(5, "r5", 4, "a"), ask(6, "r6", 5, "d"), ask(7, "r7", 6, "e"), ask(8, "r8", 6, "a", "globex"))
    requests = source(spark, feed, schemas.USAGE_REQUEST)
    rows = jobs.decided(requests, keys, meters, bucket=Bucket(4, 1, "1 day"))
    store = TableStore(spark, str(tmp_path / "admission"))
    sent = []
    broken = [True]

    def send(name):
        def put(written, batch_id):
            found = [(batch_id, r.event_id) for r in written.collect()]
            if name == "rejected" and batch_id == 1 and broken:
                broken.clear()
                raise OSError("broker is away")
            sent.extend((name, *x) for x in found)

        return put

    def start():
        sinks = {name: send(name) for name in ("accepted", "rejected")}
        return jobs.fan_out(rows, store, str(tmp_path / "state"), sinks).start()

    query = start()
    with pytest.raises(Exception, match="broker is away"):
        query.processAllAvailable()
    # What the broken try wrote stays invisible.
    assert jobs.decided_rows(store, rows.schema).count() == 4
    query = start()
    query.processAllAvailable()
    query.stop()
    n += gathered(ask(9, "r9", 90_000, "a"), ask(10, "r10", 90_001, "d"))
    query = start()
    query.processAllAvailable()
    query.stop()
    got = {(r.event_id, r.outcome, r.reject_reason) for r in jobs.decided_rows(store, rows.schema).collect()}
    assert got == {
        (1, "accepted", None), (2, "deduplicated", None), (3, "rejected", "unauthorized"),
        (4, "rejected", "validation_failed"), (5, "deduplicated", None), (6, "accepted", None),
        (7, "rejected", "rate_limited"), (8, "accepted", None), (9, "accepted", None), (10, "rejected", "rate_limited"),
    }
    assert len(got) == n == jobs.decided_rows(store, rows.schema).count()
    refused = jobs.decided_rows(store, rows.schema, "rejected")
    assert {r.event_id for r in refused.collect()} == {3, 4, 7, 10}
    # Sinks get every event at least once, and none of another outcome.
    assert {(name, e) for name, _, e in sent} == {(o, e) for e, o, _ in got if o != "deduplicated"}


def test_events_to_ledger(spark, feed, meters, tenant_plan, models, tmp_path):
    store = TableStore(spark, str(tmp_path / "ledger"))
    tenants = catalogs.tenants(spark, standard.TENANT_NAMES, standard.TENANT_PLANS)
    attempt = store.begin()
    store.write("tenant", tenants.withColumn("created_at", F.current_timestamp()), attempt)
    store.commit("loading", 0, attempt)
    feed.add(event("a", 10, 1_500_000), event("b", 11, 5000, tenant=GLOBEX))
    feed.add(event("c", 200, 1, "zzz"))
    feed.add(event("d", 201, 1, "zzz"))
    # Events travel as topic records: typed rows to JSON text and back.
    records = wire.encode(source(spark, feed), schemas.USAGE_EVENT)
    typed, _ = jobs.usage_events(records)
    charges = jobs.rated(jobs.metered(typed, meters), tenant_plan, models)
    run(jobs.post_charges(charges, store, str(tmp_path / "cp")))
    found = {r.tenant_id: r.amount_minor for r in store.read("billed_charge").collect()}
    assert found == {ACME: 40_000, GLOBEX: 125}
    assert verify_store(store).filter("not all_match").isEmpty()
    assert ledger.trial_balance(store.read("ledger_entry")).filter("total_minor <> 0").isEmpty()


def test_outbox_relay_sends_each_row_once(spark, tmp_path):
    schema = schemas.OUTBOX
    folder = tmp_path / "outbox"
    folder.mkdir()
    out, cp = str(tmp_path / "sent"), str(tmp_path / "cp")

    def add(name, *ids):
        rows = [{"id": i, "tenant_id": ACME, "aggregate_id": f"inv-{i}", "payload": "{}"} for i in ids]
        (folder / name).write_text("\n".join(json.dumps(r) for r in rows))

    def go():
        rows = jobs.relay_outbox(streams.read_files(spark, str(folder), schema))
        streams.write_stream(rows, "json", cp, {"path": out}, True).start().awaitTermination()
        return sorted(r.key for r in spark.read.json(out).collect())

    add("a.json", "1", "2")
    assert go() == ["inv-1", "inv-2"]
    add("b.json", "3")
    assert go() == ["inv-1", "inv-2", "inv-3"]
