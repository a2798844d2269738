"""Queries that go through a stored ledger: posting runs, invoice runs with late charges, relay runs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import data
from checks.ledger import ACCOUNT, SIGNED
from checks.oracle import gst, sql, uuid3
from checks.ingestion import RATE
from checks.registry import ORACLE, query
from tallywork.operators import ingest, ledger, ratelimit
from tallywork.plans.billing import invoice_run, post_batch, relay_run, snapshot
from tallywork.plans.ingestion import ingest_run
from tallywork.session import checkpoint_dir, staged
from tallywork.sources.sightings import SightingStore
from tallywork.sources.tables import TableStore

PERIOD = "2024-01"


def _store(spark) -> TableStore:
    store = TableStore(spark, f"{checkpoint_dir(spark)}/ledger-{uuid.uuid4().hex}")
    attempt = store.begin()
    store.write("tenant", data.tenants(spark).withColumn("created_at", F.current_timestamp()), attempt)
    store.commit("loading", 1, attempt)
    return store


def _posted(spark, sf, between=lambda store: None) -> TableStore:
    """A ledger after two batches, the second with all charges again; every batch is tried twice."""
    store = _store(spark)
    every = staged(data.deliveries(spark, sf))
    early = every.filter("charge_id < '8'")
    post_batch(store, early, 1, "delivery")
    between(store)
    for _ in range(2):
        post_batch(store, early, 1, "delivery")
        post_batch(store, every, 2, "delivery")
    return store


def _invoiced(spark, sf, relay=lambda store, run: None) -> TableStore:
    """The period is invoiced before and after the late charges came; each run is tried twice."""

    def invoice(store: TableStore, run: int) -> None:
        for _ in range(2):
            invoice_run(store, PERIOD, run)
        relay(store, run)

    store = _posted(spark, sf, lambda s: invoice(s, 1))
    invoice(store, 2)
    return store


def _run(run: int) -> str:
    late = ">= '8'" if run == 2 else "< '8'"
    invoice = uuid3(f"t.id || '|{PERIOD}|{run}'")
    return (
        f"SELECT {invoice} AS id, t.id AS tenant_id, coalesce(CAST(sum(c.amount_minor) AS BIGINT), 0) AS net_minor "
        f"FROM tenants t LEFT JOIN charges c ON c.tenant_id = t.id AND c.charge_id {late} GROUP BY ALL"
    )


RUNS = f"({_run(1)} UNION ALL {_run(2)})"


@query(
    sql(
        f"SELECT id, tenant_id, {gst('net_minor')} AS tax_minor, net_minor + {gst('net_minor')} AS total_minor FROM {RUNS}",
        "tenants",
        "charges",
    )
)
def stored_invoices(spark, sf):
    return _invoiced(spark, sf).read("invoice").select("id", "tenant_id", "tax_minor", "total_minor")


@query(sql(f"SELECT id AS invoice_id, CAST(1 AS BIGINT) AS sent FROM {RUNS}", "tenants", "charges"))
def stored_relay(spark, sf):
    folder = f"{checkpoint_dir(spark)}/sent-{uuid.uuid4().hex}"

    def relay(store: TableStore, run: int) -> None:
        for _ in range(2):
            relay_run(store, lambda rows: rows.write.mode("append").parquet(folder), run, limit=3)

    _invoiced(spark, sf, relay)
    sent = spark.read.parquet(folder)
    return sent.groupBy(F.col("key").alias("invoice_id")).agg(F.count(F.lit(1)).alias("sent"))


@query(
    sql(
        f"SELECT tenant_id, {ACCOUNT} AS account_id, account_type AS type, 'AUD' AS currency, "
        f"{SIGNED} AS balance_minor FROM lines GROUP BY ALL",
        "lines",
    )
)
def stored_balances(spark, sf):
    store = _posted(spark, sf)
    return ledger.balances(snapshot(store, store.last_posted()), store.read("ledger_account"))


def _by_arrival(rows, runs: int) -> list:
    """The rows as so many runs that follow each other in time of arrival."""
    us = F.unix_micros("received_at")
    low, high = rows.agg(F.min(us), F.max(us)).first()
    edges = [low + (high - low + 1) * k // runs for k in range(runs + 1)]
    return [rows.filter((us >= a) & (us < b)) for a, b in zip(edges, edges[1:])]


@query(ORACLE["event_outcomes"])
def stored_ingest_outcomes(spark, sf):
    """Two runs that know each other's sightings decide like one run over all requests."""
    store = SightingStore(spark, f"{checkpoint_dir(spark)}/sightings-{uuid.uuid4().hex}", buckets=1, blocks=16)
    found = None
    for k, part in enumerate(_by_arrival(staged(data.requests(spark, sf)), 2)):
        rows = ingest_run(store, part, data.keys(spark), data.meters(spark), k).outcomes
        rows = rows.select("event_id", "tenant_id", "outcome", "reject_reason")
        found = rows if found is None else found.unionByName(rows)
    return found


@query(ORACLE["rate_limit"])
def stored_rate_limit(spark, sf):
    """Three runs that hand over each bucket's level decide like one."""
    rows = ingest.resolve_tenants(data.requests(spark, sf), data.keys(spark))
    asked = staged(ratelimit.requests_of(rows.filter(F.col("tenant_id").isNotNull())))
    found, opening = None, None
    for part in _by_arrival(asked, 3):
        decided, left = ratelimit.decide_run(part, RATE, 4, opening)
        opening = staged(left)
        decided = decided.select("tenant_id", "request_id", "tokens", "granted")
        found = decided if found is None else found.unionByName(decided)
    return found
