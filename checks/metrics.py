"""Queries over operational metrics, the stream source and the end-to-end check."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import data
from checks.data import JANUARY
from checks.oracle import iso, sql
from checks.registry import ORACLE, query
from tallywork.operators import invoicing, ledger, metering, opsmetrics, posting, rating
from tallywork.plans.billing import book_of
from tallywork.session import checkpoint_dir, staged
from tallywork.sources import streams
from tallywork.sources.tables import TableStore
from tallywork.streaming import jobs
from tallywork.streaming.state import STATE_STORE

BOUNDS = (1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 400.0)


def _rate_sql(by: str, source: str, needs: tuple, ts: str = "ts", step: int = 15, span: int = 60):
    copies = span // step
    return sql(
        f"SELECT {by}, strftime(make_timestamp(e * {step * 1000000}), '%Y-%m-%dT%H:%M:%SZ') "
        f"AS window_end, count(*) AS events, count(*) / {span}.0::DOUBLE AS per_second FROM "
        f"(SELECT *, unnest(range(epoch_us({ts}) // {step * 1000000} + 1, "
        f"epoch_us({ts}) // {step * 1000000} + {copies + 1})) AS e FROM {source}) GROUP BY {by}, e",
        *needs,
    )


@query(_rate_sql("tenant_id, outcome", "outcomes", ("outcomes",), "received_at"))
def ingest_rate(spark, sf):
    outcomes = data.ingested(spark, sf).outcomes
    return opsmetrics.event_rate(outcomes, ["tenant_id", "outcome"], ts="received_at")


@query(_rate_sql("application", "req_log", ("req_log",)))
def request_rate(spark, sf):
    return opsmetrics.event_rate(data.request_log(spark, sf), ["application"])


@query(_rate_sql("application", "(SELECT * FROM req_log WHERE status = 429)", ("req_log",)))
def throttled_rate(spark, sf):
    throttled = data.request_log(spark, sf).filter(F.col("status") == 429)
    return opsmetrics.event_rate(throttled, ["application"])


def _bucket_sql() -> str:
    whens = " ".join(f"WHEN latency_ms <= {b} THEN {i}" for i, b in enumerate(BOUNDS))
    return f"CASE {whens} ELSE {len(BOUNDS)} END"


def _edge(expr: str) -> str:
    whens = " ".join(f"WHEN {i} THEN {b}::DOUBLE" for i, b in enumerate(BOUNDS))
    return f"CASE {expr} {whens} END"


def _quantile_sql() -> str:
    low = f"CASE WHEN bucket = 0 THEN 0.0::DOUBLE ELSE {_edge('bucket - 1')} END"
    picks = []
    for name, q in opsmetrics.QUANTILES.items():
        rank = f"{q}::DOUBLE * total"
        value = (
            f"CASE WHEN bucket = {len(BOUNDS)} THEN {BOUNDS[-1]}::DOUBLE ELSE {low} + "
            f"({_edge('bucket')} - {low}) * ({rank} - (upto - n)) / n END"
        )
        picks.append(f"round(max({value}) FILTER (upto >= {rank} AND upto - n < {rank}), 4) AS {name}")
    return sql(
        f", counted AS (SELECT application, epoch_us(ts) // 86400000000 AS slot, "
        f"{_bucket_sql()} AS bucket, count(*) AS n FROM req_log GROUP BY ALL), "
        "ranked AS (SELECT *, CAST(sum(n) OVER (PARTITION BY application, slot) AS BIGINT) AS total, "
        "CAST(sum(n) OVER (PARTITION BY application, slot ORDER BY bucket) AS BIGINT) AS upto "
        "FROM counted) "
        "SELECT application, strftime(make_timestamp(slot * 86400000000), '%Y-%m-%dT%H:%M:%SZ') "
        f"AS window_start, max(total) AS samples, {', '.join(picks)} FROM ranked "
        "GROUP BY application, slot",
        "req_log",
    )


@query(_quantile_sql())
def latency_quantiles(spark, sf):
    counted = opsmetrics.histogram(
        data.request_log(spark, sf), ["application"], "latency_ms", BOUNDS, "1 day"
    )
    found = opsmetrics.histogram_quantiles(counted, ["application"], BOUNDS, "1 day")
    return found.withColumns({q: F.round(q, 4) for q in opsmetrics.QUANTILES})


@query(
    _rate_sql(
        "tenant_id, outcome",
        "(SELECT tenant_id, window_end, outcome FROM charges, "
        "(VALUES ('POSTED'), ('DUPLICATE')) o(outcome))",
        ("charges",),
        "window_end",
    )
)
def posting_rate(spark, sf):
    charges = data.deliveries(spark, sf).select(
        "tenant_id",
        F.when(F.col("delivery") == 1, "POSTED").otherwise("DUPLICATE").alias("outcome"),
        F.col("window.end").alias("posted_at"),
    )
    return opsmetrics.event_rate(charges, ["tenant_id", "outcome"], ts="posted_at")


@query(
    sql(
        "SELECT count(*) AS total_posted, count(*) AS duplicates_avoided FROM charges", "charges"
    )
)
def posting_totals(spark, sf):
    none = data.charges(spark, sf).select("charge_id").filter(F.lit(False))
    return opsmetrics.outcome_totals(posting.post_outcomes(data.deliveries(spark, sf), none))


@query(
    sql(
        "SELECT application, client_id, CAST(sum(lag) AS BIGINT) AS lag FROM (SELECT application, "
        "client_id, topic_partition, arg_max(value, (ts, value)) AS lag FROM samples GROUP BY ALL) "
        "GROUP BY ALL",
        "samples",
    )
)
def consumer_lag(spark, sf):
    return opsmetrics.consumer_lag(
        data.metric_samples(spark, sf),
        ["application", "client_id", "topic_partition"],
        ["application", "client_id"],
    )


def _counter_sql(by: str, where: str = "") -> str:
    keys = f"{by}, slot" if by else "slot"
    shown = f"{by}, " if by else ""
    return sql(
        ", stepped AS (SELECT *, lag(value) OVER (PARTITION BY application, client_id, "
        "topic_partition ORDER BY ts, sample_id) AS before_value FROM samples) "
        f"SELECT {shown}strftime(make_timestamp(slot * 3600000000), '%Y-%m-%dT%H:%M:%SZ') "
        "AS window_start, CAST(sum(CASE WHEN value >= before_value THEN value - before_value "
        "ELSE value END) AS BIGINT) AS increase, round(sum(CASE WHEN value >= before_value THEN "
        "value - before_value ELSE value END) / 3600.0::DOUBLE, 6) AS per_second FROM "
        f"(SELECT *, epoch_us(ts) // 3600000000 AS slot FROM stepped) "
        f"WHERE before_value IS NOT NULL {where} GROUP BY {keys}",
        "samples",
    )


SERIES = ["application", "client_id", "topic_partition"]


@query(_counter_sql("application"))
def consumed_rate(spark, sf):
    rate = opsmetrics.counter_rate(
        data.metric_samples(spark, sf), SERIES, ["application"], "1 hour", chunk="1 day"
    )
    return rate.withColumn("per_second", F.round("per_second", 6))


@query(_counter_sql("", "AND application = 'purchase'"))
def produced_rate(spark, sf):
    produced = data.metric_samples(spark, sf).filter(F.col("application") == "purchase")
    rate = opsmetrics.counter_rate(produced, SERIES, [], "1 hour", chunk="1 day")
    return rate.withColumn("per_second", F.round("per_second", 6))


_SUMMARY = (
    "SELECT gateway, target_rate, count(*) AS requests, round(count(*) / ((epoch_us(max(ts)) - "
    "epoch_us(min(ts))) / 1000000.0::DOUBLE), 9) AS throughput, "
    "round(quantile_cont(latency_ms, 0.5), 4) AS p50, round(quantile_cont(latency_ms, 0.95), 4) "
    "AS p95, round(quantile_cont(latency_ms, 0.99), 4) AS p99, max(latency_ms) AS max_ms, "
    "round(count(*) FILTER (status >= 400) / count(*)::DOUBLE, 9) AS error_rate FROM req_log "
    "GROUP BY ALL"
)


def _rounded(df):
    return df.withColumns(
        {
            **{q: F.round(q, 4) for q in opsmetrics.QUANTILES},
            "throughput": F.round("throughput", 9),
            "error_rate": F.round("error_rate", 9),
        }
    )


@query(sql(_SUMMARY, "req_log"))
def load_summary(spark, sf):
    return _rounded(opsmetrics.load_summary(data.request_log(spark, sf)))


@query(
    sql(
        f"SELECT gateway, target_rate, error_rate < 0.05 AS errors_ok, p99 < 2000 AS latency_ok, "
        f"error_rate < 0.05 AND p99 < 2000 AS passed FROM ({_SUMMARY})",
        "req_log",
    )
)
def service_objectives(spark, sf):
    found = opsmetrics.objectives(opsmetrics.load_summary(data.request_log(spark, sf)))
    return found.select("gateway", "target_rate", "errors_ok", "latency_ok", "passed")


@query(
    sql(
        "SELECT (SELECT count(*) FROM outcomes WHERE outcome = 'deduplicated') > 0 AS "
        "duplicates_seen, (SELECT bool_and(t = 0) FROM (SELECT sum(CASE WHEN direction = 'DEBIT' "
        "THEN amount_minor ELSE -amount_minor END) AS t FROM lines_acc GROUP BY tenant_id)) "
        "AS ledger_balanced, (SELECT bool_and(net > 0) FROM (SELECT t.tenant_id, "
        "coalesce(sum(c.amount_minor), 0) AS net FROM plans t LEFT JOIN charges_acc c "
        "ON c.tenant_id = t.tenant_id AND c.window_start >= TIMESTAMP '2024-01-01' "
        "AND c.window_start < TIMESTAMP '2024-02-01' GROUP BY ALL)) AS invoices_positive, "
        "true AS passed",
        "outcomes",
        "lines_acc",
        "charges_acc",
        "plans",
    )
)
def acceptance(spark, sf):
    decided = data.ingested(spark, sf)
    readings = metering.meter(decided.accepted, data.meters(spark), "1 day")
    book = book_of(rating.rate(readings, data.tenant_plan(spark), data.models(spark)))
    tenants = data.tenant_plan(spark).withColumnRenamed("tenant_id", "id")
    verified = ledger.verify(
        tenants,
        ledger.balances(book.balance, book.accounts),
        ledger.recomputed_balances(book.entries, book.accounts),
    )
    lines = invoicing.invoice_lines(invoicing.in_period(book.billed, JANUARY))
    due = invoicing.due_invoices(tenants, [JANUARY])
    return opsmetrics.acceptance(decided.outcomes, verified, invoicing.invoices(lines, due))


@query(
    sql(
        f"SELECT 1 AS schema_version, tenant_id, meter_code, dimension_key, {iso('window_start')} "
        f"AS window_start, {iso('window_end')} AS window_end, quantity, event_count "
        "FROM readings_min WHERE window_end <= (SELECT max(occurred_at) FROM clean) "
        "- INTERVAL 30 SECOND",
        "readings_min",
        "clean",
    )
)
def stream_readings(spark, sf):
    """The event file as a stream: windows still open at its end stay unemitted."""
    root = f"{checkpoint_dir(spark)}/stream-readings-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    # A glob, because a stream source takes a plain path for a folder.
    raw = streams.read_files(spark, f"{sf}/events.parquet*", schema, "parquet")
    events = data.clean_of(data.requests_of(raw), spark)
    readings = jobs.metered(events, data.meters(spark))
    writer = streams.write_stream(
        readings, "parquet", f"{root}/checkpoint", {"path": f"{root}/out"}, available_now=True
    )
    writer.start().awaitTermination()
    return spark.read.schema(readings.schema).parquet(f"{root}/out")


MICRO_BATCH = 4_000_000  # events


@query(ORACLE["event_outcomes"])
def stream_outcomes(spark, sf):
    """Requests as a stream in order of arrival, decided once, over a restart, for all sinks."""
    root = f"{checkpoint_dir(spark)}/stream-outcomes-{uuid.uuid4().hex}"
    asked = staged(data.requests(spark, sf))
    us = F.unix_micros("received_at")
    low, high, events = asked.agg(F.min(us), F.max(us), F.count(us)).first()
    # A task holds a tenant's events of one micro-batch, so their number doesn't grow with the table.
    parts = max(2, -(-events // MICRO_BATCH))
    edges = [low + (high + 1 - low) * k // parts for k in range(parts + 1)]
    store = TableStore(spark, f"{root}/out")
    state_store = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    try:
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            # The stream goes on from its checkpoint for the parts after the first.
            asked.filter((us >= a) & (us < b)).write.parquet(f"{root}/in/part={k}")
            raw = streams.read_files(spark, f"{root}/in/part=*", asked.schema, "parquet")
            rows = jobs.decided(raw, data.keys(spark), data.meters(spark))
            jobs.fan_out(rows, store, f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", state_store)
    found = jobs.decided_rows(store, rows.schema)
    return found.select("event_id", "tenant_id", "outcome", "reject_reason")
