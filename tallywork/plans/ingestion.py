"""Ingestion runs that follow each other: sightings and bucket levels of one are known to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywork.functions.windows import micros
from tallywork.operators import dedup, ingest
from tallywork.operators.ratelimit import Bucket
from tallywork.session import staged
from tallywork.sources.sightings import SightingStore

INGESTING = "ingesting"


def content_of(requests: DataFrame) -> str:
    """What identifies the events of a run: their number and a sum of hashes of their ids and keys."""
    of_row = F.xxhash64("request_id", "event_id", "api_key", "idempotency_key", "received_at")
    row = requests.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(of_row.cast("decimal(38,0)")), F.lit(0)).alias("h")
    ).first()
    return f"{row.n}:{row.h}"


def ingest_run(
    store: SightingStore,
    requests: DataFrame,
    keys: DataFrame,
    catalog: DataFrame,
    batch_id: int,
    bucket: Bucket = Bucket(),
    ttl: str = ingest.DEDUP_TTL,
    max_batch: int = ingest.MAX_BATCH,
    max_folded: int = dedup.MAX_FOLDED,
    writer: str = INGESTING,
) -> ingest.Ingested:
    """Decide a run of requests that arrived after those of the runs before, as one run over all would.

    Batch size and rate limit are always on. Keys accepted by an earlier run are duplicates within the TTL, and
    every tenant's bucket goes on from the level the last run left. Outcomes, accepted sightings, their
    filters and the levels are written under one attempt and become visible with its commit. A number
    that comes again with the same events answers from what was written; with others it is refused.
    An empty run leaves sightings and levels as they were.
    """
    tables = store.tables
    requests = staged(requests)
    content = content_of(requests)
    folder = f"{tables.root}/outcome"
    done = tables.committed(writer, batch_id)
    if done is not None:
        if done.content != content:
            raise ValueError(f"batch {batch_id} of {writer} was ingested with other events")
        return ingest.Ingested(store.spark.read.parquet(f"{folder}/attempt={done.attempt}"))
    attempt = tables.begin()
    last = store.last_attempt(writer)
    opening = store.levels(last) if last else None
    rows, left = ingest.gated(requests, keys, catalog, bucket, max_batch, opening, keep=True)
    rows = staged(rows)
    first = rows.agg(F.min(F.unix_micros("received_at")).alias("us")).first().us
    earlier = None
    if last and first is not None:
        since = F.timestamp_micros(F.lit(first - micros(ttl)))
        earlier = store.earlier(rows.filter(F.col("reject_reason").isNull()), since)
    outcomes = ingest.decided(rows, ttl, max_folded, earlier)
    outcomes.write.parquet(f"{folder}/attempt={attempt}")
    written = store.spark.read.schema(outcomes.schema).parquet(f"{folder}/attempt={attempt}")
    store.record(written.filter(F.col("outcome") == ingest.ACCEPTED), attempt)
    tables.write("bucket_level", left, attempt)
    tables.commit(writer, batch_id, attempt, content=content)
    return ingest.Ingested(written)
