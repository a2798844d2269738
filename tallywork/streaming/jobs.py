"""Streaming jobs built from the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from tallywork import schemas
from tallywork.operators import ingest, metering, outbox, posting, rating
from tallywork.operators.ratelimit import Bucket
from tallywork.plans.billing import post_batch
from tallywork.session import checkpoint_dir
from tallywork.sources import wire
from tallywork.sources.tables import TableStore
from tallywork.streaming.state import stream_decisions, stream_duplicates, stream_gate


def usage_events(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw topic records to typed usage events and a quarantine of malformed ones."""
    return wire.decode(raw, schemas.USAGE_EVENT)


def gated(
    requests: DataFrame,
    keys: DataFrame,
    meters: DataFrame,
    disorder: str = "10 minutes",
    bucket: Bucket = Bucket(),
    max_batch: int = ingest.MAX_BATCH,
) -> DataFrame:
    """Requests of known tenants with the reasons for which a check refuses them, if any."""
    checked = ingest.validate(requests, keys, meters).filter(F.col("tenant_id").isNotNull())
    return stream_gate(checked.withWatermark("received_at", disorder), bucket, max_batch)


REASONS = ["static_reason", "gate_reason", "business_reason"]


def admitted(
    requests: DataFrame,
    keys: DataFrame,
    meters: DataFrame,
    disorder: str = "10 minutes",
    ttl: str = ingest.DEDUP_TTL,
    bucket: Bucket = Bucket(),
    max_batch: int = ingest.MAX_BATCH,
) -> DataFrame:
    """Accepted usage events of a stream of requests, ready for the topic.

    The checks are those of the batch job: tenant, validation, batch size, rate
    limit, deduplication. The watermark follows arrival, not occurrence, so an event
    that occurred long ago is still admitted; ``disorder`` is how far arrival times
    may be out of order between partitions of the source.
    """
    checked = gated(requests, keys, meters, disorder, bucket, max_batch)
    clean = checked.filter(F.coalesce(*REASONS).isNull()).drop(*REASONS)
    return ingest.stamp(stream_duplicates(clean, "received_at", ttl))


def refused(
    requests: DataFrame,
    keys: DataFrame,
    meters: DataFrame,
    disorder: str = "10 minutes",
    bucket: Bucket = Bucket(),
    max_batch: int = ingest.MAX_BATCH,
) -> DataFrame:
    """The rest of such a stream: requests that fail a check, with the reason."""
    nobody = ingest.validate(requests, keys, meters).filter(F.col("tenant_id").isNull())
    unknown = nobody.withColumn("gate_reason", F.lit(None).cast("string"))
    return (
        gated(requests, keys, meters, disorder, bucket, max_batch)
        .unionByName(unknown)
        .withColumn("reject_reason", F.coalesce(*REASONS))
        .filter(F.col("reject_reason").isNotNull())
        .drop(*REASONS)
    )


def decided(
    requests: DataFrame,
    keys: DataFrame,
    meters: DataFrame,
    disorder: str = "10 minutes",
    ttl: str = ingest.DEDUP_TTL,
    bucket: Bucket = Bucket(),
    max_batch: int = ingest.MAX_BATCH,
) -> DataFrame:
    """Every event of a stream of requests with its ``reject_reason`` and ``outcome``, decided once.

    One pass and one state for all outcomes, so that no event can be in two of them or in none;
    :func:`fan_out` writes them to their sinks. Events later than ``disorder`` are in none.
    """
    nobody = ingest.validate(requests, keys, meters).filter(F.col("tenant_id").isNull())
    unknown = nobody.withColumn("gate_reason", F.lit(None).cast("string")).withWatermark("received_at", disorder)
    rows = gated(requests, keys, meters, disorder, bucket, max_batch).unionByName(unknown)
    rows = rows.withColumn("reject_reason", F.coalesce(*REASONS)).drop(*REASONS)
    outcome = (
        F.when(F.col("reject_reason").isNotNull(), ingest.REJECTED)
        .when(F.col("deduplicated"), ingest.DEDUPLICATED)
        .otherwise(ingest.ACCEPTED)
    )
    return stream_decisions(rows, ttl).withColumn("outcome", outcome)


DECIDED = "decided"


def fan_out(
    rows: DataFrame,
    store: TableStore,
    checkpoint: str,
    sinks: dict[str, Callable[[DataFrame, int], None]] | None = None,
) -> DataStreamWriter:
    """Write decided events by outcome, each micro-batch under one attempt that its commit makes visible.

    ``sinks`` are called per outcome with the written rows and the number of the micro-batch before the
    commit. A micro-batch that comes again after its commit does nothing, one that failed before is
    written under a new attempt: readers of :func:`decided_rows` see each event once, sinks at least once.
    """
    writer = f"stream:{checkpoint}"

    def put(batch: DataFrame, batch_id: int) -> None:
        if store.committed(writer, batch_id) is not None:
            return
        attempt = store.begin()
        folder = f"{store.root}/{DECIDED}/attempt={attempt}"
        batch.write.partitionBy("outcome").parquet(folder)
        written = store.spark.read.schema(batch.schema).parquet(folder)
        for outcome, send in (sinks or {}).items():
            send(written.filter(F.col("outcome") == outcome), batch_id)
        store.commit(writer, batch_id, attempt)

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def decided_rows(store: TableStore, schema: T.StructType, outcome: str | None = None) -> DataFrame:
    """Events of the committed micro-batches; an ``outcome`` reads its folders only."""
    full = T.StructType([*schema.fields, T.StructField("attempt", T.StringType())])
    rows = store.spark.read.schema(full).option("basePath", f"{store.root}/{DECIDED}").parquet(f"{store.root}/{DECIDED}")
    if outcome is not None:
        rows = rows.filter(F.col("outcome") == outcome)
    return rows.join(store.commits().select("attempt"), "attempt", "left_semi").drop("attempt")


def metered(
    events: DataFrame,
    meters: DataFrame,
    window: str = metering.WINDOW_SIZE,
    grace: str = metering.GRACE,
    event_time: str = "occurred_at",
    dedup_ttl: str | None = None,
    tie: str = "idempotency_key",
) -> DataFrame:
    """Final readings of a stream of events.

    Late events are folded in until the window's end plus the grace, and dropped
    after that. Run it in append mode: each window is emitted once.
    """
    timed = events.withWatermark(event_time, grace)
    if dedup_ttl:
        timed = stream_duplicates(timed, event_time, dedup_ttl, tie=tie)
    return metering.meter(timed, meters, window, event_time)


def rated(readings: DataFrame, tenant_plan: DataFrame, models: DataFrame) -> DataFrame:
    """Charges of a stream of readings; the catalogs are static tables."""
    return rating.rate(readings, tenant_plan, models)


def to_topic(rows: DataFrame, schema, key: str = "tenant_id") -> DataFrame:
    """Rows as keyed JSON records for a topic sink."""
    return wire.encode(rows, schema, key)


def post_charges(
    charges: DataFrame, store: TableStore, checkpoint: str, order: str | None = None
) -> DataStreamWriter:
    """Post a stream of charges to the ledger, one ledger batch per micro-batch.

    Delivery to ``foreachBatch`` is at least once; posting is idempotent by batch
    and by charge id, so the ledger sees each charge once. The stream's checkpoint
    names the writer, so streams don't share batch numbers. ``order`` is the column by which
    copies were delivered, such as the topic's offset; without one, the order of
    rows in the micro-batch stands for it.
    """

    checkpoint_dir(store.spark)

    def post(batch: DataFrame, batch_id: int) -> None:
        # Posting reads the batch more than once; the checkpoint runs its plan, and
        # the state operators in it, only once.
        came = F.col(order) if order else F.monotonically_increasing_id()
        ordered = batch.withColumn("delivery", came).checkpoint()
        if not ordered.isEmpty():
            post_batch(store, ordered, batch_id, "delivery", writer=f"stream:{checkpoint}")

    return charges.writeStream.foreachBatch(post).option("checkpointLocation", checkpoint)


def outcome_stream(outcomes: DataFrame) -> DataFrame:
    """Deliveries per tenant and outcome, from the outcome of each charge id."""
    return posting.outcome_counts(outcomes)


def relay_outbox(rows: DataFrame) -> DataFrame:
    """Outbox rows as messages; the sink's checkpoint stands for the published log."""
    return outbox.messages(rows)
