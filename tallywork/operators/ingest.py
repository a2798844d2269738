"""Ingestion: tenant lookup, validation, rate limit, deduplication, outcomes.

The steps run in the order of the contract: tenant, static validation, rate
limit, business validation, deduplication. Each adds to ``reject_reason`` of the
rows that are still clean, so one row has one outcome.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywork import schemas
from tallywork.functions.keys import canonical_dimensions
from tallywork.functions.windows import micros
from tallywork.operators import dedup, ratelimit

# Reject reasons, outcomes and the limits of the contract.
UNAUTHORIZED = "unauthorized"
VALIDATION_FAILED = "validation_failed"
RATE_LIMITED = "rate_limited"
INVALID_EVENT = "invalid_event"
ACCEPTED, DEDUPLICATED, REJECTED = "accepted", "deduplicated", "rejected"
MAX_BATCH = 1000
MAX_FUTURE_SKEW = "5 minutes"
DEDUP_TTL = "24 hours"


@dataclass(frozen=True)
class Ingested:
    """The outputs of :func:`ingest`, all views on one set of decided rows.

    A job that needs more than one of them should write ``outcomes`` once and read
    the others from that table.
    """

    outcomes: DataFrame

    @property
    def accepted(self) -> DataFrame:
        return stamp(self.outcomes.filter(F.col("outcome") == ACCEPTED))

    @property
    def quarantine(self) -> DataFrame:
        return self.outcomes.filter(F.col("outcome") == REJECTED)


def resolve_tenants(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """API key to tenant; an unknown or missing key leaves the tenant null."""
    hashed = requests.withColumn("api_key_hash", F.sha2(F.col("api_key").cast("binary"), 256))
    return hashed.join(keys, "api_key_hash", "left").drop("api_key_hash", "api_key")


def static_problem() -> Column:
    """Reason a request is malformed on its own, or null."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    wrong = (
        blank(F.col("idempotency_key"))
        | blank(F.col("meter_code"))
        | F.coalesce(F.col("quantity") < 0, F.lit(True))
        | F.col("occurred_at").isNull()
    )
    return F.when(wrong, VALIDATION_FAILED)


def requester(rows: DataFrame) -> list[str]:
    """What tells requests apart: the id and who sent it, as other tenants may use the same id."""
    return ["request_id", *[c for c in ("tenant_id", "api_key") if c in rows.columns][:1]]


def oversized_batches(requests: DataFrame, limit: int = MAX_BATCH) -> DataFrame:
    """Requests that carry more events than allowed, with their sender and size."""
    return (
        requests.groupBy(*requester(requests))
        .agg(F.count(F.lit(1)).alias("batch_size"))
        .filter(F.col("batch_size") > limit)
    )


def refuse_oversized(rows: DataFrame, limit: int = MAX_BATCH) -> DataFrame:
    """Give every event of an oversized request a ``static_reason``, as it is refused whole.

    For flat rows. Requests that still hold their events as an array are checked
    without a shuffle by :func:`explode_batches`.
    """
    keys = requester(rows)
    refused = oversized_batches(rows, limit).select(
        *[F.col(k).alias(f"_{k}") for k in keys], F.lit(True).alias("_refused")
    )
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    reason = F.when(F.col("_refused"), VALIDATION_FAILED)
    return (
        rows.join(refused, same, "left")
        .withColumn("static_reason", F.coalesce("static_reason", reason))
        .select(*rows.columns)
    )


def explode_batches(batches: DataFrame, limit: int = MAX_BATCH) -> tuple[DataFrame, DataFrame]:
    """Batch requests with an ``events`` array to one row per event, and the refused batches."""
    size = F.coalesce(F.size("events"), F.lit(0))
    fits = size.between(1, limit)
    good = batches.filter(fits).withColumn("event", F.explode("events"))
    keep = [c for c in batches.columns if c != "events"]
    refused = batches.filter(~fits).select(*keep, F.lit(VALIDATION_FAILED).alias("reject_reason"))
    return good.select(*keep, "event.*"), refused


def known_meters(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows whose meter is in the catalog."""
    return requests.join(catalog.select("meter_code"), "meter_code", "left_semi")


def unknown_meters(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows whose meter is not in the catalog."""
    return requests.join(catalog.select("meter_code"), "meter_code", "left_anti")


def too_far_ahead(skew: str = MAX_FUTURE_SKEW) -> Column:
    """True if the event claims to have occurred later than arrival plus the allowed skew.

    The arrival time stands for "now", so a replay decides the same way.
    """
    ahead = F.unix_micros("occurred_at") - F.unix_micros("received_at")
    return ahead > F.lit(micros(skew))


def stamp(events: DataFrame) -> DataFrame:
    """Project to the usage event contract."""
    return events.select(
        F.lit(schemas.SCHEMA_VERSION).alias("schema_version"),
        "idempotency_key",
        "tenant_id",
        "meter_code",
        "quantity",
        canonical_dimensions(F.col("dimensions")).alias("dimensions"),
        "occurred_at",
        "received_at",
    )


def validate(requests: DataFrame, keys: DataFrame, catalog: DataFrame) -> DataFrame:
    """Resolve tenants and add ``reject_reason`` of the checks that need no state.

    Only map-side work while the key and meter tables are small enough for a
    broadcast join.
    """
    resolved = resolve_tenants(requests, keys)
    meters = catalog.select("meter_code", F.lit(True).alias("_known"))
    known = F.coalesce(F.col("_known"), F.lit(False))
    static = F.when(F.col("tenant_id").isNull(), UNAUTHORIZED).otherwise(static_problem())
    business = F.when(~known | too_far_ahead(), INVALID_EVENT)
    return (
        resolved.join(meters, "meter_code", "left")
        .withColumn("static_reason", static)
        .withColumn("business_reason", business)
        .drop("_known")
    )


def rate_limited(
    rows: DataFrame, bucket: ratelimit.Bucket, opening: DataFrame | None = None, keep: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Add ``granted``: whether the request of the event got its tokens; and the levels left behind, if kept.

    Tokens are charged before business validation and deduplication, so events
    those steps throw out have been paid for.
    """
    decided, left = ratelimit.decide_run(ratelimit.requests_of(rows), bucket, opening=opening, keep=keep)
    refused = decided.filter(~F.col("granted")).select("tenant_id", "request_id", "granted")
    granted = rows.join(refused, ["tenant_id", "request_id"], "left").withColumn(
        "granted", F.coalesce("granted", F.lit(True))
    )
    return granted, left


def gated(
    requests: DataFrame,
    keys: DataFrame,
    catalog: DataFrame,
    bucket: ratelimit.Bucket | None = None,
    max_batch: int | None = None,
    opening: DataFrame | None = None,
    keep: bool = False,
) -> tuple[DataFrame, DataFrame | None]:
    """Events with the ``reject_reason`` of all checks but deduplication, and the bucket levels they leave."""
    rows, left = validate(requests, keys, catalog), None
    if max_batch is not None:
        rows = refuse_oversized(rows, max_batch)
    if bucket is None:
        limited = F.lit(None).cast("string")
    else:
        payers = rows.filter(F.col("static_reason").isNull())
        paid, left = rate_limited(payers, bucket, opening, keep)
        rows = paid.unionByName(
            rows.filter(F.col("static_reason").isNotNull()).withColumn("granted", F.lit(True))
        )
        limited = F.when(~F.col("granted"), RATE_LIMITED)
    rows = rows.withColumn(
        "reject_reason", F.coalesce("static_reason", limited, "business_reason")
    ).drop("static_reason", "business_reason", "granted")
    return rows, left


def decided(
    rows: DataFrame, ttl: str = DEDUP_TTL, max_folded: int = dedup.MAX_FOLDED, earlier: DataFrame | None = None
) -> DataFrame:
    """The ``outcome`` of every event of :func:`gated`; ``earlier`` sightings count."""
    clean = F.col("reject_reason").isNull()
    flagged = dedup.flag_duplicates(rows, ttl, max_folded=max_folded, among=clean, earlier=earlier)
    outcome = (
        F.when(F.col("reject_reason").isNotNull(), REJECTED)
        .when(F.col("deduplicated"), DEDUPLICATED)
        .otherwise(ACCEPTED)
    )
    return flagged.withColumn("outcome", outcome)


def ingest(
    requests: DataFrame,
    keys: DataFrame,
    catalog: DataFrame,
    bucket: ratelimit.Bucket | None = None,
    ttl: str = DEDUP_TTL,
    max_folded: int = dedup.MAX_FOLDED,
    max_batch: int | None = None,
) -> Ingested:
    """Decide every event of a batch of requests.

    ``bucket`` switches the rate limit on; it costs a second pass over the
    requests to find the slots in which a tenant asks for more than it may.
    ``max_batch`` refuses requests with more events than that, see
    :func:`refuse_oversized`. Nothing is known of earlier batches, see
    :func:`tallywork.plans.ingestion.ingest_run` for runs that follow each other.
    """
    rows, _ = gated(requests, keys, catalog, bucket, max_batch)
    return Ingested(decided(rows, ttl, max_folded))


def batch_responses(outcomes: DataFrame, with_results: bool = False) -> DataFrame:
    """Per request: received, accepted and deduplicated events.

    ``with_results`` adds the echo of every event; it is bounded because a
    request holds at most ``MAX_BATCH`` events.
    """
    repeat = F.col("outcome") == DEDUPLICATED
    aggregates = [
        F.count(F.lit(1)).alias("received"),
        F.count_if(~repeat).alias("accepted"),
        F.count_if(repeat).alias("deduplicated"),
    ]
    if with_results:
        aggregates.append(
            F.array_sort(
                F.collect_list(F.struct("event_id", "idempotency_key", repeat.alias("deduplicated")))
            ).alias("results")
        )
    answered = outcomes.filter(F.col("outcome") != REJECTED)
    return answered.groupBy("tenant_id", "request_id").agg(*aggregates)


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """Events per tenant and outcome."""
    return outcomes.groupBy("tenant_id", "outcome").agg(F.count(F.lit(1)).alias("events"))


def rejection_summary(outcomes: DataFrame) -> DataFrame:
    """Rejected events per tenant and reason."""
    return (
        outcomes.filter(F.col("reject_reason").isNotNull())
        .groupBy("tenant_id", "reject_reason")
        .agg(F.count(F.lit(1)).alias("events"))
    )
