"""The outbox: events written with the rows they announce, published later."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywork.functions.keys import natural_id
from tallywork.session import staged

# Relay batch size, aggregate and event type.
RELAY_BATCH = 100
AGGREGATE, EVENT = "invoice", "invoice.created"


def outbox_rows(events: DataFrame) -> DataFrame:
    """One outbox row per invoice event, with an id derived from the invoice."""
    return events.select(
        natural_id(F.lit(EVENT), F.col("invoice_id")).alias("id"),
        "tenant_id",
        F.lit(AGGREGATE).alias("aggregate_type"),
        F.col("invoice_id").alias("aggregate_id"),
        F.lit(EVENT).alias("event_type"),
        "payload",
    )


def pending(outbox: DataFrame, published: DataFrame, limit: int = RELAY_BATCH) -> DataFrame:
    """The oldest unpublished rows, at most one relay batch."""
    return (
        outbox.join(published.select("id"), "id", "left_anti")
        .orderBy("created_at", "id")
        .limit(limit)
    )


def queue(outbox: DataFrame, published: DataFrame) -> tuple[Callable[[int, int], DataFrame], int]:
    """All unpublished rows, oldest first: a function that gives those from one place to another, and their number.

    Sorted and written once. A row's place is its place in its part plus the rows of earlier parts, of
    which only the counts reach the driver; a stretch reads the files whose parts it touches.
    """
    waiting = outbox.join(published.select("id"), "id", "left_anti").orderBy("created_at", "id")
    in_part = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = staged(waiting.select("*", F.spark_partition_id().alias("_part"), in_part.alias("_place")))
    sizes = {r["_part"]: r.n for r in rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    begins, total = {}, 0
    for part in sorted(sizes):
        begins[part] = total
        total += sizes[part]

    def stretch(first: int, end: int) -> DataFrame:
        touched = [p for p in begins if begins[p] < end and begins[p] + sizes[p] > first]
        inside = F.lit(False)
        for p in touched:
            inside |= (F.col("_part") == p) & F.col("_place").between(first - begins[p], end - begins[p] - 1)
        return rows.where(inside).drop("_part", "_place")

    return stretch, total


def messages(rows: DataFrame) -> DataFrame:
    """Outbox rows as ``(key, value)``, keyed by the aggregate."""
    return rows.select(F.col("aggregate_id").alias("key"), F.col("payload").alias("value"))


def published_log(rows: DataFrame) -> DataFrame:
    """What to append to the published log once ``rows`` have been sent."""
    return rows.select("id", F.current_timestamp().alias("published_at"))
