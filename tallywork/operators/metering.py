"""Metering: usage events to one reading per tenant, meter, dimensions and window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywork import schemas
from tallywork.functions.keys import entries_key, sorted_entries
from tallywork.functions.windows import epoch_slot, in_window, micros
from tallywork.operators.running import running_max

GROUP = ["tenant_id", "meter_code", "entries", "window"]
WINDOW_SIZE = "1 minute"
GRACE = "30 seconds"


def keyed_events(
    events: DataFrame, window: str = WINDOW_SIZE, event_time: str = "occurred_at"
) -> DataFrame:
    """Add the sorted dimension entries and the tumbling window of each event."""
    return events.withColumn("entries", sorted_entries(F.col("dimensions"))).withColumn(
        "window", F.window(event_time, window)
    )


def meter(
    events: DataFrame,
    catalog: DataFrame,
    window: str = WINDOW_SIZE,
    event_time: str = "occurred_at",
) -> DataFrame:
    """Fold events into readings.

    Groups on columns, not on a joined text that could collide. Spark combines
    before the shuffle, so a dominant tenant or group costs one partial row per
    task. All three aggregates are kept and the meter's own is picked after the
    shuffle, when the catalog joins to far fewer rows.

    On a stream, give ``events`` a watermark first; append mode then emits each
    window once, when it can no longer change.
    """
    keyed = keyed_events(events, window, event_time)
    folded = keyed.groupBy(*GROUP).agg(
        F.try_sum("quantity").alias("total"),
        F.max("quantity").alias("peak"),
        F.count(F.lit(1)).alias("event_count"),
    )
    return to_readings(folded.join(catalog, "meter_code", "left"))


def _measured() -> Column:
    total = F.coalesce(
        F.col("total"), F.raise_error(F.lit("meter total exceeds a bigint")).cast("bigint")
    )
    return (
        F.when(F.col("aggregation") == "COUNT", F.col("event_count"))
        .when(F.col("aggregation") == "MAX", F.col("peak"))
        .otherwise(total)
    )


def to_readings(folded: DataFrame) -> DataFrame:
    """Pick each meter's aggregate and project to the reading contract."""
    return folded.select(
        F.lit(schemas.SCHEMA_VERSION).alias("schema_version"),
        "tenant_id",
        "meter_code",
        "window",
        _measured().alias("quantity"),
        "event_count",
        F.map_from_entries("entries").alias("dimensions"),
    )


def reading_violations(readings: DataFrame) -> DataFrame:
    """Readings that break the contract: negative quantity or count, or an empty window."""
    return readings.filter(
        (F.col("quantity") < 0)
        | (F.col("event_count") < 0)
        | (F.col("window.end") <= F.col("window.start"))
    )


def dimension_keys(rows: DataFrame) -> DataFrame:
    """Add the canonical dimension text of each row."""
    return rows.withColumn("dimension_key", entries_key(sorted_entries(F.col("dimensions"))))


def classify_lateness(
    events: DataFrame,
    window: str = WINDOW_SIZE,
    grace: str = GRACE,
    event_time: str = "occurred_at",
    arrival: tuple[str, str] = ("received_at", "event_id"),
    chunk: str = "1 minute",
) -> DataFrame:
    """What a stream would have done with each archived event of a tenant.

    Replays the events in arrival order. An event is ``dropped`` if its window
    had closed, grace included, by the latest event time seen so far; ``late`` if
    the window had ended but not closed; otherwise ``on_time``.
    """
    windowed = events.withColumn("window", F.window(event_time, window)).withColumn(
        "_chunk", epoch_slot(F.col(arrival[0]), micros(chunk))
    )
    seen = running_max(windowed, ["tenant_id"], "_chunk", list(arrival), event_time, "stream_time")
    end_us = F.unix_micros("window.end")
    now_us = F.unix_micros("stream_time")
    status = (
        F.when(end_us + F.lit(micros(grace)) <= now_us, "dropped")
        .when(end_us <= now_us, "late")
        .otherwise("on_time")
    )
    return seen.withColumn("lateness", status).drop("_chunk")


def events_of_readings(
    events: DataFrame,
    readings: DataFrame,
    window: str = WINDOW_SIZE,
    event_time: str = "occurred_at",
) -> DataFrame:
    """Pair every event with the reading that contains it.

    The interval condition comes with equal keys, the window start among them,
    so it stays a hash or merge join. AQE splits the event side of a dominant
    reading, which is a single row on the other side.
    """
    keyed = keyed_events(events, window, event_time).withColumn(
        "window_start", F.col("window.start")
    ).drop("window", "dimensions")
    targets = readings.select(
        "tenant_id",
        "meter_code",
        sorted_entries(F.col("dimensions")).alias("entries"),
        F.col("window.start").alias("window_start"),
        "window",
        F.col("quantity").alias("reading_quantity"),
    )
    return keyed.join(targets, ["tenant_id", "meter_code", "entries", "window_start"]).filter(
        in_window(F.col(event_time), F.col("window"))
    )
