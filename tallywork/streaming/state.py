"""Stateful stream steps: 24-hour deduplication and the token bucket.

State is one short record per key and is dropped by an event-time timer, so it
is bounded by the keys seen within the TTL (or refill time). Deduplication deals keys
over groups by hash and keeps a map in each, because a call of Python per key costs some
milliseconds whatever the key holds. The rows of one group in one micro-batch arrive as
Arrow batches cut anywhere, in no order. They are put in arrival order before any is
decided, so a task holds the rows of one group in one micro-batch; the source's rate
options bound them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallywork.functions.windows import micros
from tallywork.operators.ingest import MAX_BATCH, MAX_FUTURE_SKEW, RATE_LIMITED, VALIDATION_FAILED
from tallywork.operators.ratelimit import Bucket

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _us(values: pd.Series) -> list[int]:
    return values.astype("datetime64[us]").astype("int64").tolist()


def _replace_timer(handle: StatefulProcessorHandle, us: int) -> None:
    """Leave the key with one timer, at the first millisecond after ``us``."""
    for timer in handle.listTimers():
        handle.deleteTimer(timer)
    handle.registerTimer(us // 1000 + 1)


GROUPS = 1 << 10  # groups that keys are dealt over
SWEEPS = 24  # a group drops what has expired at most so often per TTL


class FirstSighting(StatefulProcessor):
    """Pass or flag the sightings of the (tenant, key) pairs of one group.

    The TTL is decided on arrival times. The timer only frees the state, and runs
    on event time, which may be ahead of arrival by the allowed skew; the state
    is therefore kept that much longer, and up to a sweep more.
    """

    def __init__(self, ttl_us: int, slack_us: int, at: str, tie: str, keep_duplicates: bool):
        self.ttl_us = ttl_us
        self.kept_us = ttl_us + slack_us
        self.at = at
        self.tie = tie
        self.keep_duplicates = keep_duplicates

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.accepted = handle.getMapState(
            "accepted_at",
            T.StructType([T.StructField("who", T.StringType())]),
            T.StructType([T.StructField("us", T.LongType())]),
        )

    def handleInputRows(
        self, key, rows: Iterator[pd.DataFrame], timerValues
    ) -> Iterator[pd.DataFrame]:
        held: dict[str, int | None] = {}
        undecided = []
        for batch in rows:
            if not len(batch):
                continue
            for who in batch["key_of"].dropna().unique():
                if who not in held:
                    found = self.accepted.getValue((who,))
                    held[who] = found[0] if found else None
            if not self.keep_duplicates:
                # Whatever the order, these repeat the sighting accepted before.
                opens = [None if (last := held.get(who)) is None else last + self.ttl_us for who in batch["key_of"]]
                batch = batch[[at is None or now >= at for now, at in zip(_us(batch[self.at]), opens)]]
            if len(batch):
                undecided.append(batch)
        if not undecided:
            return
        ordered = pd.concat(undecided, ignore_index=True).sort_values([self.at, self.tie])
        last = dict(held)
        repeats = []
        for who, now in zip(ordered["key_of"], _us(ordered[self.at])):
            if not isinstance(who, str):  # takes no part
                repeats.append(False)
                continue
            before = last[who]
            repeat = before is not None and now < before + self.ttl_us
            if not repeat:
                last[who] = now
            repeats.append(repeat)
        flagged = ordered.drop(columns=["key_of", "group_of"]).assign(deduplicated=repeats)
        if not self.keep_duplicates:
            flagged = flagged[~flagged["deduplicated"]].drop(columns="deduplicated")
        if len(flagged):
            yield flagged
        fresh = {who: us for who, us in last.items() if us != held[who]}
        for who, us in fresh.items():
            self.accepted.updateValue((who,), (us,))
        if fresh and not any(True for _ in self.handle.listTimers()):
            self.handle.registerTimer((min(fresh.values()) + self.kept_us) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        now = max(now, timerValues.getCurrentWatermarkInMs())
        expired, next_ms = [], None
        for (who,), (us,) in self.accepted.iterator():
            ends = (us + self.kept_us) // 1000 + 1
            if ends <= now:
                expired.append(who)
            else:
                next_ms = ends if next_ms is None else min(next_ms, ends)
        for who in expired:
            self.accepted.removeKey((who,))
        if next_ms is not None:
            self.handle.registerTimer(max(next_ms, now + self.ttl_us // 1000 // SWEEPS + 1))
        return iter(())

    def close(self) -> None:
        pass


def _who() -> Column:
    """Names a (tenant, key) pair; a missing part is not an empty one."""
    tenant, key = F.col("tenant_id"), F.col("idempotency_key")
    size = F.coalesce(F.length(tenant), F.lit(-1)).cast("string")
    return F.concat(size, F.lit(":"), F.coalesce(tenant, F.lit("")), F.coalesce(F.concat(F.lit(":"), key), F.lit("")))


def stream_duplicates(
    events: DataFrame,
    event_time: str = "occurred_at",
    ttl: str = "24 hours",
    at: str = "received_at",
    tie: str = "event_id",
    keep_duplicates: bool = False,
    among: Column | None = None,
    groups: int = GROUPS,
) -> DataFrame:
    """Deduplicate a stream that carries a watermark on ``event_time``.

    Without ``keep_duplicates`` the output is the accepted events, and a window
    aggregation may follow. The TTL is independent of the watermark delay. Rows outside
    ``among`` are passed on as no duplicates and leave no state; they are dealt over the
    groups by ``tie``, so that one key a third of all events share doesn't fill a group.
    ``groups`` is part of the state: a stream keeps the number it began with.
    """
    schema = T.StructType(list(events.schema.fields))
    if keep_duplicates:
        schema = schema.add("deduplicated", T.BooleanType())
    takes_part = F.lit(True) if among is None else F.coalesce(among, F.lit(False))
    # The names can't begin with an underscore: the rows reach Python as named tuples.
    keyed = events.withColumn("key_of", F.when(takes_part, _who()))
    dealt = F.when(takes_part, F.xxhash64("key_of")).otherwise(F.xxhash64(tie))
    keyed = keyed.withColumn("group_of", F.pmod(dealt, F.lit(groups)))
    return keyed.groupBy("group_of").transformWithStateInPandas(
        statefulProcessor=FirstSighting(
            micros(ttl), micros(MAX_FUTURE_SKEW), at, tie, keep_duplicates
        ),
        outputStructType=schema,
        outputMode="Append",
        timeMode="eventTime",
        eventTimeColumnName="" if keep_duplicates else event_time,
    )


class TokenBucket(StatefulProcessor):
    """Grant or refuse the requests of one tenant.

    A bucket that has had time to fill is like one never used, so the timer that
    frees its state is set to that moment.
    """

    def __init__(self, bucket: Bucket):
        self.bucket = bucket

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.level = handle.getValueState(
            "level",
            T.StructType([T.StructField("level", T.LongType()), T.StructField("us", T.LongType())]),
        )

    def decide(self, requests: pd.DataFrame) -> pd.DataFrame:
        """Add ``granted`` to all requests of a micro-batch, in the order of their arrival."""
        ordered = requests.sort_values(["received_at", "request_id"])
        held = self.level.get()
        level, last = held if held else (self.bucket.full, None)
        granted = []
        for now, tokens in zip(_us(ordered["received_at"]), ordered["tokens"].tolist()):
            if last is not None and now > last:
                level = self.bucket.refilled(level, now - last)
            last = now if last is None else max(last, now)
            ok = level >= tokens * self.bucket.unit
            if ok:
                level -= tokens * self.bucket.unit
            granted.append(ok)
        if last is not None:
            self.level.update((level, last))
            _replace_timer(self.handle, last - (level - self.bucket.full) // self.bucket.refill)
        return ordered.assign(granted=granted)

    def handleInputRows(
        self, key, rows: Iterator[pd.DataFrame], timerValues
    ) -> Iterator[pd.DataFrame]:
        yield self.decide(pd.concat(list(rows), ignore_index=True))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.level.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_rate_limit(
    requests: DataFrame, bucket: Bucket, disorder: str = "10 minutes"
) -> DataFrame:
    """Add ``granted`` to a stream of requests (tenant_id, request_id, received_at, tokens).

    Requests of one micro-batch are decided in the order of their arrival times,
    ties by id. ``disorder`` is how far arrival times may be out of order.
    """
    schema = T.StructType([*requests.schema.fields, T.StructField("granted", T.BooleanType())])
    timed = requests.withWatermark("received_at", disorder)
    return timed.groupBy("tenant_id").transformWithStateInPandas(
        statefulProcessor=TokenBucket(bucket),
        outputStructType=schema,
        outputMode="Append",
        timeMode="eventTime",
        eventTimeColumnName="received_at",
    )


class RequestGate(TokenBucket):
    """Refuse the events of a tenant's requests that are too large or find no tokens."""

    def __init__(self, bucket: Bucket, max_batch: int):
        super().__init__(bucket)
        self.max_batch = max_batch

    def handleInputRows(
        self, key, rows: Iterator[pd.DataFrame], timerValues
    ) -> Iterator[pd.DataFrame]:
        # Only what the decision needs is put together; the batches go on as they came.
        batches = [batch for batch in rows if len(batch)]
        if not batches:
            return
        slim = ["request_id", "received_at", "static_reason"]
        events = pd.concat([batch[slim] for batch in batches], ignore_index=True)
        size = events.groupby("request_id", dropna=False)["request_id"].transform("size")
        oversized = size > self.max_batch
        payers = events[events["static_reason"].isna() & ~oversized]
        asked = payers.groupby("request_id", dropna=False)["received_at"].agg(["max", "size"])
        requests = asked.reset_index().rename(columns={"max": "received_at", "size": "tokens"})
        decided = self.decide(requests) if len(requests) else requests.assign(granted=True)
        refused = decided.loc[~decided["granted"].astype(bool), "request_id"]
        reason = pd.Series(None, index=events.index, dtype=object)
        reason[events["request_id"].isin(refused)] = RATE_LIMITED
        reason[oversized] = VALIDATION_FAILED
        done = 0
        for batch in batches:
            yield batch.assign(gate_reason=reason.to_numpy()[done : done + len(batch)])
            done += len(batch)


def stream_gate(
    events: DataFrame, bucket: Bucket = Bucket(), max_batch: int = MAX_BATCH
) -> DataFrame:
    """Add ``gate_reason`` to a stream of validated events: batch size, then rate limit.

    As in the batch job, every event of a request counts for its size, and those
    without a ``static_reason`` cost a token each. The stream carries a watermark
    on ``received_at``; the events of a request come in one micro-batch.
    """
    schema = T.StructType([*events.schema.fields, T.StructField("gate_reason", T.StringType())])
    return events.groupBy("tenant_id").transformWithStateInPandas(
        statefulProcessor=RequestGate(bucket, max_batch),
        outputStructType=schema,
        outputMode="Append",
        timeMode="eventTime",
        eventTimeColumnName="received_at",
    )


def stream_decisions(
    events: DataFrame, ttl: str = "24 hours", at: str = "received_at", tie: str = "event_id"
) -> DataFrame:
    """Add ``deduplicated`` to a stream of events with a ``reject_reason``; refused ones are no duplicates."""
    clean = F.col("reject_reason").isNull()
    return stream_duplicates(events, at, ttl, at, tie, keep_duplicates=True, among=clean)
