"""Token bucket per tenant: greedy refill, all-or-nothing per request.

A refused request spends nothing, so what one request does to the bucket depends
on every request before it. Three steps keep that exact without handing a tenant
to one task:

1. Requests that cannot be refused are granted by aggregation alone. Cut time
   into slots in which the bucket refills completely. If no two neighbouring
   slots ask for more than the capacity, nothing in them is refused, and within
   two such slots the bucket has been full. Only slots around a heavier pair are
   simulated, starting two slots early, by when the bucket has been full.
2. Those requests are cut into time chunks. For each chunk one pass works out
   the level left behind as a function of the level found, without knowing it.
   A function grows by about one piece a request while the bucket is short; at 64
   pieces it is written out and the next one begun, so the work per request is bounded
   however long an overload lasts. Functions are composed up a tree of stretches
   of time, 64 to one, so no task holds a tenant; the level that a tenant starts with
   then goes down the tree to the chunks.
3. A second pass over the chunks, now with known levels, decides each request.

A run may start from the levels an earlier one has left, and leaves its own.

Levels are whole numbers of 1/period-microsecond tokens, so no rounding occurs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywork.functions.windows import epoch_slot, micros
from tallywork.session import staged

# A function is written out when it has so many pieces. Changes no decision.
MAX_PIECES = 64
FAN_IN = 64  # stretches of time that the next level of the tree joins

PIECES = "tenant_id string, chunk bigint, part bigint, first_us bigint, last_us bigint, pieces array<array<bigint>>"
LEVELS = "tenant_id string, chunk bigint, level bigint, last_us bigint"
DECISIONS = "tenant_id string, request_id string, granted boolean"


@dataclass(frozen=True)
class Bucket:
    """Capacity, and the tokens added per period."""

    capacity: int = 2000
    refill: int = 2000
    period: str = "1 second"

    @property
    def unit(self) -> int:
        """Level units per token."""
        return micros(self.period)

    @property
    def full(self) -> int:
        return self.capacity * self.unit

    @property
    def slot_us(self) -> int:
        """Time in which an empty bucket becomes full, rounded up."""
        return -(-self.full // self.refill)

    def refilled(self, level: int, elapsed_us: int) -> int:
        return min(self.full, level + elapsed_us * self.refill)


# A piece (lo, hi, slope, value) of a level function: a level x found between lo
# and hi leads to value + slope * (x - lo), with slope 0 or 1.
def _refill_pieces(pieces: list, gain: int, full: int) -> list:
    out: list = []
    for lo, hi, slope, value in pieces:
        value += gain
        if slope and value < full < value + hi - lo:
            edge = lo + full - value
            out.append([lo, edge, 1, value])
            lo, slope, value = edge + 1, 0, full
        elif value >= full:
            slope, value = 0, full
        if out and slope == 0 and out[-1][2] == 0 and out[-1][3] == value:
            out[-1][1] = hi
        else:
            out.append([lo, hi, slope, value])
    return out


def _spend_pieces(pieces: list, cost: int) -> list:
    out = []
    for lo, hi, slope, value in pieces:
        if value >= cost:
            out.append([lo, hi, slope, value - cost])
        elif slope and value + hi - lo >= cost:
            edge = lo + cost - value
            out.append([lo, edge - 1, 1, value])
            out.append([edge, hi, 1, 0])
        else:
            out.append([lo, hi, slope, value])
    return out


def _apply_pieces(pieces, level: int) -> int:
    for lo, hi, slope, value in pieces:
        if lo <= level <= hi:
            return int(value + slope * (level - lo))
    raise ValueError("level outside the bucket")


def _chunk_functions(bucket: Bucket):
    """Per part of a chunk: the level left behind as a function of the level found."""
    columns = ["tenant_id", "chunk", "part", "first_us", "last_us", "pieces"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current = None
        pieces: list = []
        part = first = last = 0
        for batch in batches:
            done = []
            for tenant, chunk, at, tokens in zip(
                batch["tenant_id"], batch["chunk"], batch["at_us"], batch["tokens"]
            ):
                if (tenant, chunk) != current:
                    if current is not None:
                        done.append((*current, part, first, last, pieces))
                    current, part, first, last = (tenant, chunk), 0, at, at
                    pieces = [[0, bucket.full, 1, 0]]
                elif len(pieces) >= MAX_PIECES:
                    done.append((*current, part, first, last, pieces))
                    part, first, last = part + 1, at, at
                    pieces = [[0, bucket.full, 1, 0]]
                elif at > last:
                    pieces = _refill_pieces(pieces, (at - last) * bucket.refill, bucket.full)
                    last = at
                pieces = _spend_pieces(pieces, tokens * bucket.unit)
            if done:
                yield pd.DataFrame(done, columns=columns)
        if current is not None:
            yield pd.DataFrame([(*current, part, first, last, pieces)], columns=columns)

    return run


def _composed(first: list, gain: int, second: list, full: int) -> list:
    """``second`` after ``first``, with ``gain`` refilled in between."""
    out: list = []
    for lo, hi, slope, value in _refill_pieces(first, gain, full):
        if not slope:
            then = [[lo, hi, 0, _apply_pieces(second, value)]]
        else:
            top = value + hi - lo
            then = []
            for a, b, s, v in second:
                x, y = max(a, value), min(b, top)
                if x <= y:
                    then.append([lo + x - value, lo + y - value, s, v + s * (x - a)])
        for piece in then:
            last = out[-1] if out else None
            if last and last[2] == piece[2] and piece[3] == last[3] + last[2] * (piece[0] - last[0]):
                last[1] = piece[1]
            else:
                out.append(piece)
    return out


def _combine(bucket: Bucket):
    """Functions of stretches, sorted in time within a group, composed as long as few pieces result."""
    columns = ["tenant_id", "chunk", "part", "first_us", "last_us", "pieces"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, pieces, part, first, last = None, [], 0, 0, 0
        for batch in batches:
            done = []
            names = ("tenant_id", "above", "first_us", "last_us", "pieces")
            for tenant, above, begin, end, more in zip(*(batch[c] for c in names)):
                more = [[int(x) for x in p] for p in more]
                if (tenant, above) != current:
                    if current is not None:
                        done.append((*current, part, first, last, pieces))
                    current, part, first, last, pieces = (tenant, above), 0, begin, end, more
                    continue
                both = _composed(pieces, (begin - last) * bucket.refill, more, bucket.full)
                if len(both) > MAX_PIECES:
                    done.append((*current, part, first, last, pieces))
                    part, first, pieces = part + 1, begin, more
                else:
                    pieces = both
                last = end
            if done:
                yield pd.DataFrame(done, columns=columns)
        if current is not None:
            yield pd.DataFrame([(*current, part, first, last, pieces)], columns=columns)

    return run


def _chain(bucket: Bucket):
    """Level found by the first request of each stretch of a group, whose first row carries the group's.

    The last row of a group gives the level behind it, with its time.
    """
    columns = ["tenant_id", "chunk", "level", "last_us"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        level, last, group = 0, None, None
        for batch in batches:
            found = []
            names = ("tenant_id", "above", "chunk", "part", "first_us", "last_us", "pieces", "level")
            for tenant, above, chunk, part, begin, end, pieces, opening in zip(*(batch[c] for c in names)):
                if part < 0:
                    if group is not None:
                        found.append((*group, None, level, last))
                    group, level, last = (tenant,), int(opening), None
                    continue
                if last is not None:
                    level = bucket.refilled(level, begin - last)
                if part == 0:
                    found.append((tenant, chunk, level, None))
                level, last = _apply_pieces(pieces, level), end
            rows = [(r[0], r[1], r[-2], r[-1]) for r in found]
            frame = pd.DataFrame(rows, columns=columns)
            yield frame.astype({"chunk": "Int64", "level": "Int64", "last_us": "Int64"})
        if group is not None and last is not None:
            frame = pd.DataFrame([(*group, None, level, last)], columns=columns)
            yield frame.astype({"chunk": "Int64", "level": "Int64", "last_us": "Int64"})

    return run


def _grouped(rows: DataFrame, above: Column) -> DataFrame:
    return rows.withColumn("above", above).repartition("tenant_id", "above").sortWithinPartitions("tenant_id", "above", "chunk", "part")


def _chained(functions: DataFrame, above: Column, found: DataFrame, bucket: Bucket) -> DataFrame:
    """``LEVELS`` of stretches, from the levels ``tenant_id, chunk, level`` of the groups they are in."""
    no_pieces = F.lit(None).cast("array<array<bigint>>")
    head = found.select(
        "tenant_id", F.lit(-(2**62)).cast("bigint").alias("chunk"), F.lit(-1).cast("bigint").alias("part"),
        F.lit(0).cast("bigint").alias("first_us"), F.lit(0).cast("bigint").alias("last_us"),
        no_pieces.alias("pieces"), "level", F.col("chunk").alias("above"),
    )
    rows = functions.withColumn("level", F.lit(-1).cast("bigint")).withColumn("above", above).unionByName(head)
    dealt = rows.repartition("tenant_id", "above").sortWithinPartitions("tenant_id", "above", "chunk", "part")
    return dealt.mapInPandas(_chain(bucket), LEVELS)


def chunk_levels(functions: DataFrame, bucket: Bucket, opening: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Level found at each chunk (``tenant_id, chunk, level``), and behind each tenant's last (``tenant_id, level, us``).

    ``opening`` has a level and its time for tenants that don't start with a full bucket.
    """
    tree = [staged(functions)]
    low, high = tree[0].agg(F.min("chunk"), F.max("chunk")).first()
    while low != high:
        low, high = low // FAN_IN, high // FAN_IN
        above = F.floor(F.col("chunk") / FAN_IN)
        tree.append(staged(_grouped(tree[-1], above).mapInPandas(_combine(bucket), PIECES)))
    starts = tree[-1].groupBy("tenant_id").agg(F.min("first_us").alias("first_us"))
    full = F.lit(bucket.full).cast("bigint")
    if opening is None:
        starts = starts.withColumn("level", full)
    else:
        known = opening.select("tenant_id", F.col("level").alias("left"), "us")
        fills = F.lit(bucket.slot_us + 1)
        gap = F.least(F.greatest(F.col("first_us") - F.col("us"), F.lit(0)), fills)
        level = F.coalesce(F.least(full, F.col("left") + gap * bucket.refill), full)
        starts = starts.join(known, "tenant_id", "left").withColumn("level", level)
    zero = F.lit(0).cast("bigint")
    found = staged(_chained(tree[-1], zero, starts.select("tenant_id", zero.alias("chunk"), "level"), bucket))
    closing = found.where("chunk is null").select("tenant_id", "level", F.col("last_us").alias("us"))
    for functions in reversed(tree[:-1]):
        levels = found.where("chunk is not null").select("tenant_id", "chunk", "level")
        found = _chained(functions, F.floor(F.col("chunk") / FAN_IN), levels, bucket)
    return found.where("chunk is not null").select("tenant_id", "chunk", "level"), closing


def _decide(bucket: Bucket):
    """Replay each chunk from the level carried by its first row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        level, last = 0, None
        for batch in batches:
            granted = []
            for at, tokens, found in zip(batch["at_us"], batch["tokens"], batch["level"]):
                if found >= 0:
                    level, last = int(found), None
                    granted.append(False)
                    continue
                if last is not None:
                    level = bucket.refilled(level, at - last)
                last = at
                ok = level >= tokens * bucket.unit
                if ok:
                    level -= tokens * bucket.unit
                granted.append(ok)
            out = batch[["tenant_id", "request_id"]].assign(granted=granted)
            yield out[batch["level"] < 0]

    return run


def requests_of(events: DataFrame) -> DataFrame:
    """One row per request: arrival time and one token per event."""
    return events.groupBy("tenant_id", "request_id").agg(
        F.max("received_at").alias("received_at"), F.count(F.lit(1)).alias("tokens")
    )


def contested_slots(requests: DataFrame, bucket: Bucket) -> DataFrame:
    """Slots in which a request might be refused, with the two before and after each."""
    slot = epoch_slot(F.col("received_at"), bucket.slot_us)
    pair = (
        requests.select("tenant_id", "tokens", F.explode(F.array(slot, slot + 1)).alias("slot"))
        .groupBy("tenant_id", "slot")
        .agg(F.sum("tokens").alias("asked"))
    )
    return (
        pair.filter(F.col("asked") > bucket.capacity)
        .select("tenant_id", F.explode(F.sequence(F.col("slot") - 2, F.col("slot") + 2)).alias("slot"))
        .distinct()
    )


def simulate(
    requests: DataFrame, bucket: Bucket, chunk_slots: int = 64, opening: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Exact decision for every request, by chunks of ``chunk_slots`` refill times, and the levels left behind."""
    rows = requests.select(
        "tenant_id",
        "request_id",
        F.unix_micros("received_at").alias("at_us"),
        "tokens",
        epoch_slot(F.col("received_at"), bucket.slot_us * chunk_slots).alias("chunk"),
    )
    order = ["tenant_id", "chunk", "at_us", "request_id"]
    functions = (
        rows.repartition("tenant_id", "chunk")
        .sortWithinPartitions(*order)
        .mapInPandas(_chunk_functions(bucket), PIECES)
    )
    levels, closing = chunk_levels(functions, bucket, opening)
    heads = levels.select(
        "tenant_id",
        F.lit("").alias("request_id"),
        F.lit(-(2**62)).cast("bigint").alias("at_us"),
        F.lit(0).cast("bigint").alias("tokens"),
        "chunk",
        "level",
    )
    decisions = (
        rows.withColumn("level", F.lit(-1).cast("bigint"))
        .unionByName(heads)
        .repartition("tenant_id", "chunk")
        .sortWithinPartitions(*order)
        .mapInPandas(_decide(bucket), DECISIONS)
    )
    return decisions, closing


def _around(rows: DataFrame, first: Column, last: Column) -> DataFrame:
    return rows.select("tenant_id", F.explode(F.sequence(first, last)).alias("slot"))


def decide_run(
    requests: DataFrame, bucket: Bucket, chunk_slots: int = 64, opening: DataFrame | None = None, keep: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Add ``granted`` to one row per request, and give the levels ``tenant_id, level, us`` the run leaves.

    ``opening`` are the levels that the run before has left; the requests of this run come after those. Runs
    one after another decide like one run over all their requests. The slots behind an opening and the last
    ones of each tenant are simulated too, as the former need not begin, and the latter end, with a full
    bucket. A null request id or tenant is one like others.
    """
    slot = epoch_slot(F.col("received_at"), bucket.slot_us)
    slots = contested_slots(requests, bucket)
    if opening is not None:
        begun = F.floor(F.col("us") / bucket.slot_us)
        slots = slots.unionByName(_around(opening, begun, begun + 2))
    if keep:
        ends = requests.groupBy("tenant_id").agg(F.max(slot).alias("end"))
        slots = slots.unionByName(_around(ends, F.col("end") - 2, F.col("end")))
    at_risk = requests.withColumn("slot", slot).join(slots.distinct(), ["tenant_id", "slot"], "left_semi").drop("slot")
    decisions, left = simulate(at_risk, bucket, chunk_slots, opening)
    decided = requests.join(decisions, ["tenant_id", "request_id"], "left").withColumn(
        "granted", F.coalesce("granted", F.lit(True))
    )
    if opening is not None:
        left = left.unionByName(opening.select("tenant_id", "level", "us").join(left, "tenant_id", "left_anti"))
    return decided, left


def decide_requests(requests: DataFrame, bucket: Bucket, chunk_slots: int = 64) -> DataFrame:
    """Add ``granted`` to one row per request."""
    return decide_run(requests, bucket, chunk_slots, keep=False)[0]
