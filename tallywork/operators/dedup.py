"""Idempotent deduplication: the first sighting of a (tenant, key) wins for a TTL.

The TTL runs from the accepted sighting. Duplicates do not extend it, and once
it has passed the key is accepted again, so the accepted sightings of a key are
a chain: the first one, then the first one at least a TTL later, and so on.

Two exact ways lead to that chain. A key with few sightings is folded in one
array. A key with many is never gathered: its chain is followed with one
``min`` per link, which Spark combines before the shuffle, for all such keys at
once. The number of links is bounded by the span of the data over the TTL.

Among the heavy keys, those with more than a ten-thousandth of all heavy
sightings are told apart. There can be at most ten thousand of them, so they are
broadcast, and their rows are never shuffled by key. The others are each too
small a share of the rows to unbalance a shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywork.functions.windows import micros
from tallywork.session import checkpoint_dir

KEYS = ["tenant_id", "idempotency_key"]
MAX_FOLDED = 1_000
MAX_GIANTS = 10_000


def _fold(rows: DataFrame, ttl_us: int, at: str, tie: str) -> DataFrame:
    """Flag sightings of keys small enough to be gathered as one array each.

    Only the arrival order is sorted and folded; the rest of a row travels along.
    Rows that do not take part group alone, by their own ``_apart`` value.
    """
    groups = [*KEYS, "_apart"]
    payload = [c for c in rows.columns if c not in groups]
    sightings = rows.groupBy(*groups).agg(F.collect_list(F.struct(*payload)).alias("_all"))

    def mark(row):
        return F.named_struct(F.lit("at"), F.unix_micros(row[at]), F.lit("tie"), row[tie])

    arrivals = F.array_sort(F.transform("_all", mark))
    start = F.slice(arrivals, 1, 1)

    def link(chain, mark_):
        opens = F.element_at(chain, -1)["at"] + F.lit(ttl_us)
        return F.when(mark_["at"] >= opens, F.concat(chain, F.array(mark_))).otherwise(chain)

    chain = F.when(F.size("_all") == 1, arrivals).otherwise(F.aggregate(arrivals, start, link))
    row = F.col("_row")
    return (
        sightings.select(*KEYS, chain.alias("_chain"), F.explode("_all").alias("_row"))
        .select(*KEYS, "_row.*", (~F.array_contains("_chain", mark(row))).alias("deduplicated"))
    )


def _chains(rows: DataFrame, ttl_us: int, at: str, tie: str, giants: bool) -> DataFrame:
    """Accepted sightings of heavy keys, one aggregation per link of the chain."""
    slim = rows.select(*KEYS, F.struct(F.unix_micros(at).alias("at"), F.col(tie).alias("tie")).alias("s"))
    slim = slim.checkpoint()
    links = []
    link = slim.groupBy(*KEYS).agg(F.min("s").alias("s")).checkpoint()
    while not link.isEmpty():
        links.append(link)
        opens = link.select(*KEYS, (F.col("s.at") + F.lit(ttl_us)).alias("_opens"))
        link = (
            slim.join(F.broadcast(opens) if giants else opens, KEYS)
            .filter(F.col("s.at") >= F.col("_opens"))
            .groupBy(*KEYS)
            .agg(F.min("s").alias("s"))
            .checkpoint()
        )
    return reduce(DataFrame.unionByName, links)


def _flag_by_chain(
    rows: DataFrame, ttl_us: int, at: str, tie: str, giants: bool
) -> DataFrame:
    accepted = _chains(rows, ttl_us, at, tie, giants).select(
        *KEYS,
        F.timestamp_micros("s.at").alias(at),
        F.col("s.tie").alias(tie),
        F.lit(True).alias("_accepted"),
    )
    # The join key is the whole identity of a sighting, so the copies of a heavy
    # key spread over all partitions.
    return rows.join(accepted, [*KEYS, at, tie], "left").withColumn(
        "deduplicated", F.col("_accepted").isNull()
    )


def heavy_keys(rows: DataFrame, max_folded: int = MAX_FOLDED) -> DataFrame:
    """Keys with more sightings than may be gathered in one array."""
    return (
        rows.groupBy(*KEYS)
        .agg(F.count(F.lit(1)).alias("sightings"))
        .filter(F.col("sightings") > max_folded)
    )


def flag_duplicates(
    rows: DataFrame,
    ttl: str = "24 hours",
    at: str = "received_at",
    tie: str = "event_id",
    max_folded: int = MAX_FOLDED,
    max_giants: int = MAX_GIANTS,
    among: Column | None = None,
    earlier: DataFrame | None = None,
) -> DataFrame:
    """Add ``deduplicated`` to every sighting; ``(at, tie)`` is the arrival order.

    Rows outside ``among`` are passed on as no duplicates and block no key. ``earlier`` has the last
    accepted sighting of keys before these rows (``tenant_id, idempotency_key, at_us, tie``), from
    which their TTL runs; rows that arrived before it are decided as if it had come after them.

    Counting the keys is an action. It reads the key columns and its shuffle
    carries one partial count per key and task. Without heavy keys, which is the
    usual case, the rows themselves are read once and shuffled once, by key.
    """
    ttl_us = micros(ttl)
    checkpoint_dir(rows.sparkSession)
    takes_part = F.lit(True) if among is None else F.coalesce(among, F.lit(False))
    if earlier is not None:
        past = earlier.select(
            *KEYS,
            F.timestamp_micros("at_us").alias(at),
            F.col("tie").cast(rows.schema[tie].dataType).alias(tie),
            F.lit(True).alias("_past"),
        )
        every = rows.withColumn("_past", F.lit(False)).unionByName(past, allowMissingColumns=True)
        flagged = flag_duplicates(every, ttl, at, tie, max_folded, max_giants, takes_part | F.col("_past"))
        return flagged.filter(~F.col("_past")).drop("_past")
    apart = F.when(~takes_part, F.col(tie).cast("string"))
    marked = rows.withColumn("_apart", apart)
    taking_part = F.col("_apart").isNull()
    names = [*rows.columns, "deduplicated"]

    heavy = heavy_keys(marked.filter(taking_part), max_folded).checkpoint()
    if heavy.isEmpty():
        return _fold(marked, ttl_us, at, tie).select(*names)

    # Fewer than max_giants keys can each hold more than that share of the total.
    share = heavy.agg(F.sum("sightings")).first()[0] / max_giants
    giants = heavy.filter(F.col("sightings") > share).select(*KEYS, F.lit(True).alias("_giant"))
    others = heavy.filter(F.col("sightings") <= share).select(*KEYS, F.lit(True).alias("_heavy"))
    weighed = marked.join(F.broadcast(giants), KEYS, "left")
    is_giant = F.coalesce("_giant", F.lit(False)) & taking_part
    giant_rows = weighed.filter(is_giant).select(*rows.columns)
    rest = weighed.filter(~is_giant).drop("_giant").join(others, KEYS, "left")
    is_heavy = F.coalesce("_heavy", F.lit(False)) & taking_part

    parts = [_fold(rest.filter(~is_heavy).drop("_heavy"), ttl_us, at, tie)]
    if not giants.isEmpty():
        parts.append(_flag_by_chain(giant_rows, ttl_us, at, tie, giants=True))
    if not others.isEmpty():
        heavy_rows = rest.filter(is_heavy).select(*rows.columns)
        parts.append(_flag_by_chain(heavy_rows, ttl_us, at, tie, giants=False))
    return reduce(DataFrame.unionByName, [part.select(*names) for part in parts])
