"""Accepted sightings kept between runs, so that a key accepted by an earlier run is a duplicate in the next one.

Sightings are stored by UTC day of arrival and bucket of the key's hash. Beside them lies a Bloom filter, also by
day: bitmaps of 32 768 bits, one for each block that keys are dealt over by hash. A run joins its distinct keys
with the blocks of the days within the TTL; only keys that pass, and only the buckets these are in, are looked up among the
sightings. Nothing is visible before the commit of its run, see :mod:`tallywork.sources.tables`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywork.session import staged
from tallywork.sources.tables import ATTEMPT, TableStore

KEYS = ["tenant_id", "idempotency_key"]
BUCKETS = 64
BLOCKS = 1024  # of 32 768 bits a day: ten bits a key for 3.3 million keys
BITS = 4  # set for a key
BITMAP = 32_768


def _hash(seed: int) -> Column:
    return F.xxhash64(*KEYS, F.lit(seed))


def _places() -> Column:
    """The bits of a key within its block."""
    parts = [F.shiftrightunsigned(_hash(1), 15 * k).bitwiseAND(F.lit(BITMAP - 1)) for k in range(BITS)]
    return F.array(*parts)


def _is_set(bits: Column, place: Column) -> Column:
    byte = F.substring(bits, (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))
    value = F.conv(F.hex(byte), 16, 10).cast("int")
    return F.pmod(F.floor(value / F.pow(F.lit(2.0), F.pmod(place, F.lit(8)))), F.lit(2)) == 1


class SightingStore:
    """Looks keys up among the sightings of earlier runs and records new ones."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, blocks: int = BLOCKS):
        self.spark = spark
        self.tables = TableStore(spark, root)
        self.buckets = buckets
        self.blocks = blocks

    def _block(self) -> Column:
        return F.pmod(_hash(2), F.lit(self.blocks)).cast("int")

    def possible(self, keys: DataFrame, since: Column) -> DataFrame:
        """The distinct ``keys`` that may have been seen on a day from ``since`` on; a few were not."""
        filters = self.tables.read("sighting_filter").where(F.col("day") >= F.to_date(since))
        own = filters.where(F.col("blocks") == self.blocks).groupBy("block").agg(F.bitmap_or_agg("bits").alias("bits"))
        asked = keys.select(*KEYS).distinct().withColumn("block", self._block()).withColumn("places", _places())
        passed = asked.join(own, "block").where(F.forall("places", lambda p: _is_set(F.col("bits"), p)))
        # Days that were written with another number of blocks can't be skipped.
        other = filters.where(F.col("blocks") != self.blocks).limit(1)
        if not other.isEmpty():
            passed = asked
        return passed.select(*KEYS, F.pmod(_hash(3), F.lit(self.buckets)).cast("int").alias("bucket"))

    def earlier(self, keys: DataFrame, since: Column) -> DataFrame:
        """``tenant_id, idempotency_key, at_us, tie``: each key's last accepted sighting on a day from ``since`` on."""
        passed = staged(self.possible(keys, since))
        buckets = [r.bucket for r in passed.select("bucket").distinct().collect()]
        # All three lay out the folders: other buckets and days are not listed. Another number of buckets skips none.
        own = F.col("bucket").isin(buckets) | (F.col("of_buckets") != self.buckets)
        rows = self.tables.read("sighting").where((F.col("day") >= F.to_date(since)) & own)
        met = rows.join(passed.select(*KEYS), KEYS, "left_semi")
        last = met.groupBy(*KEYS).agg(F.max(F.struct("at_us", "tie")).alias("last"))
        return last.select(*KEYS, "last.at_us", "last.tie")

    def record(self, accepted: DataFrame, attempt: str, at: str = "received_at", tie: str = "event_id") -> None:
        """Write the accepted sightings of a run and their filter, for the run's commit to make visible."""
        rows = accepted.select(
            *KEYS,
            F.unix_micros(at).alias("at_us"),
            F.col(tie).cast("string").alias("tie"),
            F.to_date(at).alias("day"),
            F.pmod(_hash(3), F.lit(self.buckets)).cast("int").alias("bucket"),
            F.lit(self.buckets).alias("of_buckets"),
        )
        self.tables.write("sighting", rows.repartition("day", "bucket").sortWithinPartitions("day", "bucket", *KEYS), attempt)
        bits = accepted.select(F.to_date(at).alias("day"), self._block().alias("block"), F.explode(_places()).alias("place"))
        filters = bits.groupBy("day", "block").agg(F.bitmap_construct_agg("place").alias("bits"))
        self.tables.write("sighting_filter", filters.withColumn("blocks", F.lit(self.blocks)), attempt)

    def levels(self, attempt: str | None) -> DataFrame:
        """The bucket levels that a run has left."""
        return self.tables.read_attempt("bucket_level", attempt or "none")

    def last_attempt(self, writer: str) -> str | None:
        """The attempt that counts of a writer's last run."""
        own = self.tables.commits().filter(F.col("writer") == writer)
        return own.agg(F.max_by(ATTEMPT, "seq")).first()[0]
