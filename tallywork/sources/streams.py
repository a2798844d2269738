"""Stream sources and sinks. The format is a parameter: Kafka in production, files in tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter


def kafka_options(servers: str, topic: str) -> dict[str, str]:
    """Source options: from the earliest offset, committed records only."""
    return {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": "earliest",
        "kafka.isolation.level": "read_committed",
        "failOnDataLoss": "true",
    }


def kafka_sink_options(servers: str, topic: str) -> dict[str, str]:
    """Sink options: wait for all replicas, idempotent producer."""
    return {
        "kafka.bootstrap.servers": servers,
        "topic": topic,
        "kafka.acks": "all",
        "kafka.enable.idempotence": "true",
    }


def read_kafka(spark: SparkSession, servers: str, topic: str, streaming: bool = True) -> DataFrame:
    """Raw ``(key, value, timestamp)`` records of a topic."""
    reader = spark.readStream if streaming else spark.read
    frame = reader.format("kafka").options(**kafka_options(servers, topic)).load()
    return frame.selectExpr("cast(key as string) key", "cast(value as string) value", "timestamp")


def read_files(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    fmt: str = "json",
    streaming: bool = True,
    files_per_trigger: int | None = None,
) -> DataFrame:
    """Typed rows from a folder of files, as a stream or a table."""
    if not streaming:
        return spark.read.schema(schema).format(fmt).load(path)
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def write_stream(
    rows: DataFrame,
    fmt: str,
    checkpoint: str,
    options: dict[str, str],
    available_now: bool = False,
) -> DataStreamWriter:
    """An append-mode writer whose checkpoint makes the file and table sinks exactly-once."""
    writer = (
        rows.writeStream.outputMode("append")
        .format(fmt)
        .option("checkpointLocation", checkpoint)
        .options(**options)
    )
    return writer.trigger(availableNow=True) if available_now else writer


def by_tenant(rows: DataFrame, partitions: int, salt_by: str, spread: int = 1) -> DataFrame:
    """Lay rows out by tenant, the key of every topic.

    ``spread`` divides each tenant over that many slices by a hash of ``salt_by``,
    so that a dominant tenant is not one task; rows that agree on ``salt_by``
    stay together. The slice is a function of the row, so a recomputed partition
    holds the same rows after an executor is lost.
    """
    if spread <= 1:
        return rows.repartition(partitions, "tenant_id")
    slice_no = F.pmod(F.xxhash64(salt_by), F.lit(spread))
    return rows.repartition(partitions, F.col("tenant_id"), slice_no)
