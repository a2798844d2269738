"""Token ids as ORC: run-length encoded integers, row indexes and Bloom filters on document ids.

Files are written in ascending order of doc_id, so that a stripe's statistics bound the ids it
holds; a reader takes stripes in parallel, and a lookup by id skips all but a few by their
row index or Bloom filter.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tallywork.llm.text import bound_batches, released
from tallywork.llm.tokens import encoder
from tallywork.session import checkpoint_dir

SCHEMA = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
    ]
)
OPTIONS = {
    "compression": "zstd",
    "orc.stripe.size": str(16 << 20),
    "orc.row.index.stride": "1000",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}


def _encode(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id")
        part = batch.column("part")
        for i, j, flat_ids, ends in encoder(path).texts(batch.column("text")):
            own = np.insert(flat_ids, ends, np.uint32(end_id)).astype(np.int32)
            stops = np.append(0, ends + np.arange(1, j - i + 1))
            lists = pa.ListArray.from_arrays(pa.array(stops.astype(np.int32)), pa.array(own))
            yield pa.RecordBatch.from_arrays(
                [part.slice(i, j - i), ids.slice(i, j - i), pa.array(np.diff(stops)), lists],
                ["part", "doc_id", "n_tokens", "ids"],
            )
        released()


def write(docs: DataFrame, folder: str, path: str, end_id: int, partitions: int | None = None) -> None:
    """Encode the texts and write them to ``folder`` in ascending doc_id order.

    Only texts are shuffled, by range of doc_id; encoding comes after, so ids go from the
    encoder to the file. A null id sorts first; rows of one id keep any order among themselves.
    """
    bound_batches(docs)
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text"))
    rows = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first())
    rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    rows = rows.withColumn("part", F.spark_partition_id())
    encoded = rows.mapInArrow(partial(_encode, path=path, end_id=end_id), SCHEMA)
    encoded.write.options(**OPTIONS).orc(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The stored rows: part, doc_id, n_tokens, ids. Filters on doc_id reach the row index and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(folder)


def _checksum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        values = np.asarray(lists.values).astype("<u4", copy=False)
        at = np.asarray(lists.offsets)
        sums = [zlib.crc32(values[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("part", "doc_id", "n_tokens")), pa.array(sums, pa.int64())],
            ["part", "doc_id", "n_tokens", "ids_crc32"],
        )


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from the files.

    ``start`` is the ids of all documents before one. Rows are summed within their part, which
    a writing task bounds; the parts' totals, one row each, give every part its base.
    """
    rows = read(spark, folder).mapInArrow(_checksum, "part int, doc_id long, n_tokens long, ids_crc32 long")
    totals = read(spark, folder).groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("ids_crc32"), F.col("n_tokens")]
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(bases, "part")
        .select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
    )


def token_files(docs: DataFrame, path: str, end_id: int = 0, folder: str | None = None) -> DataFrame:
    """Write the token ids of all documents and read their digests back.

    A null or empty text is the end id alone. An empty table writes no rows and gives none.
    Columns beside doc_id and text are ignored.
    """
    spark = docs.sparkSession
    folder = folder or f"{checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write(docs, folder, path, end_id)
    return digests(spark, folder)
