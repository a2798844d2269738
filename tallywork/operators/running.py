"""Running aggregates that do not put a whole key into one task.

A window function sorts every row of its partition key in one task. The two
functions here cut each key into chunks of the ordering column, run the window
inside a chunk, and carry the result of the earlier chunks in from a table with
one row per (key, chunk). That table is a summary: its size depends on the span
of the ordering column and the chunk length, not on the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _carry(df: DataFrame, keys: Sequence[str], chunk: str, summary: Column, fold) -> DataFrame:
    """Per (key, chunk): the fold of the summaries of all earlier chunks."""
    parts = df.groupBy(*keys, chunk).agg(summary.alias("_part"))
    before = (
        Window.partitionBy(*keys)
        .orderBy(chunk)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return parts.select(*keys, chunk, fold(F.col("_part")).over(before).alias("_carry"))


def running_max(
    df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[str], value: str, out: str
) -> DataFrame:
    """Add the running maximum of ``value`` over ``order``, the current row included."""
    carry = _carry(df, keys, chunk, F.max(value), F.max)
    inside = (
        Window.partitionBy(*keys, chunk)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        df.join(carry, [*keys, chunk])
        .withColumn(out, F.greatest(F.col("_carry"), F.max(value).over(inside)))
        .drop("_carry")
    )


def running_sum(
    df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[str], value: str, out: str
) -> DataFrame:
    """Add the running sum of ``value`` over ``order``, the current row included."""
    carry = _carry(df, keys, chunk, F.sum(value), F.sum)
    inside = (
        Window.partitionBy(*keys, chunk)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    total = F.coalesce(F.col("_carry"), F.lit(0)) + F.sum(value).over(inside)
    return df.join(carry, [*keys, chunk]).withColumn(out, total).drop("_carry")


def previous_value(
    df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[str], value: str, out: str
) -> DataFrame:
    """Add the value of the row before this one in ``order``; null for the first row.

    ``value`` must not be null: the carried-in value of a chunk is the last one
    of the nearest earlier chunk that has rows.
    """
    last = F.max_by(value, F.struct(*order))
    carry = _carry(df, keys, chunk, last, lambda part: F.last(part, ignorenulls=True))
    inside = Window.partitionBy(*keys, chunk).orderBy(*order)
    return (
        df.join(carry, [*keys, chunk])
        .withColumn(out, F.coalesce(F.lag(value).over(inside), F.col("_carry")))
        .drop("_carry")
    )
