"""Window predicates and billing periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_window(instant: Column, window: Column) -> Column:
    """``start <= instant < end``."""
    return (instant >= window["start"]) & (instant < window["end"])


def period_start(period: Column) -> Column:
    """First instant of a ``YYYY-MM`` period, UTC."""
    return F.to_timestamp(F.concat(period, F.lit("-01")), "yyyy-MM-dd")


def period_end(period: Column) -> Column:
    """First instant after a ``YYYY-MM`` period."""
    return F.add_months(period_start(period).cast("date"), 1).cast("timestamp")


def period_of(instant: Column) -> Column:
    """The ``YYYY-MM`` period an instant belongs to."""
    return F.date_format(instant, "yyyy-MM")


def micros(interval: str) -> int:
    """Length of a simple interval such as ``30 seconds`` or ``1 day`` in microseconds."""
    count, unit = interval.split()
    # Microseconds per unit.
    size = {
        "microsecond": 1,
        "millisecond": 1_000,
        "second": 1_000_000,
        "minute": 60_000_000,
        "hour": 3_600_000_000,
        "day": 86_400_000_000,
    }[unit.rstrip("s")]
    return int(count) * size


def epoch_slot(ts: Column, length_us: int) -> Column:
    """Number of the epoch-aligned slot of ``length_us`` microseconds an instant is in."""
    at = F.unix_micros(ts)
    size = F.lit(length_us).cast("bigint")
    return F.call_function("div", at - F.pmod(at, size), size)
