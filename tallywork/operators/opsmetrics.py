"""Operational metrics over outcome, request-log and metric-sample tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywork.functions.windows import epoch_slot, micros
from tallywork.operators.running import previous_value, running_sum

# Service objectives of the load test.
MAX_ERROR_RATE = 0.05
MAX_P99_MS = 2000.0
QUANTILES = {"p50": 0.50, "p95": 0.95, "p99": 0.99}


def event_rate(
    rows: DataFrame,
    by: Sequence[str],
    ts: str = "ts",
    span: str = "1 minute",
    step: str = "15 seconds",
    weight: Column | None = None,
) -> DataFrame:
    """Events per second over a span that slides by a step.

    Rows are counted once per step, with partial counts before the shuffle; only
    those counts are copied to the spans they belong to.
    """
    length, hop = micros(span), micros(step)
    if length % hop:
        raise ValueError("the span must be a multiple of the step")
    amount = F.count(F.lit(1)) if weight is None else F.sum(weight)
    steps = rows.groupBy(*by, epoch_slot(F.col(ts), hop).alias("step")).agg(amount.alias("n"))
    ends = F.sequence(F.col("step") + 1, F.col("step") + F.lit(length // hop))
    return (
        steps.select(*by, "n", F.explode(ends).alias("end_step"))
        .groupBy(*by, "end_step")
        .agg(F.sum("n").alias("events"))
        .select(
            *by,
            F.timestamp_micros(F.col("end_step") * F.lit(hop)).alias("window_end"),
            "events",
            (F.col("events") / F.lit(length / 1_000_000)).alias("per_second"),
        )
    )


def histogram(
    rows: DataFrame, by: Sequence[str], value: str, bounds: Sequence[float], window: str, ts: str = "ts"
) -> DataFrame:
    """Rows per group, tumbling window and latency bucket; the last bucket is unbounded."""
    bucket = None
    for i, bound in enumerate(bounds):
        hit = F.col(value) <= F.lit(float(bound))
        bucket = F.when(hit, i) if bucket is None else bucket.when(hit, i)
    return (
        rows.select(
            *by,
            epoch_slot(F.col(ts), micros(window)).alias("slot"),
            bucket.otherwise(len(bounds)).alias("bucket"),
        )
        .groupBy(*by, "slot", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def histogram_quantiles(
    buckets: DataFrame,
    by: Sequence[str],
    bounds: Sequence[float],
    window: str,
    quantiles: dict[str, float] = QUANTILES,
) -> DataFrame:
    """Quantiles interpolated inside the bucket that holds the rank.

    The lowest bucket starts at zero. A rank in the unbounded bucket gives the
    highest bound. A group and window has one row per bucket at most.
    """
    edges = F.array(*[F.lit(float(b)) for b in bounds])
    group = [*by, "slot"]
    whole = Window.partitionBy(*group)
    upto = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = buckets.withColumn("total", F.sum("n").over(whole)).withColumn(
        "upto", F.sum("n").over(upto)
    )
    low = F.when(F.col("bucket") == 0, F.lit(0.0)).otherwise(F.get(edges, F.col("bucket") - 1))
    high = F.get(edges, F.col("bucket"))
    picks = []
    for name, q in quantiles.items():
        rank = F.lit(q) * F.col("total")
        here = (F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank)
        part = (rank - (F.col("upto") - F.col("n"))) / F.col("n")
        value = F.when(F.col("bucket") == len(bounds), F.lit(float(bounds[-1]))).otherwise(
            low + (high - low) * part
        )
        picks.append(F.max(F.when(here, value)).alias(name))
    return (
        ranked.groupBy(*group)
        .agg(F.max("total").alias("samples"), *picks)
        .withColumn("window_start", F.timestamp_micros(F.col("slot") * F.lit(micros(window))))
        .drop("slot")
    )


def outcome_totals(outcomes: DataFrame) -> DataFrame:
    """Total charges posted and duplicates avoided."""
    zero = F.lit(0).cast("bigint")
    return outcomes.agg(
        F.coalesce(F.sum("posted"), zero).alias("total_posted"),
        F.coalesce(F.sum("duplicates"), zero).alias("duplicates_avoided"),
    )


def consumer_lag(samples: DataFrame, series: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Latest sample of each series, added up per group."""
    latest = samples.groupBy(*series).agg(F.max_by("value", F.struct("ts", "value")).alias("lag"))
    return latest.groupBy(*by).agg(F.sum("lag").alias("lag"))


def counter_rate(
    samples: DataFrame,
    series: Sequence[str],
    by: Sequence[str],
    window: str = "1 minute",
    tie: str = "sample_id",
    chunk: str = "1 minute",
) -> DataFrame:
    """Increase per second of counters, per group and tumbling window.

    A counter that falls was reset and counts from zero. The first sample of a
    series has nothing to be compared with.
    """
    chunked = samples.withColumn("_chunk", epoch_slot(F.col("ts"), micros(chunk)))
    stepped = previous_value(chunked, series, "_chunk", ["ts", tie], "value", "_before")
    gain = F.when(F.col("value") >= F.col("_before"), F.col("value") - F.col("_before")).otherwise(
        F.col("value")
    )
    return (
        stepped.filter(F.col("_before").isNotNull())
        .groupBy(*by, epoch_slot(F.col("ts"), micros(window)).alias("slot"))
        .agg(F.sum(gain).alias("increase"))
        .select(
            *by,
            F.timestamp_micros(F.col("slot") * F.lit(micros(window))).alias("window_start"),
            "increase",
            (F.col("increase") / F.lit(micros(window) / 1_000_000)).alias("per_second"),
        )
    )


def exact_quantiles(
    rows: DataFrame,
    by: Sequence[str],
    value: str,
    quantiles: dict[str, float] = QUANTILES,
    coarse: float = 1.0,
) -> DataFrame:
    """Exact quantiles with linear interpolation between neighbouring ranks.

    Equal values are counted before anything is ordered, and the ranks come from
    a running sum in chunks of width ``coarse``, so no group is sorted or held
    in one task.
    """
    counts = (
        rows.groupBy(*by, F.col(value).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_chunk", F.floor(F.col("_v") / F.lit(coarse)))
    )
    ranked = running_sum(counts, list(by), "_chunk", ["_v"], "_n", "_upto")
    totals = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_total"))
    joined = ranked.join(totals, list(by))
    picks = []
    for name, q in quantiles.items():
        at = F.lit(q) * (F.col("_total") - 1)
        below = F.min(F.when(F.col("_upto") > F.floor(at), F.col("_v")))
        above = F.min(F.when(F.col("_upto") > F.ceil(at), F.col("_v")))
        part = F.max(at - F.floor(at))
        picks.append((below + (above - below) * part).alias(name))
    return joined.groupBy(*by).agg(*picks)


def load_summary(
    log: DataFrame, by: Sequence[str] = ("gateway", "target_rate"), ts: str = "ts"
) -> DataFrame:
    """Throughput, latency quantiles and error rate of each load run.

    A run lasts from its first to its last request. A status of 400 or more is
    an error.
    """
    totals = log.groupBy(*by).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("status") >= 400).alias("errors"),
        F.max("latency_ms").alias("max_ms"),
        (F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))).alias("span_us"),
    )
    return totals.join(exact_quantiles(log, by, "latency_ms"), list(by)).select(
        *by,
        "requests",
        (F.col("requests") / F.nullif(F.col("span_us") / F.lit(1_000_000), F.lit(0.0))).alias(
            "throughput"
        ),
        *QUANTILES,
        "max_ms",
        (F.col("errors") / F.col("requests")).alias("error_rate"),
    )


def objectives(summary: DataFrame) -> DataFrame:
    """Whether each load run met the service objectives."""
    errors = F.col("error_rate") < MAX_ERROR_RATE
    latency = F.col("p99") < MAX_P99_MS
    return summary.withColumn("errors_ok", errors).withColumn("latency_ok", latency).withColumn(
        "passed", errors & latency
    )


def acceptance(outcomes: DataFrame, verified: DataFrame, invoices: DataFrame) -> DataFrame:
    """One row: duplicates were seen, the ledger balances, every invoice has a total."""
    checks = {
        "duplicates_seen": outcomes.agg(
            (F.count_if(F.col("outcome") == "deduplicated") > 0).alias("ok")
        ),
        "ledger_balanced": verified.agg(F.coalesce(F.bool_and("all_match"), F.lit(True)).alias("ok")),
        "invoices_positive": invoices.agg(
            F.coalesce(F.bool_and(F.col("total_minor") > 0), F.lit(True)).alias("ok")
        ),
    }
    rows = reduce(
        DataFrame.unionByName,
        [result.select(F.lit(name).alias("name"), "ok") for name, result in checks.items()],
    )
    flags = [F.bool_and(F.when(F.col("name") == name, F.col("ok"))).alias(name) for name in checks]
    return rows.agg(*flags, F.bool_and("ok").alias("passed"))
