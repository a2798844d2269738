import random

import pytest
from pyspark.sql import functions as F

from conftest import at
from tallywork.operators import opsmetrics as O


def test_rate_counts_each_row_in_every_span_that_holds_it(spark):
    df = spark.createDataFrame([("a", at(1)), ("a", at(16)), ("b", at(1))], "k string, ts timestamp")
    got = {(r.k, r.window_end): r.events for r in O.event_rate(df, ["k"]).collect()}
    assert got["a", at(15).replace(tzinfo=None)] == 1
    assert got["a", at(60).replace(tzinfo=None)] == 2
    assert got["a", at(75).replace(tzinfo=None)] == 1
    assert len([k for k in got if k[0] == "b"]) == 4


def test_rate_span_must_be_a_multiple_of_the_step(spark):
    df = spark.createDataFrame([(at(1),)], "ts timestamp")
    with pytest.raises(ValueError):
        O.event_rate(df, [], span="50 seconds")


def test_histogram_quantiles(spark):
    df = spark.createDataFrame([(at(1), float(v)) for v in range(1, 101)], "ts timestamp, v double")
    bounds = (10.0, 50.0, 90.0)
    buckets = O.histogram(df, [], "v", bounds, "5 minutes")
    row = O.histogram_quantiles(buckets, [], bounds, "5 minutes").first()
    assert row.samples == 100
    assert row.p50 == pytest.approx(50.0)
    # Ranks beyond the last bound give that bound.
    assert (row.p95, row.p99) == (90.0, 90.0)


def test_exact_quantiles_interpolate(spark):
    rng = random.Random(1)
    values = [round(rng.expovariate(0.02), 1) for _ in range(999)]
    df = spark.createDataFrame([("g", v) for v in values] + [("h", 5.0)], "g string, v double")
    got = {r.g: r for r in O.exact_quantiles(df, ["g"], "v", coarse=7.0).collect()}
    want = df.groupBy("g").agg(F.percentile("v", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99))).alias("p"))
    for row in want.collect():
        assert [got[row.g].p50, got[row.g].p95, got[row.g].p99] == pytest.approx(row.p)


def test_consumer_lag_takes_the_latest_sample(spark):
    df = spark.createDataFrame(
        [("a", 0, at(1), 5), ("a", 0, at(2), 3), ("a", 1, at(1), 4)],
        "app string, part int, ts timestamp, value bigint",
    )
    assert O.consumer_lag(df, ["app", "part"], ["app"]).first().lag == 7


def test_counter_rate_handles_resets(spark):
    values = [10, 15, 4, 6]
    df = spark.createDataFrame(
        [("a", i, at(i * 20), v) for i, v in enumerate(values)],
        "app string, sample_id int, ts timestamp, value bigint",
    )
    got = O.counter_rate(df, ["app"], ["app"], chunk="30 seconds").orderBy("window_start").collect()
    assert [r.increase for r in got] == [5 + 4, 2]


def test_load_summary_and_objectives(spark):
    rows = [("g", 500, at(i / 10), 200, 10.0) for i in range(95)]
    rows += [("g", 500, at(9.5 + i / 10), 503, 9000.0) for i in range(6)]
    df = spark.createDataFrame(
        rows, "gateway string, target_rate int, ts timestamp, status int, latency_ms double"
    )
    row = O.objectives(O.load_summary(df)).first()
    assert (row.requests, row.max_ms, row.p50) == (101, 9000.0, 10.0)
    assert row.throughput == pytest.approx(10.1)
    assert (row.errors_ok, row.latency_ok, row.passed) == (False, False, False)


def test_acceptance(spark):
    outcomes = spark.createDataFrame([("deduplicated",), ("accepted",)], "outcome string")
    good = spark.createDataFrame([(True,)], "all_match boolean")
    bad = spark.createDataFrame([(True,), (False,)], "all_match boolean")
    billed = spark.createDataFrame([(5,)], "total_minor bigint")
    assert list(O.acceptance(outcomes, good, billed).first()) == [True, True, True, True]
    assert list(O.acceptance(outcomes, bad, billed).first()) == [True, False, True, False]
    none = outcomes.filter("outcome = 'x'")
    assert not O.acceptance(none, good, billed).first().passed
