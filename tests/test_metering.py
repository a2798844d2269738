import random

import pytest
from pyspark.sql import functions as F

from conftest import ACME, at
from tallywork.functions.windows import in_window
from tallywork.operators import metering, running

TOKENS, REQUESTS = "llm.tokens.input", "llm.requests"
SMALL = {"model": "gpt-4o"}


def summary(readings):
    return sorted(
        (r.meter_code, tuple(sorted(r.dimensions.items())), r.quantity, r.event_count)
        for r in readings.collect()
    )


def test_sum_meter(events, meters):
    df = events(*[(str(s), ACME, TOKENS, 10 * s, SMALL, s) for s in (10, 20, 30)])
    row = metering.meter(df, meters).first()
    assert (row.quantity, row.event_count) == (600, 3)
    assert (row.window.start, row.window.end) == (at(0).replace(tzinfo=None), at(60).replace(tzinfo=None))


def test_count_meter_ignores_quantity(events, meters):
    df = events(*[(str(i), ACME, REQUESTS, 999, SMALL, i) for i in range(5)])
    assert summary(metering.meter(df, meters))[0][2:] == (5, 5)


def test_max_meter(events, meters):
    df = events(*[(str(q), ACME, "peak", q, None, 1) for q in (5, 9, 3)])
    assert summary(metering.meter(df, meters)) == [("peak", (), 9, 3)]


def test_unlisted_meter_is_summed(events, meters):
    df = events(("a", ACME, "other", 2, {}, 1), ("b", ACME, "other", 3, {}, 2))
    assert summary(metering.meter(df, meters)) == [("other", (), 5, 2)]


def test_dimensions_split_readings_whatever_their_order(events, meters):
    df = events(
        ("a", ACME, TOKENS, 100, {"model": "gpt-4o", "region": "x"}, 1),
        ("b", ACME, TOKENS, 1, {"region": "x", "model": "gpt-4o"}, 2),
        ("c", ACME, TOKENS, 70, {"model": "claude"}, 3),
    )
    assert [r[2] for r in summary(metering.meter(df, meters))] == [70, 101]


def test_dimension_text_that_collides_stays_apart(events, meters):
    df = events(
        ("a", ACME, TOKENS, 1, {"a": "1;b=2"}, 1), ("b", ACME, TOKENS, 2, {"a": "1", "b": "2"}, 2)
    )
    assert metering.meter(df, meters).count() == 2


def test_sum_overflow_fails_but_only_for_sums(events, meters):
    big = 2**62
    rows = [("a", ACME, REQUESTS, big, {}, 1), ("b", ACME, REQUESTS, big, {}, 2)]
    assert metering.meter(events(*rows), meters).first().quantity == 2
    rows = [(k, t, TOKENS, q, d, s) for k, t, _, q, d, s in rows]
    with pytest.raises(Exception, match="meter total exceeds"):
        metering.meter(events(*rows), meters).collect()


def test_window_is_half_open(spark):
    window = F.struct(F.lit(at(0)).alias("start"), F.lit(at(60)).alias("end"))
    checks = [in_window(F.lit(at(s)), window) for s in (-1, 0, 59, 60)]
    assert list(spark.range(1).select(*checks).first()) == [False, True, True, False]


@pytest.mark.parametrize("chunk", ["1 second", "1 minute", "1 day"])
def test_lateness_matches_brute_force(spark, chunk):
    rng = random.Random(5)
    rows = [
        (i, rng.choice("ab"), at(s + rng.randrange(-150, 20)), at(s))
        for i, s in enumerate(sorted(rng.randrange(0, 4000) for _ in range(400)))
    ]
    df = spark.createDataFrame(
        rows, "event_id bigint, tenant_id string, occurred_at timestamp, received_at timestamp"
    )
    got = {r.event_id: r.lateness for r in metering.classify_lateness(df, chunk=chunk).collect()}
    seen, want = {}, {}
    for i, tenant, occurred, _ in sorted(rows, key=lambda r: (r[3], r[0])):
        now = seen[tenant] = max(seen.get(tenant, occurred), occurred)
        end = (occurred.timestamp() // 60 + 1) * 60
        want[i] = (
            "dropped" if end + 30 <= now.timestamp() else "late" if end <= now.timestamp() else "on_time"
        )
    assert got == want
    assert set(want.values()) == {"dropped", "late", "on_time"}


def test_running_functions_match_one_window(spark):
    rng = random.Random(9)
    rows = [(rng.choice("xy"), i, i // 7 + (i // 40) * 5, rng.randrange(100)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, pos int, chunk int, v int")
    got_sum = {r.pos: r.s for r in running.running_sum(df, ["k"], "chunk", ["pos"], "v", "s").collect()}
    got_max = {r.pos: r.s for r in running.running_max(df, ["k"], "chunk", ["pos"], "v", "s").collect()}
    got_lag = {r.pos: r.s for r in running.previous_value(df, ["k"], "chunk", ["pos"], "v", "s").collect()}
    history = {"x": [], "y": []}
    for k, pos, _, v in rows:
        assert got_lag[pos] == (history[k][-1] if history[k] else None)
        history[k].append(v)
        assert got_sum[pos] == sum(history[k])
        assert got_max[pos] == max(history[k])
