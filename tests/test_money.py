from decimal import ROUND_HALF_EVEN, Decimal, localcontext

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import ArithmeticException
from pyspark.sql import functions as F

from tallywork.functions import money as M

LONG_MAX = 2**63 - 1


def long(value):
    return F.lit(value).cast("bigint")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("units", "price", "per", "cents"),
    [
        (1500, 30, 1000, 45),
        (1, 1, 2, 0),
        (3, 1, 2, 2),
        (0, 1, 2, 0),
        (-4, 1, 2, 0),
        (1_000_000_001, 1, 2_000_000_000, 1),
        (LONG_MAX, 1000, 1000, LONG_MAX),
        (LONG_MAX, 1, 1, LONG_MAX),
    ],
)
def test_tier_cost(spark, units, price, per, cents):
    assert one(spark, M.tier_cost(long(units), long(price), long(per))) == cents


def test_tier_cost_overflow_fails(spark):
    with pytest.raises(Exception, match="amount exceeds a bigint"):
        one(spark, M.tier_cost(long(LONG_MAX), long(3), long(1)))
    assert one(spark, M.try_tier_cost(long(LONG_MAX), long(3), long(1))) is None


triples = st.lists(
    st.tuples(
        st.integers(0, LONG_MAX) | st.integers(0, 5000),
        st.integers(0, 1_000_000) | st.integers(0, 20),
        st.integers(1, 2**40) | st.integers(1, 20),
    ).filter(lambda t: t[0] * t[1] // t[2] < LONG_MAX),
    min_size=200,
    max_size=400,
)


@settings(
    max_examples=4, deadline=None, suppress_health_check=list(HealthCheck)
)
@given(triples)
def test_tier_cost_matches_decimal(spark, rows):
    df = spark.createDataFrame(rows, "u bigint, p bigint, d bigint")
    got = df.select("u", "p", "d", M.tier_cost(F.col("u"), F.col("p"), F.col("d")).alias("c"))
    for u, p, d, cost in got.collect():
        with localcontext() as ctx:
            ctx.prec = 80
            exact = Decimal(u) * Decimal(p) / Decimal(d)
            want = int(exact.quantize(Decimal(1), ROUND_HALF_EVEN))
        assert cost == want, (u, p, d)


@pytest.mark.parametrize(("net", "tax"), [(1000, 100), (5, 0), (15, 2), (0, 0), (-5, 0), (-15, -2)])
def test_gst(spark, net, tax):
    assert one(spark, M.gst(long(net))) == tax


@pytest.mark.parametrize(
    ("minor", "text"),
    [(1234, "AUD 12.34"), (-5, "AUD -0.05"), (0, "AUD 0.00"), (-1234567, "AUD -12345.67")],
)
def test_format(spark, minor, text):
    assert one(spark, M.format_money(long(minor), F.lit("AUD"))) == text


def test_arithmetic(spark):
    assert one(spark, M.from_major(long(12), F.lit("AUD"))) == 1200
    assert one(spark, M.minus(long(1000), long(1500))) == -500
    assert one(spark, M.plus(long(1000), long(1500))) == 2500
    assert one(spark, M.negate(long(7))) == -7
    assert one(spark, M.times(long(7), long(6))) == 42
    assert one(spark, M.is_zero(long(0))) and one(spark, M.is_negative(long(-1)))
    assert one(spark, M.is_positive(long(1)))


def test_overflow_fails(spark):
    for build in (
        lambda: M.times(long(LONG_MAX), long(2)),
        lambda: M.plus(long(LONG_MAX), long(1)),
        lambda: M.minus(long(-LONG_MAX), long(2)),
        lambda: M.from_major(long(LONG_MAX), F.lit("AUD")),
    ):
        with pytest.raises(ArithmeticException):
            one(spark, build())


def test_unknown_currency_fails(spark):
    with pytest.raises(Exception, match="unknown currency"):
        one(spark, M.from_major(long(1), F.lit("XXX")))


def test_mixed_currency_groups(spark):
    rows = spark.createDataFrame([("a", "AUD"), ("a", "NZD"), ("b", "AUD")], "k string, currency string")
    assert [r.k for r in M.mixed_currency_groups(rows, "k").collect()] == ["a"]


def test_costs_beyond_a_bigint_by_long_division(spark):
    """Exact for products of any size; what does not fit is null, also where a decimal would overflow."""
    big = [1, 7, 2**31 + 1, 10**12 + 3, 10**17 + 9, 2**61, 2**62 + 5, LONG_MAX - 1, LONG_MAX]
    rows = [(u, p, d) for u in big for p in big for d in big]
    df = spark.createDataFrame(rows, "u bigint, p bigint, d bigint").coalesce(1)
    got = df.select("u", "p", "d", M.try_tier_cost(F.col("u"), F.col("p"), F.col("d")).alias("c")).collect()
    for r in got:
        whole, rest = divmod(r.u * r.p, r.d)
        cost = whole + (2 * rest > r.d or (2 * rest == r.d and whole % 2 == 1))
        assert r.c == (cost if cost <= LONG_MAX else None), r
