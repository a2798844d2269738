"""Exact money arithmetic on ``bigint`` minor units.

All functions build column expressions that stay in the JVM. Nothing here goes
through a floating-point number, and results that do not fit a ``bigint`` fail
the job (ANSI mode) instead of wrapping.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Digits after the point for each currency in use.
CURRENCY_SCALE = {"AUD": 2}

# Fixed value: goods and services tax, 10 %.
GST_RATE = Fraction(1, 10)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _by_currency(currency: Column, value_of) -> Column:
    """A literal chosen by currency code; an unknown code fails the job."""
    chosen = None
    for code, scale in CURRENCY_SCALE.items():
        match = currency == code
        value = F.lit(value_of(scale))
        chosen = F.when(match, value) if chosen is None else chosen.when(match, value)
    unknown = F.raise_error(F.concat(F.lit("unknown currency: "), currency))
    return chosen.otherwise(unknown)


def plus(a: Column, b: Column) -> Column:
    """Exact sum."""
    return a + b


def minus(a: Column, b: Column) -> Column:
    """Exact difference."""
    return a - b


def times(amount: Column, factor: Column) -> Column:
    """Exact product with a whole factor."""
    return amount * factor.cast("bigint")


def negate(amount: Column) -> Column:
    """Additive inverse."""
    return F.negative(amount)


def is_zero(amount: Column) -> Column:
    return amount == 0


def is_positive(amount: Column) -> Column:
    return amount > 0


def is_negative(amount: Column) -> Column:
    return amount < 0


def from_major(major: Column, currency: Column) -> Column:
    """Whole major units (dollars) to minor units (cents)."""
    factor = _by_currency(currency, lambda scale: 10**scale)
    return major.cast("bigint") * factor.cast("bigint")


def format_money(amount: Column, currency: Column) -> Column:
    """Readable form for reports, such as ``AUD -0.05``."""
    factor = _by_currency(currency, lambda scale: 10**scale).cast("bigint")
    digits = _by_currency(currency, lambda scale: scale)
    size = F.abs(amount)
    return F.concat(
        currency,
        F.lit(" "),
        F.when(amount < 0, "-").otherwise(""),
        _div(size, factor).cast("string"),
        F.lit("."),
        F.lpad((size % factor).cast("string"), digits, F.lit("0")),
    )


def half_even_ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator`` as a ``bigint``, ties to the even neighbour.

    Both sides are ``bigint`` and the denominator is positive. The comparison
    is written as ``r > d - r`` because ``2 * r`` could overflow.
    """
    whole = _div(numerator, denominator)
    rest = F.abs(numerator % denominator)
    other = denominator - rest
    odd = whole % 2 != 0
    away = F.when(numerator < 0, F.lit(-1)).otherwise(F.lit(1)).cast("bigint")
    return F.when((rest > other) | ((rest == other) & odd), whole + away).otherwise(whole)


def _wide_cost(x: Column) -> Column:
    """:func:`tier_cost` in 38-digit decimals.

    The remainder is split off first, because decimal division would round once
    at scale 6 before the final rounding.
    """
    units, price, per = (x[c].cast("decimal(19,0)") for c in ("units", "price", "per"))
    product = units * price
    rest = product % per
    whole = (product - rest) / per
    up = (rest * 2 > per) | ((rest * 2 == per) & (whole % 2 == 1))
    return (whole + F.when(up, 1).otherwise(0)).try_cast("bigint")


def _narrow_cost(units: Column, price: Column, per: Column) -> Column:
    """:func:`tier_cost` where ``2 * units * price + per`` fits a ``bigint``."""
    two = F.lit(2).cast("bigint")
    doubled, quantum = units * price * two + per, per * two
    half_up = _div(doubled, quantum)
    tie = (doubled % quantum == 0) & (half_up % 2 == 1)
    return half_up - F.when(tie, F.lit(1)).otherwise(F.lit(0)).cast("bigint")


def _split_cost(x: Column) -> Column:
    """:func:`tier_cost` by long division, for products beyond a ``bigint``.

    With ``units = a * per + b`` and ``price = c * per + e`` the exact cost is
    ``a * price + b * c + b * e / per``. The last product mostly fits a ``bigint`` and is
    a decimal where it doesn't; its quotient always fits, being less than ``e``.
    """
    b, e = x["units"] % x["per"], x["price"] % x["per"]
    parts = F.struct(
        x["per"].alias("per"),
        _div(x["units"], x["per"]).alias("a"),
        x["price"].alias("price"),
        b.alias("b"),
        _div(x["price"], x["per"]).alias("c"),
        e.alias("e"),
    )

    def last(y: Column) -> Column:
        product = y["b"] * y["e"]
        b, e, per = (y[c].cast("decimal(19,0)") for c in ("b", "e", "per"))
        rest = (b * e) % per
        whole = ((b * e - rest) / per).cast("bigint")
        fits_long = y["b"] <= _div(F.lit(2**63 - 1), F.greatest(y["e"], F.lit(1).cast("bigint")))
        return F.when(
            fits_long, F.struct(_div(product, y["per"]).alias("whole"), (product % y["per"]).alias("rest"))
        ).otherwise(F.struct(whole.alias("whole"), rest.cast("bigint").alias("rest")))

    def cost(y: Column, z: Column) -> Column:
        other = y["per"] - z["rest"]
        whole = F.try_add(F.try_add(F.try_multiply(y["a"], y["price"]), F.try_multiply(y["b"], y["c"])), z["whole"])
        up = (z["rest"] > other) | ((z["rest"] == other) & (whole % 2 == 1))
        return F.try_add(whole, F.when(up, F.lit(1)).otherwise(F.lit(0)).cast("bigint"))

    def both(y: Column) -> Column:
        return F.get(F.transform(F.array(last(y)), lambda z: cost(y, z)), F.lit(0))

    return F.get(F.transform(F.array(parts), both), F.lit(0))


def _any_sign_cost(x: Column) -> Column:
    """:func:`tier_cost` for prices and quanta of any sign."""
    two = F.lit(2).cast("bigint")
    doubled = F.try_add(F.try_multiply(F.try_multiply(x["units"], x["price"]), two), x["per"])
    quantum = F.try_multiply(x["per"], two)
    half_up = _div(doubled, quantum)
    tie = (doubled % quantum == 0) & (half_up % 2 == 1)
    narrow = half_up - F.when(tie, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    return F.when(doubled.isNotNull() & quantum.isNotNull(), narrow).otherwise(_wide_cost(x))


def _large_cost(units: Column, unit_price_minor: Column, per_units: Column) -> Column:
    """:func:`tier_cost` of what :func:`_narrow_cost` may not fit.

    Written as a lambda over one element: Spark evaluates it out of line, so the
    generated code of the usual case stays small enough to be compiled.
    """
    def cost(x: Column) -> Column:
        usual = (x["price"] >= 0) & (x["per"] > 0)
        return F.when(usual, _split_cost(x)).otherwise(_any_sign_cost(x))

    args = F.struct(units.alias("units"), unit_price_minor.alias("price"), per_units.alias("per"))
    return F.get(F.transform(F.array(args), cost), F.lit(0))


def try_tier_cost(units: Column, unit_price_minor: Column, per_units: Column) -> Column:
    """:func:`tier_cost`, but null where the cost does not fit a ``bigint``.

    What fits is told by comparisons: an overflow that is caught costs more
    than the arithmetic of a hundred rows.
    """
    units, price, per = (c.cast("bigint") for c in (units, unit_price_minor, per_units))
    room = _div(F.lit(2**61), F.greatest(price, F.lit(1).cast("bigint")))
    narrow = (price >= 0) & per.between(1, 2**62 - 1) & (units <= room)
    return (
        F.when(units <= 0, F.lit(0).cast("bigint"))
        .when(narrow, _narrow_cost(units, price, per))
        .otherwise(_large_cost(units, price, per))
    )


def fits(amount: Column) -> Column:
    """Fail the job where an amount is null because it did not fit a ``bigint``."""
    return F.coalesce(amount, F.raise_error(F.lit("amount exceeds a bigint")).cast("bigint"))


def tier_cost(units: Column, unit_price_minor: Column, per_units: Column) -> Column:
    """Cost of ``units`` at a price per quantum, HALF_EVEN to whole minor units.

    With ``n / d`` the exact cost, ``(2n + d) div 2d`` rounds half up; an exact
    tie leaves no remainder there and steps back from an odd result.
    """
    return fits(try_tier_cost(units, unit_price_minor, per_units))


def gst(net_minor: Column, rate: Fraction = GST_RATE) -> Column:
    """Tax on a net amount, HALF_EVEN to whole minor units."""
    scaled = net_minor
    if rate.numerator != 1:
        scaled = net_minor * F.lit(rate.numerator).cast("bigint")
    return half_even_ratio(scaled, F.lit(rate.denominator).cast("bigint"))


def mixed_currency_groups(df: DataFrame, *keys: str, currency: str = "currency") -> DataFrame:
    """Groups whose amounts are not all in one currency, which must not be added up."""
    return (
        df.groupBy(*keys)
        .agg(
            F.min(currency).alias("first_currency"),
            F.max(currency).alias("last_currency"),
            F.count(F.lit(1)).alias("row_count"),
        )
        .filter(F.col("first_currency") != F.col("last_currency"))
    )
