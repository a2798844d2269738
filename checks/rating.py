"""Queries over metering, rating and money functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import data
from checks.oracle import gst, half_even, iso, iso_us, sql
from checks.registry import query
from tallywork.functions import money as M
from tallywork.operators import metering, rating

READING = (
    f"SELECT 1 AS schema_version, tenant_id, meter_code, dimension_key, "
    f"{iso('window_start')} AS window_start, {iso('window_end')} AS window_end, "
    "quantity, event_count FROM "
)
CHARGE = (
    f"SELECT 1 AS schema_version, charge_id, tenant_id, meter_code, dimension_key, "
    f"{iso('window_start')} AS window_start, {iso('window_end')} AS window_end, "
    "quantity AS quantity_billed, amount_minor, 'AUD' AS currency, plan_version FROM "
)
COORDINATES = ["tenant_id", "meter_code", "window", "dimensions"]


@query(sql(READING + "readings_min", "readings_min"))
def meter_by_minute(spark, sf):
    return data.readings(spark, sf, "1 minute")


@query(sql(READING + "readings", "readings"))
def meter_by_day(spark, sf):
    return data.readings(spark, sf)


@query(sql(READING + "f_readings", "f_readings"))
def meter_freight(spark, sf):
    return data.freight_readings(spark, sf)


def _one_meter(code):
    return sql(READING + f"readings WHERE meter_code = '{code}'", "readings")


@query(_one_meter("llm.tokens.input"))
def meter_sum(spark, sf):
    return data.readings(spark, sf).filter(F.col("meter_code") == "llm.tokens.input")


@query(_one_meter("llm.requests"))
def meter_count(spark, sf):
    return data.readings(spark, sf).filter(F.col("meter_code") == "llm.requests")


@query(_one_meter("storage.gb"))
def meter_max(spark, sf):
    return data.readings(spark, sf).filter(F.col("meter_code") == "storage.gb")


@query(
    sql(
        "SELECT 1 AS schema_version, tenant_id, meter_code, dimension_key, "
        "strftime(ws, '%Y-%m-%dT%H:%M:%SZ') AS window_start, "
        "strftime(ws + INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%SZ') AS window_end, "
        "CAST(CASE meter_code WHEN 'llm.requests' THEN n WHEN 'storage.gb' THEN peak ELSE total END "
        "AS BIGINT) AS quantity, n AS event_count FROM (SELECT tenant_id, meter_code, "
        "dimension_key, date_trunc('hour', received_at) AS ws, count(*) AS n, "
        "max(quantity) AS peak, sum(quantity) AS total FROM clean GROUP BY ALL)",
        "clean",
    )
)
def meter_by_arrival(spark, sf):
    return metering.meter(data.clean(spark, sf), data.meters(spark), "1 hour", "received_at")


@query(
    sql(
        "SELECT count(*) AS readings, count(*) FILTER (quantity < 0 OR event_count < 0) AS faults "
        "FROM readings_min",
        "readings_min",
    )
)
def reading_checks(spark, sf):
    rows = data.readings(spark, sf, "1 minute")
    faults = metering.reading_violations(rows).select(
        *COORDINATES[:3], F.lit(1).alias("fault")
    )
    return rows.select(F.lit(0).alias("fault")).unionByName(faults.select("fault")).agg(
        F.count_if(F.col("fault") == 0).alias("readings"),
        F.count_if(F.col("fault") == 1).alias("faults"),
    )


@query(
    sql(
        "SELECT c.event_id, r.quantity AS reading_quantity, "
        f"{iso('r.window_start')} AS window_start FROM clean c JOIN readings r "
        "USING (tenant_id, meter_code, dimension_key) "
        "WHERE c.occurred_at >= r.window_start AND c.occurred_at < r.window_end",
        "clean",
        "readings",
    )
)
def events_of_readings(spark, sf):
    return metering.events_of_readings(
        data.clean(spark, sf), data.readings(spark, sf), "1 day"
    ).select("event_id", "reading_quantity", "window_start")


@query(
    sql(
        "SELECT r.tenant_id, r.meter_code, p.plan_code, count(*) AS readings FROM readings_min r "
        "JOIN plans p ON r.tenant_id = p.tenant_id GROUP BY ALL",
        "readings_min",
        "plans",
    )
)
def tenant_plan_lookup(spark, sf):
    rows = rating.with_plan(data.readings(spark, sf, "1 minute"), data.tenant_plan(spark))
    return rows.groupBy("tenant_id", "meter_code", "plan_code").agg(
        F.count(F.lit(1)).alias("readings")
    )


@query(
    sql(
        "SELECT r.plan_code, f.meter_code, t.kind AS pricing_type, count(*) AS readings, "
        "CAST(sum(f.quantity) AS BIGINT) AS quantity FROM f_readings f JOIN f_plans r "
        "ON f.tenant_id = r.tenant_id JOIN f_tiers t ON t.plan_code = r.plan_code "
        "AND t.meter_code = f.meter_code AND t.tier_no = 0 GROUP BY ALL",
        "f_readings",
        "f_plans",
        "f_tiers",
    )
)
def price_lookup(spark, sf):
    planned = rating.with_plan(
        data.freight_readings(spark, sf), data.freight_tenant_plan(spark, sf)
    )
    return (
        rating.with_model(planned, data.freight_models(spark))
        .groupBy("plan_code", "meter_code", "pricing_type")
        .agg(F.count(F.lit(1)).alias("readings"), F.sum("quantity").alias("quantity"))
    )


@query(
    sql(
        "SELECT tenant_id, meter_code, 'no_plan' AS reason, count(*) AS readings, "
        "CAST(sum(quantity) AS BIGINT) AS quantity FROM readings "
        "WHERE tenant_id NOT IN (SELECT tenant_id FROM plans) GROUP BY ALL",
        "readings",
        "plans",
    )
)
def unrated_no_plan(spark, sf):
    rows = rating.unrated(data.readings(spark, sf), data.tenant_plan(spark), data.models(spark))
    return rows.groupBy("tenant_id", "meter_code", "reason").agg(
        F.count(F.lit(1)).alias("readings"), F.sum("quantity").alias("quantity")
    )


@query(
    sql(
        "SELECT tenant_id, meter_code, dimension_key, "
        f"{iso('window_start')} AS window_start, quantity, 'unpriced_meter' AS reason "
        "FROM f_readings WHERE meter_code = 'RO'",
        "f_readings",
    )
)
def unrated_unpriced(spark, sf):
    rows = rating.unrated(
        data.freight_readings(spark, sf),
        data.freight_tenant_plan(spark, sf),
        data.freight_models(spark),
    )
    return rows.select(
        "tenant_id",
        "meter_code",
        "dimensions",
        F.col("window.start").alias("window_start"),
        "quantity",
        "reason",
    )


_UNITS = "CAST(l_quantity AS BIGINT) * (l_partkey + 1)"


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, "
    + half_even(f"{_UNITS} * (l_suppkey + 1)", "l_linenumber * 8")
    + " AS cost_minor FROM lineitem"
)
def tier_cost(spark, sf):
    line = data.table(spark, sf, "lineitem")
    cost = M.tier_cost(
        F.col("l_quantity").cast("bigint") * (F.col("l_partkey") + 1),
        F.col("l_suppkey") + 1,
        F.col("l_linenumber").cast("bigint") * 8,
    )
    return line.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cost.alias("cost_minor"))


_BIG = "CAST(l_quantity AS BIGINT) * 90000000000000000"


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, "
    + half_even(f"CAST({_BIG} AS HUGEINT) * (l_partkey + 3)", "(l_partkey * 2 + 900000000000)")
    + " AS cost_minor FROM lineitem"
)
def tier_cost_wide(spark, sf):
    line = data.table(spark, sf, "lineitem")
    cost = M.tier_cost(
        F.col("l_quantity").cast("bigint") * F.lit(90_000_000_000_000_000),
        F.col("l_partkey") + 3,
        F.col("l_partkey") * 2 + F.lit(900_000_000_000),
    )
    return line.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cost.alias("cost_minor"))


def _by_kind(kind):
    need = sql(
        f"SELECT c.charge_id, c.quantity AS quantity_billed, c.amount_minor FROM f_charges c "
        f"JOIN f_plans p ON c.tenant_id = p.tenant_id JOIN f_tiers t ON t.plan_code = p.plan_code "
        f"AND t.meter_code = c.meter_code AND t.tier_no = 0 WHERE t.kind = '{kind}'",
        "f_charges",
        "f_plans",
        "f_tiers",
    )
    return need


def _charges_of_kind(spark, sf, kind):
    models = data.freight_models(spark).filter(F.col("pricing_type") == kind)
    return rating.rate(
        data.freight_readings(spark, sf), data.freight_tenant_plan(spark, sf), models
    ).select("charge_id", "quantity_billed", "amount_minor")


@query(_by_kind("FLAT"))
def flat_pricing(spark, sf):
    return _charges_of_kind(spark, sf, "FLAT")


@query(_by_kind("TIERED"))
def tiered_pricing(spark, sf):
    return _charges_of_kind(spark, sf, "TIERED")


@query(_by_kind("VOLUME"))
def volume_pricing(spark, sf):
    return _charges_of_kind(spark, sf, "VOLUME")


@query(sql(CHARGE + "charges", "charges"))
def rate_events(spark, sf):
    return data.charges(spark, sf)


@query(sql(CHARGE + "f_charges", "f_charges"))
def rate_freight(spark, sf):
    return data.freight_charges(spark, sf)


@query(sql("SELECT charge_id, count(*) AS copies FROM f_charges GROUP BY ALL", "f_charges"))
def charge_ids(spark, sf):
    return data.freight_charges(spark, sf).groupBy("charge_id").agg(
        F.count(F.lit(1)).alias("copies")
    )


@query(
    sql(
        "SELECT plan_code, 1 AS plan_version, meter_code, tier_no, up_to, next_up_to, violation "
        "FROM (SELECT *, CASE WHEN per_units < 1 THEN 'per_units_below_one' "
        "WHEN unit_price_minor < 0 THEN 'negative_price' WHEN up_to < 0 THEN 'negative_limit' "
        "WHEN has_next IS NULL AND up_to IS NOT NULL THEN 'last_tier_bounded' "
        "WHEN has_next IS NOT NULL AND up_to IS NULL THEN 'unbounded_before_last' "
        "WHEN has_next IS NOT NULL AND next_up_to <= up_to THEN 'limits_not_increasing' END "
        "AS violation FROM ladder) WHERE violation IS NOT NULL",
        "ladder",
    )
)
def ladder_violations(spark, sf):
    return rating.ladder_violations(data.plan_documents(spark, sf))


def _rerated(version):
    from checks.oracle import charge_text, uuid3

    return sql(
        f"SELECT c.tenant_id, c.meter_code, c.dimension_key, {iso('window_start')} AS window_start, "
        f"{iso('window_end')} AS window_end, c.charge_id AS old_charge_id, "
        f"{uuid3(charge_text(str(version)))} AS new_charge_id, {version} = 1 AS same_id, "
        "CAST(0 AS BIGINT) AS delta_minor FROM charges c",
        "charges",
    )


def _rerate(spark, sf, version):
    old, new = data.charges(spark, sf), data.charges(spark, sf, version=version)
    return rating.rerating_report(old, new).select(
        "tenant_id", "meter_code", "dimension_key", "window", "old_charge_id", "new_charge_id",
        "same_id", "delta_minor",
    )


@query(_rerated(1))
def rerate_same_version(spark, sf):
    return _rerate(spark, sf, 1)


@query(_rerated(2))
def rerate_new_version(spark, sf):
    return _rerate(spark, sf, 2)


_TOTAL = "CAST(round(o_totalprice * 100) AS BIGINT)"


def _orders(spark, sf):
    return data.table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("minor")
    )


@query(
    f"SELECT o_orderkey, {_TOTAL} + o_custkey AS plus_minor, {_TOTAL} - 50000000 AS minus_minor "
    "FROM orders"
)
def money_plus_minus(spark, sf):
    minor, other = F.col("minor"), F.lit(50_000_000).cast("bigint")
    return _orders(spark, sf).select(
        "o_orderkey",
        M.plus(minor, F.col("o_custkey")).alias("plus_minor"),
        M.minus(minor, other).alias("minus_minor"),
    )


@query(f"SELECT o_orderkey, {_TOTAL} * o_custkey AS scaled_minor FROM orders")
def money_times(spark, sf):
    return _orders(spark, sf).select(
        "o_orderkey", M.times(F.col("minor"), F.col("o_custkey")).alias("scaled_minor")
    )


@query(f"SELECT o_orderkey, -{_TOTAL} AS negated_minor FROM orders")
def money_negate(spark, sf):
    return _orders(spark, sf).select("o_orderkey", M.negate(F.col("minor")).alias("negated_minor"))


_BALANCE = "CAST(round(c_acctbal * 100) AS BIGINT)"


def _customers(spark, sf):
    return data.table(spark, sf, "customer").select(
        "c_custkey",
        F.round(F.col("c_acctbal") * 100).cast("bigint").alias("minor"),
        F.lit("AUD").alias("currency"),
    )


@query(
    f"SELECT c_custkey, {_BALANCE} = 0 AS is_zero, {_BALANCE} > 0 AS is_positive, "
    f"{_BALANCE} < 0 AS is_negative FROM customer"
)
def money_sign(spark, sf):
    minor = F.col("minor")
    return _customers(spark, sf).select(
        "c_custkey",
        M.is_zero(minor).alias("is_zero"),
        M.is_positive(minor).alias("is_positive"),
        M.is_negative(minor).alias("is_negative"),
    )


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, "
    "CAST(l_quantity AS BIGINT) * 100 AS minor FROM lineitem"
)
def money_from_major(spark, sf):
    line = data.table(spark, sf, "lineitem")
    minor = M.from_major(F.col("l_quantity").cast("bigint"), F.lit("AUD"))
    return line.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", minor.alias("minor"))


@query(
    f"SELECT c_custkey, 'AUD ' || CASE WHEN {_BALANCE} < 0 THEN '-' ELSE '' END || "
    f"(abs({_BALANCE}) // 100) || '.' || lpad(CAST(abs({_BALANCE}) % 100 AS VARCHAR), 2, '0') "
    "AS amount FROM customer"
)
def money_format(spark, sf):
    return _customers(spark, sf).select(
        "c_custkey", M.format_money(F.col("minor"), F.col("currency")).alias("amount")
    )


@query(
    "SELECT o_custkey, min(CASE WHEN o_orderpriority = '1-URGENT' THEN 'NZD' ELSE 'AUD' END) "
    "AS first_currency, max(CASE WHEN o_orderpriority = '1-URGENT' THEN 'NZD' ELSE 'AUD' END) "
    "AS last_currency, count(*) AS row_count FROM orders GROUP BY o_custkey HAVING "
    "count(DISTINCT o_orderpriority = '1-URGENT') > 1"
)
def mixed_currencies(spark, sf):
    rows = data.table(spark, sf, "orders").select(
        "o_custkey",
        F.when(F.col("o_orderpriority") == "1-URGENT", "NZD").otherwise("AUD").alias("currency"),
    )
    return M.mixed_currency_groups(rows, "o_custkey")


@query(f"SELECT o_orderkey, {_TOTAL} AS net_minor, {gst(_TOTAL)} AS tax_minor FROM orders")
def tax(spark, sf):
    return _orders(spark, sf).select(
        "o_orderkey",
        F.col("minor").alias("net_minor"),
        M.gst(F.col("minor")).alias("tax_minor"),
    )


@query(
    sql(
        "SELECT event_id, tenant_id, meter_code, dimension_key, "
        f"{iso_us('occurred_at')} AS occurred_at FROM clean",
        "clean",
    )
)
def group_coordinates(spark, sf):
    rows = metering.dimension_keys(data.clean(spark, sf))
    return rows.select("event_id", "tenant_id", "meter_code", "dimension_key", "occurred_at")
