"""The SQL side of the correctness check: the same tables and results for DuckDB.

Each statement is put together from named common table expressions; ``sql``
adds the ones a statement needs, in order.
"""

from __future__ import annotations

from checks.data import FREIGHT_METERS, PRICING, SEGMENTS, T1, T2, T3, T9
from tallywork.plans import standard


def half_even(n: str, d: str) -> str:
    """Integer division with ties to even, for non-negative numerators."""
    n, d = f"CAST({n} AS HUGEINT)", f"CAST({d} AS HUGEINT)"
    return (
        f"CAST(({n} // {d}) + CASE WHEN 2 * ({n} % {d}) > {d} "
        f"OR (2 * ({n} % {d}) = {d} AND ({n} // {d}) % 2 = 1) THEN 1 ELSE 0 END AS BIGINT)"
    )


def gst(n: str) -> str:
    return half_even(n, "10")


def uuid3(text: str) -> str:
    h = f"md5({text})"
    return (
        f"(substr({h},1,8)||'-'||substr({h},9,4)||'-3'||substr({h},14,3)||'-'"
        f"||substr('89ab',(instr('0123456789abcdef',substr({h},17,1))-1)%4+1,1)"
        f"||substr({h},18,3)||'-'||substr({h},21,12))"
    )


def iso(t: str) -> str:
    """Whole seconds only, which windows and periods are."""
    return f"strftime({t}, '%Y-%m-%dT%H:%M:%SZ')"


def iso_us(t: str) -> str:
    """Any instant: no, three or six fraction digits."""
    return (
        f"(CASE WHEN epoch_us({t}) % 1000000 = 0 THEN {iso(t)} "
        f"WHEN epoch_us({t}) % 1000 = 0 THEN strftime({t}, '%Y-%m-%dT%H:%M:%S.') "
        f"|| lpad(CAST((epoch_us({t}) % 1000000) // 1000 AS VARCHAR), 3, '0') || 'Z' "
        f"ELSE strftime({t}, '%Y-%m-%dT%H:%M:%S.') "
        f"|| lpad(CAST(epoch_us({t}) % 1000000 AS VARCHAR), 6, '0') || 'Z' END)"
    )


def window_start(ts: str, seconds: int) -> str:
    return f"make_timestamp((epoch_us({ts}) // {seconds * 1000000}) * {seconds * 1000000})"


def account_id(kind: str, tenant: str = "tenant_id") -> str:
    return uuid3(f"{tenant}||'|'||{kind}||'|AUD'")


def _tier_rows() -> str:
    rows = []
    for code, plan in standard.PRICE_PLANS.items():
        for meter, cfg in plan["meters"].items():
            low = 0
            for i, t in enumerate(cfg["tiers"]):
                up = "NULL" if t["up_to"] is None else t["up_to"]
                rows.append(
                    f"('{code}','{meter}','{cfg['type']}',{i},{low},{up},"
                    f"{t['unit_price_minor']},{t['per_units']})"
                )
                low = t["up_to"]
    return ",".join(rows)


def _freight_tier_rows() -> str:
    rows = []
    for s, segment in enumerate(SEGMENTS):
        for m, meter in enumerate(FREIGHT_METERS):
            kind = PRICING[(s + m) % 3]
            for i, (low, up, unit, per) in enumerate(
                [
                    (0, 20 + s, 700 + 13 * m, 3),
                    (20 + s, 60 + s, 600 + 11 * m, 4),
                    (60 + s, "NULL", 500 + 7 * m, 7),
                ]
            ):
                rows.append(f"('{segment}','{meter}','{kind}',{i},{low},{up},{unit},{per},{1 + s})")
    return ",".join(rows)


def _priced(readings: str, tiers: str, plans: str, version: str) -> str:
    """Price readings tier by tier and add the blocks up."""
    units = (
        "CASE t.kind WHEN 'FLAT' THEN (CASE WHEN t.tier_no = 0 THEN r.quantity ELSE 0 END) "
        "WHEN 'TIERED' THEN greatest(0, least(r.quantity, coalesce(t.up_to, r.quantity)) - t.low) "
        "ELSE (CASE WHEN (t.tier_no = 0 OR r.quantity > t.low) "
        "AND (t.up_to IS NULL OR r.quantity <= t.up_to) THEN r.quantity ELSE 0 END) END"
    )
    return (
        f"SELECT r.tenant_id, r.meter_code, r.dimension_key, r.window_start, r.window_end, "
        f"r.quantity, r.event_count, {version} AS plan_version, "
        f"CAST(sum({half_even('(' + units + ') * CAST(t.unit AS HUGEINT)', 't.per')}) AS BIGINT) "
        f"AS amount_minor FROM {readings} r JOIN {plans} p ON r.tenant_id = p.tenant_id "
        f"JOIN {tiers} t ON p.plan_code = t.plan_code AND r.meter_code = t.meter_code "
        f"GROUP BY ALL"
    )


def _readings(events: str, seconds: int, measured: str) -> str:
    ws = window_start("occurred_at", seconds)
    return (
        f"SELECT tenant_id, meter_code, dimension_key, window_start, "
        f"window_start + INTERVAL {seconds} SECOND AS window_end, "
        f"CAST({measured} AS BIGINT) AS quantity, event_count FROM ("
        f"SELECT tenant_id, meter_code, dimension_key, {ws} AS window_start, "
        f"sum(quantity) AS total, max(quantity) AS peak, count(*) AS event_count "
        f"FROM {events} GROUP BY ALL)"
    )


def charge_text(version: str = "plan_version") -> str:
    dims = "CASE WHEN dimension_key = '' THEN '' ELSE dimension_key || ';' END"
    return (
        f"tenant_id||'|'||meter_code||'|'||{iso('window_start')}||'|'||{iso('window_end')}"
        f"||'|'||{dims}||'|'||CAST({version} AS VARCHAR)"
    )


E_MEASURED = (
    "CASE meter_code WHEN 'llm.requests' THEN event_count WHEN 'storage.gb' THEN peak "
    "ELSE total END"
)
F_MEASURED = "CASE meter_code WHEN 'NF' THEN event_count WHEN 'AO' THEN peak ELSE total END"
DAY_US = 86_400_000_000

CTES: dict[str, tuple[str, tuple[str, ...]]] = {}


def _cte(name: str, body: str, *needs: str) -> None:
    CTES[name] = (body, needs)


_cte(
    "req0",
    "SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events",
)
_cte(
    "req",
    "SELECT user_id || ':' || strftime(ts, '%Y-%m-%d') AS request_id, event_id, "
    "'key-' || (user_id % 6) AS api_key, "
    "user_id || ':' || event_type || ':' || (k // 20) AS idempotency_key, "
    "CASE event_type WHEN 'click' THEN 'llm.tokens.input' WHEN 'view' THEN 'llm.tokens.output' "
    "WHEN 'purchase' THEN 'llm.requests' WHEN 'signup' THEN 'storage.gb' "
    "ELSE 'no.such.meter' END AS meter_code, "
    "CAST(round(value * 1000) AS BIGINT) - 500 AS quantity, "
    "CASE WHEN k < 10 THEN '' ELSE 'model=' || CASE WHEN k % 2 = 0 THEN 'small' ELSE 'large' END "
    "|| ';region=' || CASE WHEN k % 3 = 0 THEN 'ap-southeast-2' ELSE 'us-east-1' END END "
    "AS dimension_key, "
    "ts + to_seconds(k * 4 - 60) AS occurred_at, "
    "ts + to_seconds(event_id % 120) AS received_at FROM req0",
    "req0",
)
_cte(
    "resolved",
    f"SELECT *, CASE api_key WHEN 'key-0' THEN '{T1}' WHEN 'key-1' THEN '{T1}' "
    f"WHEN 'key-2' THEN '{T2}' WHEN 'key-3' THEN '{T3}' WHEN 'key-4' THEN '{T9}' END AS tenant_id "
    f"FROM req",
    "req",
)
_cte(
    "checked",
    "SELECT *, CASE WHEN tenant_id IS NULL THEN 'unauthorized' "
    "WHEN quantity < 0 THEN 'validation_failed' WHEN meter_code = 'no.such.meter' "
    "OR occurred_at > received_at + INTERVAL 5 MINUTE THEN 'invalid_event' END AS reject_reason "
    "FROM resolved",
    "resolved",
)
_cte("clean", "SELECT * FROM checked WHERE reject_reason IS NULL", "checked")
_cte(
    "arrivals",
    "SELECT event_id, tenant_id, idempotency_key, "
    "CAST(epoch_us(received_at) AS HUGEINT) * 1000000000 + event_id AS pos FROM clean",
    "clean",
)
_cte(
    "next_ok",
    "SELECT a.event_id, arg_min(b.event_id, b.pos) AS next_id FROM arrivals a JOIN arrivals b "
    "ON a.tenant_id = b.tenant_id AND a.idempotency_key = b.idempotency_key "
    f"AND (a.pos // 1000000000 + {DAY_US}) * 1000000000 <= b.pos GROUP BY a.event_id",
    "arrivals",
)
_cte(
    "chain",
    "SELECT arg_min(event_id, pos) AS event_id FROM arrivals GROUP BY tenant_id, idempotency_key "
    "UNION ALL SELECT n.next_id FROM chain c JOIN next_ok n ON c.event_id = n.event_id",
    "next_ok",
)
_cte(
    "outcomes",
    "SELECT x.*, CASE WHEN x.reject_reason IS NOT NULL THEN 'rejected' "
    "WHEN c.event_id IS NULL THEN 'deduplicated' ELSE 'accepted' END AS outcome "
    "FROM checked x LEFT JOIN chain c ON x.event_id = c.event_id",
    "checked",
    "chain",
)
_cte("accepted", "SELECT * FROM outcomes WHERE outcome = 'accepted'", "outcomes")
for _name, _events, _seconds in [
    ("readings", "clean", 86400),
    ("readings_min", "clean", 60),
    ("readings_acc", "accepted", 86400),
]:
    _cte(_name, _readings(_events, _seconds, E_MEASURED), _events)
_cte(
    "plans",
    f"SELECT * FROM (VALUES ('{T1}','standard'),('{T2}','growth'),('{T3}','standard')) "
    f"v(tenant_id, plan_code)",
)
_cte(
    "tiers",
    f"SELECT * FROM (VALUES {_tier_rows()}) v(plan_code, meter_code, kind, tier_no, low, up_to, "
    f"unit, per)",
)
_cte(
    "tenants",
    f"SELECT * FROM (VALUES ('{T1}','Acme'),('{T2}','Globex'),('{T3}','Initech'),"
    f"('{T9}','Umbrella')) v(id, name)",
)
for _name, _source in [("priced", "readings"), ("priced_acc", "readings_acc")]:
    _cte(_name, _priced(_source, "tiers", "plans", "1"), _source, "plans", "tiers")
for _name, _source in [("charges", "priced"), ("charges_acc", "priced_acc")]:
    _cte(
        _name,
        f"SELECT {uuid3(charge_text())} AS charge_id, *, {gst('amount_minor')} AS tax_minor "
        f"FROM {_source}",
        _source,
    )
_cte(
    "freight",
    "SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS idempotency_key, "
    "CAST(o_custkey AS VARCHAR) AS tenant_id, l_returnflag || l_linestatus AS meter_code, "
    "CAST(l_quantity AS BIGINT) AS quantity, 'priority=' || o_orderpriority AS dimension_key, "
    "l_shipdate AS occurred_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
)
_cte("f_readings", _readings("freight", 7 * 86400, F_MEASURED), "freight")
_cte(
    "f_plans",
    "SELECT CAST(c_custkey AS VARCHAR) AS tenant_id, c_mktsegment AS plan_code FROM customer",
)
_cte(
    "f_tiers",
    f"SELECT * FROM (VALUES {_freight_tier_rows()}) v(plan_code, meter_code, kind, tier_no, low, "
    f"up_to, unit, per, version)",
)
_cte(
    "f_priced",
    _priced("f_readings", "f_tiers", "f_plans", "max(t.version)"),
    "f_readings",
    "f_plans",
    "f_tiers",
)
_cte(
    "f_charges",
    f"SELECT {uuid3(charge_text())} AS charge_id, *, {gst('amount_minor')} AS tax_minor "
    f"FROM f_priced",
    "f_priced",
)
for _name, _source in [("lines", "charges"), ("lines_acc", "charges_acc"), ("f_lines", "f_charges")]:
    _cte(
        _name,
        "SELECT charge_id AS transaction_id, tenant_id, 1 AS line_no, 'DEBIT' AS direction, "
        f"'RECEIVABLE' AS account_type, amount_minor + tax_minor AS amount_minor, window_start FROM {_source} "
        "UNION ALL SELECT charge_id, tenant_id, 2, 'CREDIT', 'REVENUE', amount_minor, window_start "
        f"FROM {_source} "
        "UNION ALL SELECT charge_id, tenant_id, 3, 'CREDIT', 'TAX', tax_minor, window_start "
        f"FROM {_source}",
        _source,
    )
_cte(
    "f_invoices",
    "SELECT tenant_id, strftime(window_start, '%Y-%m') AS period, "
    "CAST(sum(amount_minor) AS BIGINT) AS net_minor, CAST(sum(tax_minor) AS BIGINT) AS posted_tax, "
    "count(*) AS charge_count FROM f_charges GROUP BY ALL",
    "f_charges",
)
_cte(
    "e_invoices",
    "SELECT t.id AS tenant_id, coalesce(CAST(sum(c.amount_minor) AS BIGINT), 0) AS net_minor, "
    "coalesce(CAST(sum(c.tax_minor) AS BIGINT), 0) AS posted_tax FROM tenants t "
    "LEFT JOIN charges c ON c.tenant_id = t.id AND c.window_start >= TIMESTAMP '2024-01-01' "
    "AND c.window_start < TIMESTAMP '2024-02-01' GROUP BY ALL",
    "tenants",
    "charges",
)
_cte(
    "ladder",
    "SELECT 'order-' || l_orderkey AS plan_code, l_returnflag AS meter_code, "
    "CASE WHEN min(l_linestatus) OVER (PARTITION BY l_orderkey, l_returnflag) = 'O' "
    "THEN 'TIERED' ELSE 'VOLUME' END AS pricing_type, "
    "CAST(row_number() OVER w - 1 AS INTEGER) AS tier_no, "
    "CASE WHEN l_discount > 0.04 THEN CAST(l_quantity AS BIGINT) - 1 END AS up_to, "
    "CAST(round(l_tax * 100) AS BIGINT) AS unit_price_minor, "
    "CAST(l_linenumber AS BIGINT) AS per_units, "
    "lag(CASE WHEN l_discount > 0.04 THEN CAST(l_quantity AS BIGINT) - 1 END) OVER w AS prev_up, "
    "lead(CASE WHEN l_discount > 0.04 THEN CAST(l_quantity AS BIGINT) - 1 END) OVER w AS next_up_to, "
    "lead(1) OVER w AS has_next FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_returnflag "
    "ORDER BY l_linenumber, l_partkey, l_suppkey)",
)
_cte(
    "req_log",
    "SELECT event_id, ts, event_type AS application, "
    "CASE WHEN user_id % 2 = 0 THEN 'threads' ELSE 'reactive' END AS gateway, "
    "CAST(500 * (k % 4 + 1) AS INTEGER) AS target_rate, "
    "CASE WHEN k >= 97 THEN 429 WHEN k >= 95 THEN 503 ELSE 202 END AS status, "
    "value AS latency_ms FROM req0",
    "req0",
)
_cte(
    "samples",
    "SELECT event_id AS sample_id, ts, event_type AS application, "
    "'client-' || (user_id % 10) AS client_id, CAST(user_id AS VARCHAR) AS topic_partition, "
    "CAST(k AS BIGINT) AS value FROM req0",
    "req0",
)


def sql(body: str, *needs: str) -> str:
    """A full statement: ``body`` with the common table expressions it needs.

    A body that starts with a comma goes on with expressions of its own.
    """
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for need in CTES[name][1]:
            visit(need)
        order.append(name)

    for name in needs:
        visit(name)
    if not order:
        return body
    named = ", ".join(f"{n} AS ({CTES[n][0]})" for n in order)
    return f"WITH RECURSIVE {named}{'' if body.startswith(',') else ' '}{body}"
