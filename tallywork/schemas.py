"""Table schemas, one ``StructType`` per table.

Money is a ``bigint`` count of minor units next to a currency code, never a
floating-point number. Times are UTC timestamps. Identifiers are strings.
"""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, TS = T.StringType(), T.LongType(), T.IntegerType(), T.TimestampType()
DIMENSIONS = T.MapType(S, S)
WINDOW = T.StructType([T.StructField("start", TS), T.StructField("end", TS)])


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


USAGE_REQUEST = _table(
    request_id=S, event_id=L, api_key=S, idempotency_key=S, meter_code=S, quantity=L,
    dimensions=DIMENSIONS, occurred_at=TS, received_at=TS,
)
USAGE_EVENT = _table(
    schema_version=I, idempotency_key=S, tenant_id=S, meter_code=S, quantity=L,
    dimensions=DIMENSIONS, occurred_at=TS, received_at=TS,
)
METER_READING = _table(
    schema_version=I, tenant_id=S, meter_code=S, window=WINDOW, quantity=L,
    event_count=L, dimensions=DIMENSIONS,
)
PRICE_TIER = _table(
    plan_code=S, plan_version=I, currency=S, meter_code=S, pricing_type=S, tier_no=I,
    lower_bound=L, up_to=L, unit_price_minor=L, per_units=L,
)
TENANT_PLAN = _table(tenant_id=S, plan_code=S)
METER_CATALOG = _table(meter_code=S, aggregation=S)
API_KEY = _table(api_key_hash=S, tenant_id=S)
CHARGE = _table(
    schema_version=I, charge_id=S, tenant_id=S, meter_code=S, window=WINDOW,
    dimensions=DIMENSIONS, quantity_billed=L, amount_minor=L, currency=S, plan_version=I,
)

TENANT = _table(id=S, name=S, status=S, plan_code=S, created_at=TS)
LEDGER_ACCOUNT = _table(id=S, tenant_id=S, type=S, currency=S, created_at=TS)
LEDGER_TRANSACTION = _table(
    id=S, tenant_id=S, description=S, source_charge_id=S, created_at=TS,
)
LEDGER_ENTRY = _table(
    transaction_id=S, line_no=I, tenant_id=S, account_id=S, account_type=S, direction=S,
    amount_minor=L, currency=S, created_at=TS,
)
ACCOUNT_BALANCE = _table(
    account_id=S, tenant_id=S, balance_minor=L, currency=S, updated_at=TS,
)
BILLED_CHARGE = _table(
    charge_id=S, tenant_id=S, meter_code=S, window_start=TS, window_end=TS,
    quantity_billed=L, amount_minor=L, currency=S, plan_version=I, created_at=TS,
)
INVOICE = _table(
    id=S, tenant_id=S, period_start=TS, period_end=TS, currency=S,
    total_minor=L, tax_minor=L, status=S, created_at=TS,
)
INVOICE_LINE = _table(
    invoice_id=S, tenant_id=S, meter_code=S, quantity=L, amount_minor=L, currency=S,
)
INVOICE_CHARGE_LINK = _table(charge_id=S, invoice_id=S)
OUTBOX = _table(
    id=S, tenant_id=S, aggregate_type=S, aggregate_id=S, event_type=S, payload=S,
    created_at=TS,
)
PUBLISHED_LOG = _table(id=S, published_at=TS)
SIGHTING = _table(tenant_id=S, idempotency_key=S, at_us=L, tie=S)
SIGHTING_FILTER = _table(block=I, bits=T.BinaryType(), blocks=I)
BUCKET_LEVEL = _table(tenant_id=S, level=L, us=L)

INVOICE_CREATED = _table(
    schema_version=I, invoice_id=S, tenant_id=S, period_start=TS, period_end=TS,
    net_minor=L, tax_minor=L, total_minor=L, currency=S,
)

# The only schema version in use, account types, entry directions.
SCHEMA_VERSION = 1
ACCOUNT_TYPES = ("RECEIVABLE", "REVENUE", "CREDITS", "TAX")
DIRECTIONS = ("DEBIT", "CREDIT")
PRICING_TYPES = ("FLAT", "TIERED", "VOLUME")
AGGREGATIONS = ("SUM", "COUNT", "MAX")
