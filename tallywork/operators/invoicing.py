"""Invoices, their reconciliation with the ledger, and the audit trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywork import schemas
from tallywork.functions.keys import entries_key, natural_id, packed_id, sorted_entries, unpacked_id
from tallywork.functions.money import gst
from tallywork.functions.windows import in_window, period_end, period_of, period_start
from tallywork.operators.metering import keyed_events
from tallywork.operators.posting import signed_amount
from tallywork.sources.wire import encode_value

# Fixed value: the status of a new invoice.
GENERATED = "GENERATED"
DEFAULT_CURRENCY = "AUD"


def in_period(charges: DataFrame, period: str | None = None) -> DataFrame:
    """Add each charge's period, decided by its window start alone, and keep one period."""
    if period is None:
        return charges.withColumn("period", period_of(F.col("window_start")))
    start, end = period_start(F.lit(period)), period_end(F.lit(period))
    inside = (F.col("window_start") >= start) & (F.col("window_start") < end)
    return charges.filter(inside).withColumn("period", F.lit(period))


def uninvoiced(charges: DataFrame, links: DataFrame, period: str | None = None) -> DataFrame:
    """Charges of the period that no invoice has taken yet."""
    return in_period(charges, period).join(links.select("charge_id"), "charge_id", "left_anti")


def invoice_id(tenant_id: Column, period: Column, run: int, currency: Column) -> Column:
    """Invoice identifier: the same run repeated gives the same id.

    An invoice in another than the default currency has it in its id. The text is
    chosen, not the id: Spark would hash anew for each part of an id in a branch.
    """
    foreign = F.when(currency != DEFAULT_CURRENCY, currency)
    return natural_id(tenant_id, period, F.lit(run), foreign)


def invoice_lines(charges: DataFrame) -> DataFrame:
    """Quantity and amount per tenant, period, currency and meter."""
    return charges.groupBy("tenant_id", "period", "currency", "meter_code").agg(
        F.sum("quantity_billed").alias("quantity"), F.sum("amount_minor").alias("amount_minor")
    )


def due_invoices(
    tenants: DataFrame,
    periods: list[str],
    currency: str = DEFAULT_CURRENCY,
    lines: DataFrame | None = None,
) -> DataFrame:
    """Every tenant with every period of the run; a tenant without charges is invoiced too.

    With the ``lines`` to invoice, each of their currencies gets an invoice of its own.
    """
    each = F.explode(F.array(*[F.lit(p) for p in periods]))
    due = tenants.select(
        F.col("id").alias("tenant_id"), each.alias("period"), F.lit(currency).alias("currency")
    )
    if lines is None:
        return due
    return due.union(lines.select("tenant_id", "period", "currency")).distinct()


def invoices(
    lines: DataFrame, due: DataFrame | None = None, run: int = 1, with_lines: bool = False
) -> DataFrame:
    """Invoice headers: net, tax on the net total, and their sum.

    ``due`` lists the (tenant_id, period, currency) to invoice; one without lines
    gets an empty invoice. Without ``due``, what has lines is invoiced, which needs no
    join. ``with_lines`` nests the lines, one per meter.
    """
    zero = F.lit(0).cast("bigint")
    nested = F.struct("meter_code", "quantity", "amount_minor")
    aggregates = [F.sum("amount_minor").alias("net")]
    if with_lines:
        aggregates.append(F.array_sort(F.collect_list(nested)).alias("lines"))
    keys = ["tenant_id", "period", "currency"]
    totals = lines.groupBy(*keys).agg(*aggregates)
    headers = (
        (totals if due is None else due.join(totals, keys, "left"))
        .withColumn("net_minor", F.coalesce("net", zero))
        .withColumn("tax_minor", gst(F.col("net_minor")))
        .select(
            invoice_id(F.col("tenant_id"), F.col("period"), run, F.col("currency")).alias("id"),
            "tenant_id",
            "period",
            period_start(F.col("period")).alias("period_start"),
            period_end(F.col("period")).alias("period_end"),
            "currency",
            "net_minor",
            "tax_minor",
            (F.col("net_minor") + F.col("tax_minor")).alias("total_minor"),
            F.lit(GENERATED).alias("status"),
            *(["lines"] if with_lines else []),
        )
    )
    if with_lines:
        empty = F.array().cast(headers.schema["lines"].dataType)
        headers = headers.withColumn("lines", F.coalesce("lines", empty))
    return headers


def charge_links(charges: DataFrame, run: int = 1) -> DataFrame:
    """Which invoice took which charge."""
    return charges.select(
        "charge_id",
        invoice_id(F.col("tenant_id"), F.col("period"), run, F.col("currency")).alias("invoice_id"),
    )


def invoice_events(headers: DataFrame) -> DataFrame:
    """The ``invoice.created`` event of each invoice, keyed by invoice, as JSON text."""
    event = headers.select(
        F.lit(schemas.SCHEMA_VERSION).alias("schema_version"),
        F.col("id").alias("invoice_id"),
        "tenant_id",
        "period_start",
        "period_end",
        "net_minor",
        "tax_minor",
        "total_minor",
        "currency",
    )
    return event.select(
        "invoice_id", "tenant_id", encode_value(schemas.INVOICE_CREATED).alias("payload")
    )


def reconcile(links: DataFrame, entries: DataFrame, headers: DataFrame) -> DataFrame:
    """Compare each invoice with what the ledger posted for its charges.

    The tax may differ: the ledger rounds it per charge, the invoice on its
    total. Entries are summed per transaction before the join, most of them in the
    task that reads them, so it meets one row per charge from either side. Ids, the
    widest of what is shuffled here, are shuffled as bytes.
    """
    wanted = entries.filter(F.col("account_type").isin("REVENUE", "TAX")).select(
        packed_id(F.col("transaction_id")).alias("charge"), "account_type", signed_amount().alias("signed")
    )
    of_type = lambda kind: F.when(F.col("account_type") == kind, -F.col("signed")).otherwise(0)
    by_charge = wanted.groupBy("charge").agg(
        F.sum(of_type("REVENUE")).alias("revenue"), F.sum(of_type("TAX")).alias("tax")
    )
    taken = links.select(
        packed_id(F.col("charge_id")).alias("charge"), packed_id(F.col("invoice_id")).alias("invoice")
    )
    posted = (
        taken.join(by_charge, "charge")
        .groupBy("invoice")
        .agg(F.sum("revenue").alias("revenue"), F.sum("tax").alias("tax"))
    )
    zero = F.lit(0).cast("bigint")
    return (
        headers.select(packed_id(F.col("id")).alias("invoice"), "tenant_id", "net_minor", "tax_minor")
        .join(posted, "invoice", "left")
        .select(
            unpacked_id(F.col("invoice")).alias("invoice_id"),
            "tenant_id",
            "net_minor",
            F.coalesce("revenue", zero).alias("posted_revenue_minor"),
            "tax_minor",
            F.coalesce("tax", zero).alias("posted_tax_minor"),
            (F.col("net_minor") - F.coalesce("revenue", zero)).alias("net_difference_minor"),
            (F.col("tax_minor") - F.coalesce("tax", zero)).alias("tax_difference_minor"),
        )
    )


def audit_trace(
    links: DataFrame,
    charges: DataFrame,
    events: DataFrame,
    window: str,
    event_time: str = "occurred_at",
) -> DataFrame:
    """From each invoiced charge down to the events in its window.

    ``charges`` are rated charges with their window and dimensions, ``events`` the
    accepted events they were metered from. Charges and links have one row per
    charge, so a dominant charge is heavy on the event side only, which AQE splits.
    """
    entries = sorted_entries(F.col("dimensions"))
    billed = charges.join(links, "charge_id").select(
        "invoice_id",
        "charge_id",
        "tenant_id",
        "meter_code",
        entries.alias("entries"),
        F.col("window.start").alias("window_start"),
        "window",
        "quantity_billed",
        "amount_minor",
    )
    keyed = keyed_events(events, window, event_time).select(
        "tenant_id",
        "meter_code",
        "entries",
        F.col("window.start").alias("window_start"),
        "idempotency_key",
        F.col("quantity").alias("event_quantity"),
        event_time,
    )
    return (
        keyed.join(billed, ["tenant_id", "meter_code", "entries", "window_start"])
        .filter(in_window(F.col(event_time), F.col("window")))
        .withColumn("dimension_key", entries_key(F.col("entries")))
        .drop("entries", "window")
    )
