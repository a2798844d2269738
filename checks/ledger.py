"""Queries over posting, the ledger, invoices and the outbox."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import data
from checks.data import JANUARY, T1, T3
from checks.oracle import account_id, gst, iso, sql, uuid3
from checks.registry import query
from tallywork.operators import invoicing, ledger, metering, outbox, posting, rating
from tallywork.plans.billing import Book, book_of
from tallywork.session import staged

SIGNED = "CAST(sum(CASE WHEN direction = 'DEBIT' THEN amount_minor ELSE -amount_minor END) AS BIGINT)"
DESCRIPTION = (
    f"'usage charge: meter=' || meter_code || ' window=[' || {iso('window_start')} || ',' || "
    f"{iso('window_end')} || ') qty=' || quantity || ' plan=v' || plan_version"
)
ACCOUNT = account_id("account_type")


def _book(spark, sf) -> Book:
    return book_of(data.charges(spark, sf))


def _freight_book(spark, sf) -> Book:
    return book_of(data.freight_charges(spark, sf))


def _staged_freight_charges(spark, sf):
    """Charges laid out by tenant, so that sums by account collapse before they are shuffled.

    The rebalancing splits a tenant that dominates.
    """
    return staged(data.freight_charges(spark, sf).hint("rebalance", "tenant_id"))


def _staged_freight_book(spark, sf) -> Book:
    """For queries that use several tables of the book: the charges are computed once."""
    return book_of(_staged_freight_charges(spark, sf))


def _signed_by(keys: str, source: str) -> str:
    return sql(
        f"SELECT {keys}, {SIGNED} AS balance_minor FROM {source} GROUP BY ALL", source
    )


@query(
    sql(
        f"SELECT tenant_id, {ACCOUNT} AS account_id, account_type AS type, 'AUD' AS currency, "
        f"{SIGNED} AS balance_minor FROM lines_acc GROUP BY ALL",
        "lines_acc",
    )
)
def ledger_from_events(spark, sf):
    accepted = data.ingested(spark, sf).accepted
    readings = metering.meter(accepted, data.meters(spark), "1 day")
    book = book_of(rating.rate(readings, data.tenant_plan(spark), data.models(spark)))
    return ledger.recomputed_balances(book.entries, book.accounts)


LINE = (
    "SELECT transaction_id, tenant_id, line_no, direction, account_type, amount_minor, "
    "'AUD' AS currency FROM "
)


@query(sql(LINE + "lines", "lines"))
def posting_lines(spark, sf):
    return posting.posting_lines(data.charges(spark, sf))


@query(sql(LINE + "f_lines", "f_lines"))
def posting_lines_freight(spark, sf):
    return posting.posting_lines(data.freight_charges(spark, sf))


@query(
    sql(
        f"SELECT charge_id AS id, tenant_id, {DESCRIPTION} AS description, "
        "charge_id AS source_charge_id FROM charges",
        "charges",
    )
)
def transaction_headers(spark, sf):
    return posting.transaction_headers(data.charges(spark, sf))


_HAND_LINES = (
    "SELECT 'order-' || l_orderkey AS transaction_id, CASE WHEN l_linestatus = 'O' THEN 'DEBIT' "
    "ELSE 'CREDIT' END AS direction, CAST(l_quantity AS BIGINT) - 1 AS amount_minor, "
    "CASE WHEN l_tax > 0.06 THEN 'NZD' ELSE 'AUD' END AS currency FROM lineitem"
)


@query(
    f"SELECT * FROM (SELECT transaction_id, line_count, debit_minor, credit_minor, "
    "CASE WHEN line_count < 2 THEN 'not_double_entry' WHEN currencies > 1 THEN 'mixed_currency' "
    "WHEN debit_minor <> credit_minor THEN 'unbalanced' END AS violation FROM "
    "(SELECT transaction_id, count(*) AS line_count, count(DISTINCT currency) AS currencies, "
    "CAST(coalesce(sum(amount_minor) FILTER (direction = 'DEBIT'), 0) AS BIGINT) AS debit_minor, "
    "CAST(coalesce(sum(amount_minor) FILTER (direction = 'CREDIT'), 0) AS BIGINT) AS credit_minor "
    f"FROM ({_HAND_LINES}) GROUP BY transaction_id)) WHERE violation IS NOT NULL"
)
def invalid_postings(spark, sf):
    lines = data.table(spark, sf, "lineitem").select(
        F.concat(F.lit("order-"), F.col("l_orderkey").cast("string")).alias("transaction_id"),
        F.when(F.col("l_linestatus") == "O", "DEBIT").otherwise("CREDIT").alias("direction"),
        (F.col("l_quantity").cast("bigint") - 1).alias("amount_minor"),
        F.when(F.col("l_tax") > 0.06, "NZD").otherwise("AUD").alias("currency"),
    )
    return posting.invalid_postings(lines)


@query(
    sql(
        "SELECT charge_id, tenant_id, meter_code, amount_minor, CAST(1 AS INTEGER) AS delivery "
        "FROM charges WHERE tenant_id <> '" + T3 + "'",
        "charges",
    )
)
def post_once(spark, sf):
    delivered = data.deliveries(spark, sf)
    posted = data.charges(spark, sf).filter(F.col("tenant_id") == T3).select("charge_id")
    return posting.new_charges(delivered, "delivery", posted).select(
        "charge_id", "tenant_id", "meter_code", "amount_minor", "delivery"
    )


@query(
    sql(
        f"SELECT tenant_id, charge_id, CAST(CASE WHEN tenant_id = '{T3}' THEN 0 ELSE 1 END "
        f"AS BIGINT) AS posted, CAST(CASE WHEN tenant_id = '{T3}' THEN 2 ELSE 1 END AS BIGINT) "
        "AS duplicates, quantity % 2 = 1 AS conflicting FROM charges",
        "charges",
    )
)
def post_outcomes(spark, sf):
    posted = data.charges(spark, sf).filter(F.col("tenant_id") == T3).select("charge_id")
    return posting.post_outcomes(data.deliveries(spark, sf), posted)


@query(
    sql(
        "SELECT * FROM (SELECT tenant_id, 'POSTED' AS outcome, count(*) AS charges FROM charges "
        "GROUP BY ALL UNION ALL SELECT tenant_id, 'DUPLICATE', count(*) FROM charges GROUP BY ALL)",
        "charges",
    )
)
def post_outcome_counts(spark, sf):
    none = data.charges(spark, sf).select("charge_id").filter(F.lit(False))
    return posting.outcome_counts(posting.post_outcomes(data.deliveries(spark, sf), none))


@query(
    sql(
        f"SELECT DISTINCT {ACCOUNT} AS id, tenant_id, account_type AS type, 'AUD' AS currency "
        "FROM f_lines",
        "f_lines",
    )
)
def provision_accounts(spark, sf):
    return _freight_book(spark, sf).accounts


@query(
    sql(
        f"SELECT transaction_id, line_no, tenant_id, {ACCOUNT} AS account_id, account_type, "
        "direction, amount_minor, 'AUD' AS currency FROM lines",
        "lines",
    )
)
def ledger_entries(spark, sf):
    return _book(spark, sf).entries


@query(
    sql(
        f"SELECT {ACCOUNT} AS account_id, tenant_id, 'AUD' AS currency, {SIGNED} AS balance_minor "
        "FROM lines GROUP BY ALL",
        "lines",
    )
)
def balance_snapshots(spark, sf):
    entries = _book(spark, sf).entries
    reopened = F.col("direction") == "DEBIT"
    first = ledger.balance_deltas(entries.filter(reopened))
    return ledger.apply_deltas(first, ledger.balance_deltas(entries.filter(~reopened)))


@query(
    sql(
        f"SELECT charge_id, tenant_id, meter_code, {iso('window_start')} AS window_start, "
        f"{iso('window_end')} AS window_end, quantity AS quantity_billed, amount_minor, "
        "'AUD' AS currency, plan_version, strftime(window_start, '%Y-%m') AS billing_month "
        "FROM f_charges",
        "f_charges",
    )
)
def billed_charges(spark, sf):
    return _freight_book(spark, sf).billed


@query(
    sql(
        f"SELECT tenant_id, {ACCOUNT} AS account_id, account_type AS type, 'AUD' AS currency, "
        f"{SIGNED} AS balance_minor FROM f_lines GROUP BY ALL",
        "f_lines",
    )
)
def balances(spark, sf):
    book = _freight_book(spark, sf)
    return ledger.balances(book.balance, book.accounts)


@query(
    sql(
        f"SELECT tenant_id, {ACCOUNT} AS account_id, account_type AS type, 'AUD' AS currency, "
        f"{SIGNED} AS balance_minor FROM f_lines GROUP BY ALL",
        "f_lines",
    )
)
def recomputed_balances(spark, sf):
    book = _staged_freight_book(spark, sf)
    return ledger.recomputed_balances(book.entries, book.accounts)


@query(
    sql(
        "SELECT CAST(c_custkey AS VARCHAR) AS tenant_id, coalesce(n, 0) = 0 AS all_match, "
        "coalesce(n, 0) AS discrepancies FROM customer LEFT JOIN (SELECT tenant_id, count(*) AS n "
        "FROM (SELECT tenant_id, account_type FROM f_lines WHERE line_no < 3 GROUP BY ALL HAVING "
        "sum(CASE WHEN year(window_start) = 1998 THEN amount_minor ELSE 0 END) <> 0) GROUP BY ALL) "
        "d ON d.tenant_id = CAST(c_custkey AS VARCHAR)",
        "f_lines",
    )
)
def verify_drifted(spark, sf):
    """Balances that miss one year's receivables and revenue are found, tenant by tenant."""
    charges = _staged_freight_charges(spark, sf)
    book = book_of(charges)
    # A charge's year follows from its id, so what is lost is told without a join.
    missed = F.coalesce(F.year("window.start") == 1998, F.lit(False))
    lost = book_of(charges.filter(missed)).entries
    kept = book_of(charges.filter(~missed)).entries.unionByName(lost.filter(F.col("line_no") >= 3))
    drifted = ledger.balances(ledger.balance_deltas(kept), book.accounts)
    return ledger.verify(
        data.freight_tenants(spark, sf),
        drifted,
        ledger.recomputed_balances(book.entries, book.accounts),
    )


@query(
    "SELECT CAST(c_custkey AS VARCHAR) AS tenant_id, true AS all_match, "
    "CAST(0 AS BIGINT) AS discrepancies FROM customer"
)
def verify(spark, sf):
    book = _staged_freight_book(spark, sf)
    return ledger.verify(
        data.freight_tenants(spark, sf),
        ledger.balances(book.balance, book.accounts),
        ledger.recomputed_balances(book.entries, book.accounts),
    )


@query(
    sql(
        "SELECT transaction_id, count(*) AS line_count, CAST(coalesce(sum(amount_minor) FILTER "
        "(direction = 'DEBIT'), 0) AS BIGINT) AS debit_minor, CAST(coalesce(sum(amount_minor) "
        "FILTER (direction = 'CREDIT'), 0) AS BIGINT) AS credit_minor, 'unbalanced' AS violation "
        "FROM f_lines WHERE line_no < 3 GROUP BY ALL HAVING coalesce(sum(amount_minor) FILTER "
        "(direction = 'DEBIT'), 0) <> coalesce(sum(amount_minor) FILTER (direction = 'CREDIT'), 0)",
        "f_lines",
    )
)
def unbalanced_transactions(spark, sf):
    untaxed = _freight_book(spark, sf).entries.filter(F.col("line_no") < 3)
    return ledger.unbalanced_transactions(untaxed)


@query(
    sql(
        f"SELECT tenant_id, 'AUD' AS currency, {SIGNED} AS total_minor FROM f_lines GROUP BY ALL",
        "f_lines",
    )
)
def trial_balance(spark, sf):
    return ledger.trial_balance(_freight_book(spark, sf).entries)


def _headers(charges):
    """Transactions, recorded at the end of their window."""
    return posting.transaction_headers(charges.withColumn("created_at", F.col("window.end")))


_RECENT = (
    ", ranked AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY window_end DESC, "
    "charge_id) AS position FROM f_charges) "
)


@query(
    sql(
        _RECENT + f"SELECT charge_id AS id, tenant_id, {DESCRIPTION} AS description, "
        f"{iso('window_end')} AS created_at, CAST(position AS INTEGER) AS position "
        "FROM ranked WHERE position <= 5",
        "f_charges",
    )
)
def recent_transactions(spark, sf):
    charges = data.freight_charges(spark, sf)
    return ledger.recent_transactions(_headers(charges), 5).drop("source_charge_id")


@query(
    sql(
        f"SELECT charge_id AS id, tenant_id, {DESCRIPTION} AS description, "
        f"'1:' || (amount_minor + tax_minor) || ' 2:' || amount_minor || ' 3:' || tax_minor "
        "AS entries FROM f_charges WHERE tenant_id = '7' ORDER BY window_end DESC, charge_id LIMIT 500",
        "f_charges",
    )
)
def recent_of_tenant(spark, sf):
    charges = staged(data.freight_charges(spark, sf))
    entries = book_of(charges).entries
    newest = ledger.recent_of_tenant(_headers(charges), "7", 9999)
    text = F.transform(
        "entries",
        lambda e: F.concat_ws(":", e["line_no"].cast("string"), e["amount_minor"].cast("string")),
    )
    return ledger.with_entries(newest, entries).select(
        "id", "tenant_id", "description", F.array_join(text, " ").alias("entries")
    )


@query(
    sql(
        f"SELECT charge_id AS id, tenant_id, {DESCRIPTION} AS description, 3 AS entry_count "
        "FROM f_charges WHERE charge_id = (SELECT min(charge_id) FROM f_charges "
        "WHERE tenant_id = '7')",
        "f_charges",
    )
)
def transaction_by_id(spark, sf):
    charges = staged(data.freight_charges(spark, sf))
    headers = _headers(charges)
    wanted = ledger.scoped(headers, "7").agg(F.min("id")).first()[0]
    found = ledger.transaction(headers, "7", wanted)
    return ledger.with_entries(found, book_of(charges).entries).select(
        "id", "tenant_id", "description", F.size("entries").alias("entry_count")
    )


@query("SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer")
def tenant_ids(spark, sf):
    return ledger.tenant_ids(data.freight_tenants(spark, sf))


@query(
    sql(
        f"SELECT '{T1}' AS scope, count(*) FILTER (tenant_id = '{T1}') AS visible, "
        f"count(*) FILTER (tenant_id <> '{T1}') AS refused FROM charges "
        "UNION ALL SELECT 'none', 0, count(*) FROM charges",
        "charges",
    )
)
def tenant_scope(spark, sf):
    charges = data.charges(spark, sf)

    def seen(tenant, name):
        one = F.lit(1).alias("n")
        inside = ledger.scoped(charges, tenant).select(one, F.lit(0).alias("m"))
        outside = ledger.outside_scope(charges, tenant).select(F.lit(0).alias("n"), F.lit(1).alias("m"))
        return inside.unionByName(outside).agg(
            F.count_if(F.col("n") == 1).alias("visible"), F.count_if(F.col("m") == 1).alias("refused")
        ).select(F.lit(name).alias("scope"), "visible", "refused")

    return seen(T1, T1).unionByName(seen(None, "none"))


@query(
    sql(
        "SELECT tenant_id, account_type AS type, CASE account_type WHEN 'RECEIVABLE' THEN 'DEBIT' "
        "ELSE 'CREDIT' END AS normal_side, CAST(sum(amount_minor) AS BIGINT) AS normal_minor "
        "FROM f_lines GROUP BY ALL",
        "f_lines",
    )
)
def normal_balances(spark, sf):
    book = _freight_book(spark, sf)
    shown = ledger.on_normal_side(ledger.balances(book.balance, book.accounts))
    return shown.select("tenant_id", "type", "normal_side", "normal_minor")


@query(
    sql(
        "SELECT table_name, rule, count(*) AS faults FROM ("
        "SELECT 'ledger_account' AS table_name, 'tenant_id_unknown' AS rule FROM "
        "(SELECT DISTINCT tenant_id, account_type FROM f_lines WHERE tenant_id NOT IN "
        "(SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_mktsegment <> 'BUILDING')) "
        "UNION ALL SELECT 'ledger_transaction', 'tenant_id_unknown' FROM f_charges WHERE tenant_id "
        "NOT IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_mktsegment <> 'BUILDING') "
        "UNION ALL SELECT 'ledger_entry', 'tenant_id_unknown' FROM f_lines WHERE tenant_id NOT IN "
        "(SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_mktsegment <> 'BUILDING') "
        "UNION ALL SELECT 'ledger_entry', 'amount_negative' FROM f_lines WHERE amount_minor > 900) "
        "GROUP BY ALL",
        "f_lines",
        "f_charges",
    )
)
def integrity_faults(spark, sf):
    """A segment's tenants are unknown and amounts above 900 are negative; both are found."""
    book = _staged_freight_book(spark, sf)
    tenants = data.freight_tenants(spark, sf).filter(F.col("plan_code") != "BUILDING")
    amount = F.col("amount_minor")
    damaged = book.entries.withColumn("amount_minor", F.when(amount > 900, -amount).otherwise(amount))
    # Accounts are sums of all lines, and each check of them would sum anew.
    faults = ledger.integrity_faults(tenants, staged(book.accounts), book.transactions, damaged)
    return faults.groupBy("table_name", "rule").agg(F.count(F.lit(1)).alias("faults"))


# ---- invoices ----


def _nothing_linked(charges):
    return charges.select("charge_id", F.lit("").alias("invoice_id")).filter(F.lit(False))


INVOICE_ID = uuid3("tenant_id || '|' || period || '|1'")
JAN_ID = uuid3("tenant_id || '|2024-01|1'")


@query(
    sql(
        "SELECT DISTINCT strftime(window_start, '%Y-%m') AS period, "
        "strftime(date_trunc('month', window_start), '%Y-%m-%dT%H:%M:%SZ') AS period_start, "
        "strftime(date_trunc('month', window_start) + INTERVAL 1 MONTH, '%Y-%m-%dT%H:%M:%SZ') "
        "AS period_end FROM f_charges",
        "f_charges",
    )
)
def billing_periods(spark, sf):
    from tallywork.functions.windows import period_end, period_start

    charges = invoicing.in_period(_freight_book(spark, sf).billed)
    return charges.select("period").distinct().select(
        "period",
        period_start(F.col("period")).alias("period_start"),
        period_end(F.col("period")).alias("period_end"),
    )


@query(
    sql(
        "SELECT charge_id, tenant_id, meter_code, amount_minor FROM charges "
        "WHERE window_start >= TIMESTAMP '2024-01-01' AND window_start < TIMESTAMP '2024-02-01' "
        f"AND tenant_id <> '{T3}'",
        "charges",
    )
)
def uninvoiced_charges(spark, sf):
    billed = _book(spark, sf).billed
    taken = billed.filter(F.col("tenant_id") == T3).select("charge_id", F.lit("i").alias("invoice_id"))
    return invoicing.uninvoiced(billed, taken, JANUARY).select(
        "charge_id", "tenant_id", "meter_code", "amount_minor"
    )


def _freight_lines(spark, sf):
    return invoicing.invoice_lines(invoicing.in_period(_freight_book(spark, sf).billed))


@query(
    sql(
        "SELECT tenant_id, strftime(window_start, '%Y-%m') AS period, 'AUD' AS currency, "
        "meter_code, CAST(sum(quantity) AS BIGINT) AS quantity, "
        "CAST(sum(amount_minor) AS BIGINT) AS amount_minor FROM f_charges GROUP BY ALL",
        "f_charges",
    )
)
def invoice_lines(spark, sf):
    return _freight_lines(spark, sf)


def _january(spark, sf, with_lines=False):
    billed = _book(spark, sf).billed
    open_charges = invoicing.uninvoiced(billed, _nothing_linked(billed), JANUARY)
    due = invoicing.due_invoices(data.tenants(spark), [JANUARY])
    lines = invoicing.invoice_lines(open_charges)
    return invoicing.invoices(lines, due, with_lines=with_lines), open_charges


@query(
    sql(
        f"SELECT {JAN_ID} AS id, tenant_id, '2024-01' AS period, "
        "'2024-01-01T00:00:00Z' AS period_start, '2024-02-01T00:00:00Z' AS period_end, "
        f"'AUD' AS currency, net_minor, {gst('net_minor')} AS tax_minor, "
        f"net_minor + {gst('net_minor')} AS total_minor, 'GENERATED' AS status FROM e_invoices",
        "e_invoices",
    )
)
def invoices(spark, sf):
    return _january(spark, sf)[0]


@query(
    sql(
        f"SELECT {INVOICE_ID} AS id, tenant_id, period, net_minor, {gst('net_minor')} AS tax_minor, "
        f"net_minor + {gst('net_minor')} AS total_minor FROM f_invoices",
        "f_invoices",
    )
)
def invoices_all_periods(spark, sf):
    return invoicing.invoices(_freight_lines(spark, sf)).select(
        "id", "tenant_id", "period", "net_minor", "tax_minor", "total_minor"
    )


@query(
    sql(
        "SELECT t.id AS tenant_id, coalesce(string_agg(l.text, ' ' ORDER BY l.meter_code), '') "
        "AS lines FROM tenants t LEFT JOIN (SELECT tenant_id, meter_code, meter_code || ':' || q || "
        "':' || a AS text FROM (SELECT tenant_id, meter_code, CAST(sum(quantity) AS BIGINT) AS q, "
        "CAST(sum(amount_minor) AS BIGINT) AS a FROM charges WHERE window_start >= "
        "TIMESTAMP '2024-01-01' AND window_start < TIMESTAMP '2024-02-01' GROUP BY ALL)) l ON l.tenant_id = t.id GROUP BY ALL",
        "tenants",
        "charges",
    )
)
def invoices_with_lines(spark, sf):
    headers, _ = _january(spark, sf, with_lines=True)
    text = F.transform(
        "lines",
        lambda x: F.concat_ws(
            ":", x["meter_code"], x["quantity"].cast("string"), x["amount_minor"].cast("string")
        ),
    )
    return headers.select("tenant_id", F.array_join(text, " ").alias("lines"))


@query(
    sql(
        f"SELECT charge_id, {JAN_ID} AS invoice_id FROM charges "
        "WHERE window_start >= TIMESTAMP '2024-01-01' AND window_start < TIMESTAMP '2024-02-01'",
        "charges",
    )
)
def charge_links(spark, sf):
    return invoicing.charge_links(_january(spark, sf)[1])


_PAYLOAD = (
    f"'{{\"schemaVersion\":1,\"invoiceId\":\"' || {JAN_ID} || '\",\"tenantId\":\"' || tenant_id || "
    "'\",\"periodStart\":\"2024-01-01T00:00:00Z\",\"periodEnd\":\"2024-02-01T00:00:00Z\","
    f"\"netMinor\":' || net_minor || ',\"taxMinor\":' || {gst('net_minor')} || ',\"totalMinor\":' || "
    f"(net_minor + {gst('net_minor')}) || ',\"currency\":\"AUD\"}}'"
)


@query(
    sql(
        f"SELECT {JAN_ID} AS invoice_id, tenant_id, {_PAYLOAD} AS payload FROM e_invoices",
        "e_invoices",
    )
)
def invoice_events(spark, sf):
    return invoicing.invoice_events(_january(spark, sf)[0])


@query(
    sql(
        f"SELECT {uuid3(chr(39) + 'invoice.created|' + chr(39) + ' || ' + JAN_ID)} AS id, tenant_id, "
        f"'invoice' AS aggregate_type, {JAN_ID} AS aggregate_id, 'invoice.created' AS event_type, "
        f"{_PAYLOAD} AS payload FROM e_invoices",
        "e_invoices",
    )
)
def outbox_rows(spark, sf):
    return outbox.outbox_rows(invoicing.invoice_events(_january(spark, sf)[0]))


@query(
    sql(
        f", waiting AS (SELECT {INVOICE_ID} AS invoice_id, period FROM f_invoices "
        "WHERE period >= '1996-01'), "
        f"queue AS (SELECT invoice_id, {uuid3(chr(39) + 'invoice.created|' + chr(39) + ' || invoice_id')} "
        "AS id, period FROM waiting) "
        "SELECT id, invoice_id AS aggregate_id FROM queue ORDER BY period, id LIMIT 100",
        "f_invoices",
    )
)
def relay_pending(spark, sf):
    headers = invoicing.invoices(_freight_lines(spark, sf))
    at = headers.select(F.col("id").alias("aggregate_id"), F.col("period_end").alias("created_at"))
    rows = outbox.outbox_rows(invoicing.invoice_events(headers)).join(at, "aggregate_id")
    sent = rows.filter(F.col("created_at") < F.lit("1996-02-01").cast("timestamp")).select("id")
    return outbox.pending(rows, sent).select("id", "aggregate_id")


@query(
    sql(
        f"SELECT {INVOICE_ID} AS invoice_id, tenant_id, net_minor, net_minor AS posted_revenue_minor, "
        f"{gst('net_minor')} AS tax_minor, posted_tax AS posted_tax_minor, "
        "CAST(0 AS BIGINT) AS net_difference_minor, "
        f"{gst('net_minor')} - posted_tax AS tax_difference_minor FROM f_invoices",
        "f_invoices",
    )
)
def reconcile_invoices(spark, sf):
    book = book_of(staged(data.freight_charges(spark, sf), lean=True))
    charges = invoicing.in_period(book.billed)
    lines = invoicing.invoice_lines(charges)
    return invoicing.reconcile(
        invoicing.charge_links(charges), book.entries, invoicing.invoices(lines)
    )


@query(
    sql(
        f"SELECT {JAN_ID} AS invoice_id, c.charge_id, c.tenant_id, c.meter_code, c.dimension_key, "
        f"{iso('c.window_start')} AS window_start, e.idempotency_key, e.quantity AS event_quantity, "
        "c.quantity AS quantity_billed, c.amount_minor FROM charges_acc c JOIN accepted e "
        "ON e.tenant_id = c.tenant_id AND e.meter_code = c.meter_code "
        "AND e.dimension_key = c.dimension_key AND e.occurred_at >= c.window_start "
        "AND e.occurred_at < c.window_end WHERE c.window_start >= TIMESTAMP '2024-01-01' "
        "AND c.window_start < TIMESTAMP '2024-02-01'",
        "charges_acc",
        "accepted",
    ).replace(JAN_ID, JAN_ID.replace("tenant_id", "c.tenant_id"))
)
def audit_trace(spark, sf):
    accepted = data.ingested(spark, sf).accepted
    readings = metering.meter(accepted, data.meters(spark), "1 day")
    charges = rating.rate(readings, data.tenant_plan(spark), data.models(spark))
    billed = posting.billed_charges(charges)
    links = invoicing.charge_links(invoicing.in_period(billed, JANUARY))
    return invoicing.audit_trace(links, charges, accepted, "1 day").drop("occurred_at")
