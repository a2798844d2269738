"""The steps put together: events to charges, and charges to ledger and invoices."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywork.operators import invoicing, ledger, metering, outbox, posting, rating
from tallywork.session import staged
from tallywork.sources.tables import MONTH, TableStore


def charges_of(
    events: DataFrame,
    meters: DataFrame,
    tenant_plan: DataFrame,
    models: DataFrame,
    window: str = metering.WINDOW_SIZE,
    event_time: str = "occurred_at",
) -> DataFrame:
    """Events to charges. One shuffle, the window aggregation; the rest is narrow."""
    readings = metering.meter(events, meters, window, event_time)
    return rating.rate(readings, tenant_plan, models)


@dataclass(frozen=True)
class Book:
    """The ledger that posting a set of charges to an empty one gives, without storing it."""

    transactions: DataFrame
    entries: DataFrame
    accounts: DataFrame
    balance: DataFrame
    billed: DataFrame


def book_of(charges: DataFrame) -> Book:
    """All ledger tables as views on ``charges``, whose ids are unique.

    Balances are summed by the natural key of the account; its id is derived from
    the sums, not for every line. Stage the charges first if several of the tables
    are used.
    """
    lines = posting.posting_lines(charges)
    sums = lines.groupBy("tenant_id", "account_type", "currency").agg(
        F.sum(posting.signed_amount()).alias("balance_minor")
    )
    balance = posting.to_entries(sums)
    return Book(
        transactions=posting.transaction_headers(charges),
        entries=posting.to_entries(lines),
        accounts=balance.select(
            F.col("account_id").alias("id"),
            "tenant_id",
            F.col("account_type").alias("type"),
            "currency",
        ),
        balance=balance.select("account_id", "tenant_id", "currency", "balance_minor"),
        billed=posting.billed_charges(charges),
    )


POSTING, INVOICING, RELAYING = "posting", "invoicing", "relaying"


def content_of(charges: DataFrame) -> str:
    """What identifies the charges of a batch: how many rows, and a sum of hashes of what each one bills.

    Copies add up, so a batch with other amounts or with more copies of a charge is another one.
    """
    of_row = F.xxhash64("charge_id", "tenant_id", "meter_code", "quantity_billed", "amount_minor", "currency", "plan_version")
    row = charges.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(of_row.cast("decimal(38,0)")), F.lit(0)).alias("h"),
    ).first()
    return f"{row.n}:{row.h}"


def post_batch(
    store: TableStore, charges: DataFrame, batch_id: int, order: str, writer: str = POSTING
) -> DataFrame:
    """Post a batch of charges exactly once and return the outcome per charge id.

    ``order`` names the column by which copies of a charge were delivered. ``batch_id``
    numbers the batches of one ``writer``; a number that comes again with the same
    charges is a retry and answers from what was written, with others it is refused.
    Charges are staged, then only the months in the batch are looked up among the posted
    ones, because a charge id fixes its window. The fresh charges are written first
    and all other tables derive from that written copy, so a lost executor cannot make
    them disagree. Nothing is visible before the commit; a new try starts over
    under a name of its own. Balances continue from the last commit, whatever its number.
    """
    charges = staged(charges)
    content = content_of(charges)
    done = store.committed(writer, batch_id)
    if done is not None:
        if done.content != content:
            raise ValueError(f"batch {batch_id} of {writer} was posted with other charges")
        return batch_outcomes(store, charges, done.attempt)

    attempt = store.begin()
    month = F.date_format(F.col("window.start"), "yyyy-MM")
    months = [r[0] for r in charges.select(month.alias("m")).distinct().collect()]
    posted = store.read("billed_charge", months).select("charge_id")
    now = F.current_timestamp().alias("created_at")
    fresh = posting.new_charges(charges, order, posted)
    store.write("billed_charge", posting.billed_charges(fresh).select("*", now), attempt)
    written = store.read_attempt("billed_charge", attempt)
    booked = written.withColumn(
        "window", F.struct(F.col("window_start").alias("start"), F.col("window_end").alias("end"))
    )

    store.write("ledger_transaction", posting.transaction_headers(booked), attempt)
    entries = posting.to_entries(posting.posting_lines(booked)).withColumn("created_at", now)
    store.write("ledger_entry", entries, attempt)
    new_entries = store.read_attempt("ledger_entry", attempt)
    accounts = posting.needed_accounts(new_entries, store.read("ledger_account"))
    store.write("ledger_account", accounts.select("*", now), attempt)

    previous = snapshot(store, store.last_posted())
    after = ledger.apply_deltas(previous, ledger.balance_deltas(new_entries))
    store.write("account_balance", after.withColumn("updated_at", F.current_timestamp()), attempt)
    store.commit(writer, batch_id, attempt, posted=True, content=content)
    return batch_outcomes(store, charges, attempt)


def batch_outcomes(store: TableStore, charges: DataFrame, attempt: str) -> DataFrame:
    """Outcome per charge id of a committed batch: what it did not write was a duplicate."""
    own = store.read_attempt("billed_charge", attempt).select("charge_id")
    earlier = charges.select("charge_id").distinct().join(own, "charge_id", "left_anti")
    return posting.post_outcomes(charges, earlier)


def snapshot(store: TableStore, attempt: str | None) -> DataFrame:
    """The account balances as an attempt left them."""
    return store.read_attempt("account_balance", attempt or "none")


def invoice_runs(store: TableStore, period: str) -> list[int]:
    """The numbers of the invoice runs of a period that were committed."""
    rows = store.commits().filter((F.col("writer") == INVOICING) & F.col("content").startswith(f"{period}:"))
    return sorted(int(r.content.split(":")[1]) for r in rows.select("content").collect())


def invoice_run(store: TableStore, period: str, batch_id: int, run: int | None = None) -> DataFrame:
    """Invoice every tenant for a period and return the headers.

    A tenant gets an invoice for each currency of its open charges, and one in the
    default currency in any case. Headers, lines, charge links and outbox rows
    belong to one batch and become visible together. The run is the next one of the period
    unless given; it is part of every invoice's id, so charges that come late are invoiced
    and announced under ids of their own. A number that comes again for the same period answers from what was
    written; for another period or run it is refused, as is a run that was made under another number.
    """
    done = store.committed(INVOICING, batch_id)
    if done is not None:
        if done.content.split(":")[0] != period or run not in (None, int(done.content.split(":")[1])):
            raise ValueError(f"batch {batch_id} of {INVOICING} is run {done.content}, not {period}:{run or ''}")
        return store.read_attempt("invoice", done.attempt)
    made = invoice_runs(store, period)
    if run is None:
        run = max(made, default=0) + 1
    elif run in made:
        raise ValueError(f"run {run} of {period} was made under another number")
    attempt = store.begin()
    charges = staged(
        invoicing.uninvoiced(
            store.read("billed_charge", [period]),
            store.read("invoice_charge_link", [period]),
            period,
        )
    )
    links = invoicing.charge_links(charges, run).withColumn(MONTH, F.lit(period))
    store.write("invoice_charge_link", links, attempt)
    lines = staged(invoicing.invoice_lines(charges))
    due = invoicing.due_invoices(store.read("tenant"), [period], lines=lines)
    headers = staged(invoicing.invoices(lines, due, run))
    now = F.current_timestamp()
    store.write("invoice", headers.withColumn("created_at", now), attempt)
    stored_id = invoicing.invoice_id(F.col("tenant_id"), F.col("period"), run, F.col("currency"))
    store.write("invoice_line", lines.withColumn("invoice_id", stored_id), attempt)
    announced = outbox.outbox_rows(invoicing.invoice_events(headers))
    store.write("outbox", announced.withColumn("created_at", now), attempt)
    store.commit(INVOICING, batch_id, attempt, content=f"{period}:{run}")
    return store.read_attempt("invoice", attempt)


def relay_run(store: TableStore, send, batch_id: int, limit: int = outbox.RELAY_BATCH) -> int:
    """Send all pending outbox rows, a relay batch at a time, and log them as published.

    What is pending is found and put in order once a run. Each relay batch is sent, logged and committed
    before the next one, so a failure in between sends the rows of one batch again and never
    loses any. A run that is done isn't repeated. Returns how many rows the run has sent.
    """
    parts = f"{RELAYING}-{batch_id}"
    own = F.col("writer") == parts
    if store.committed(RELAYING, batch_id) is None:
        queued, total = outbox.queue(store.read("outbox"), store.read("published_log"))
        sent = store.commits().filter(own).count()
        for first in range(0, total, limit):
            rows = queued(first, min(total, first + limit))
            attempt = store.begin()
            send(outbox.messages(rows))
            store.write("published_log", outbox.published_log(rows), attempt)
            store.commit(parts, sent, attempt)
            sent += 1
        store.commit(RELAYING, batch_id, store.begin())
    logs = store.read_attempts("published_log")
    return logs.join(store.commits().filter(own).select("attempt"), "attempt", "left_semi").count()


def verify_store(store: TableStore) -> DataFrame:
    """Per tenant: whether the balance snapshot agrees with the entries."""
    accounts = store.read("ledger_account")
    current = ledger.balances(snapshot(store, store.last_posted()), accounts)
    return ledger.verify(
        store.read("tenant"), current, ledger.recomputed_balances(store.read("ledger_entry"), accounts)
    )


def store_faults(store: TableStore) -> DataFrame:
    """Rows of a stored ledger that break a reference, a value or a key."""
    names = (
        "ledger_account", "ledger_transaction", "ledger_entry", "invoice", "invoice_line", "invoice_charge_link", "outbox",
        "billed_charge",
    )
    tables = {name: store.read(name) for name in names}
    tables["account_balance"] = snapshot(store, store.last_posted())
    found = ledger.integrity_faults(
        store.read("tenant"),
        tables["ledger_account"],
        tables["ledger_transaction"],
        tables["ledger_entry"],
        tables["invoice"],
        tables["account_balance"],
        tables["invoice_line"],
        tables["invoice_charge_link"],
        tables["outbox"],
        tables["billed_charge"],
    )
    return found.unionByName(ledger.repeated_keys(tables))
