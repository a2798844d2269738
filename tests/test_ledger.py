import pytest
from pyspark.sql import functions as F

from conftest import ACME, GLOBEX, INITECH
from tallywork import schemas
from tallywork.operators import invoicing, ledger, outbox, posting
from tallywork.plans import standard
from tallywork.plans.billing import (
    book_of,
    invoice_run,
    post_batch,
    relay_run,
    store_faults,
    verify_store,
)
from tallywork.sources import catalogs
from tallywork.sources.tables import TableStore

METER = "llm.tokens.input"
A, B, C = (f"{c * 8}-0000-3000-8000-000000000000" for c in "abc")


def balances_by_type(book):
    found = ledger.balances(book.balance, book.accounts).collect()
    return {(r.tenant_id, r.type): r.balance_minor for r in found}


def test_posting_a_charge(charges):
    book = book_of(charges((A, ACME, METER, 10, 1000, 0)))
    lines = book.entries.orderBy("line_no").collect()
    assert [(r.direction, r.account_type, r.amount_minor) for r in lines] == [
        ("DEBIT", "RECEIVABLE", 1100),
        ("CREDIT", "REVENUE", 1000),
        ("CREDIT", "TAX", 100),
    ]
    assert balances_by_type(book) == {
        (ACME, "RECEIVABLE"): 1100, (ACME, "REVENUE"): -1000, (ACME, "TAX"): -100,
    }
    assert ledger.trial_balance(book.entries).first().total_minor == 0
    assert posting.invalid_postings(book.entries).isEmpty()


def test_zero_charge_keeps_its_lines(charges):
    assert book_of(charges((A, ACME, METER, 0, 0, 0))).entries.count() == 3


def test_description(charges):
    row = posting.transaction_headers(charges((A, ACME, METER, 10, 1000, 0))).first()
    assert row.description == (
        "usage charge: meter=llm.tokens.input window=[2026-07-08T00:00:00Z,2026-07-08T00:01:00Z) "
        "qty=10 plan=v1"
    )
    assert row.id == row.source_charge_id == A


@pytest.mark.parametrize(
    ("lines", "violation"),
    [
        ([("DEBIT", 1000, "AUD"), ("CREDIT", 999, "AUD")], "unbalanced"),
        ([("DEBIT", 1000, "AUD")], "not_double_entry"),
        ([("DEBIT", 10, "AUD"), ("CREDIT", 10, "NZD")], "mixed_currency"),
        ([("DEBIT", -10, "AUD"), ("CREDIT", -10, "AUD")], "negative_amount"),
        ([("DEBIT", 5000, "AUD"), ("CREDIT", 4000, "AUD"), ("CREDIT", 1000, "AUD")], None),
    ],
)
def test_posting_rules(spark, lines, violation):
    df = spark.createDataFrame(
        [("t", *line) for line in lines],
        "transaction_id string, direction string, amount_minor bigint, currency string",
    )
    found = posting.invalid_postings(df).collect()
    assert [r.violation for r in found] == ([violation] if violation else [])


def test_first_delivery_wins(charges):
    df = charges((A, ACME, METER, 1, 100, 0), (A, ACME, METER, 1, 300, 0), (B, ACME, METER, 1, 5, 0))
    df = df.withColumn("seq", F.when(F.col("amount_minor") == 300, 2).otherwise(1))
    kept = posting.first_deliveries(df, "seq")
    assert {(r.charge_id, r.amount_minor) for r in kept.collect()} == {(A, 100), (B, 5)}
    assert kept.columns == df.columns
    posted = df.filter(F.col("charge_id") == B).select("charge_id")
    outcomes = {r.charge_id: r for r in posting.post_outcomes(df, posted).collect()}
    assert (outcomes[A].posted, outcomes[A].duplicates, outcomes[A].conflicting) == (1, 1, True)
    assert (outcomes[B].posted, outcomes[B].duplicates) == (0, 1)


def test_scope_fails_closed(charges):
    df = charges((A, ACME, METER, 1, 1, 0), (B, GLOBEX, METER, 1, 1, 0))
    assert ledger.scoped(df, ACME).count() == 1
    assert ledger.scoped(ledger.scoped(df, ACME), GLOBEX).count() == 0
    assert ledger.scoped(df, None).count() == 0
    assert ledger.outside_scope(df, ACME).count() == 1
    assert ledger.outside_scope(df, None).count() == 2


def test_sides(spark):
    row = spark.range(1).select(
        posting.opposite(F.lit("DEBIT")), posting.opposite(F.lit("CREDIT")),
        *[posting.normal_side(F.lit(t)) for t in schemas.ACCOUNT_TYPES],
    ).first()
    assert list(row) == ["CREDIT", "DEBIT", "DEBIT", "CREDIT", "CREDIT", "CREDIT"]


def test_integrity_faults(spark, charges):
    book = book_of(charges((A, ACME, METER, 1, 100, 0), (B, GLOBEX, METER, 1, 50, 0)))
    tenants = spark.createDataFrame([(ACME,)], "id string")
    accounts = book.accounts.unionByName(
        book.accounts.limit(1).withColumn("type", F.lit("GIFT")).withColumn("id", F.lit("gift"))
    )
    entries = book.entries.withColumn(
        "direction", F.when(F.col("line_no") == 3, "SIDEWAYS").otherwise(F.col("direction"))
    )
    invoices = spark.createDataFrame([("i", 5, 5)], "id string, period_start int, period_end int")
    orphan = entries.limit(1).withColumn("account_id", F.lit("none")).withColumn("line_no", F.lit(9))
    found = ledger.integrity_faults(
        tenants, accounts, book.transactions, entries.unionByName(orphan), invoices
    )
    rules = {(r.table_name, r.rule) for r in found.collect()}
    assert {
        ("ledger_account", "type_not_allowed"),
        ("ledger_account", "tenant_id_unknown"),
        ("ledger_entry", "direction_not_allowed"),
        ("ledger_entry", "account_id_unknown"),
        ("ledger_transaction", "tenant_id_unknown"),
        ("invoice", "period_empty"),
    } <= rules


def test_integrity_of_every_table(spark, charges):
    book = book_of(charges((A, ACME, METER, 1, 100, 0), (B, ACME, METER, 1, 50, 0)))
    tenants = spark.createDataFrame([(ACME,)], "id string")
    sound = (tenants, book.accounts, book.transactions, book.entries)
    assert ledger.integrity_faults(*sound, balances=book.balance, billed=book.billed).isEmpty()
    blank = lambda df, c: df.withColumn(c, F.lit(None).cast(df.schema[c].dataType))
    lost = lambda df, c: df.withColumn(c, F.lit("none"))
    invoices = spark.createDataFrame(
        [("i", ACME, 1, 2)], "id string, tenant_id string, period_start int, period_end int"
    )
    lines = spark.createDataFrame(
        [("j", "nobody", METER, None)],
        "invoice_id string, tenant_id string, meter_code string, amount_minor bigint",
    )
    links = spark.createDataFrame([("c", "j"), ("d", "i")], "charge_id string, invoice_id string")
    events = spark.createDataFrame([("o", "nobody", None)], "id string, tenant_id string, payload string")
    found = ledger.integrity_faults(
        tenants,
        blank(book.accounts, "type"),
        book.transactions,
        blank(blank(book.entries, "direction"), "amount_minor"),
        invoices,
        lost(book.balance, "account_id"),
        lines,
        links,
        events,
        lost(book.billed, "tenant_id"),
    )
    assert {(r.table_name, r.rule) for r in found.collect()} == {
        ("ledger_account", "type_missing"), ("ledger_account", "account_not_unique"),
        ("ledger_entry", "direction_missing"), ("ledger_entry", "amount_minor_missing"),
        ("account_balance", "account_id_unknown"),
        ("invoice_line", "invoice_id_unknown"), ("invoice_line", "tenant_id_unknown"),
        ("invoice_line", "amount_minor_missing"), ("invoice_charge_link", "invoice_id_unknown"),
        ("outbox", "tenant_id_unknown"), ("outbox", "payload_missing"),
        ("billed_charge", "tenant_id_unknown"),
    }


def test_rounding_difference_between_ledger_and_invoice(charges):
    ids = [f"{i:08d}-0000-3000-8000-000000000000" for i in range(4)]
    book = book_of(charges(*[(i, ACME, METER, 1, 5, 0) for i in ids]))
    billed = invoicing.in_period(book.billed, "2026-07")
    due = book.billed.sparkSession.createDataFrame(
        [(ACME, "2026-07", "AUD")], "tenant_id string, period string, currency string"
    )
    headers = invoicing.invoices(invoicing.invoice_lines(billed), due)
    row = invoicing.reconcile(invoicing.charge_links(billed), book.entries, headers).first()
    assert (row.net_difference_minor, row.posted_tax_minor, row.tax_minor) == (0, 0, 2)
    assert row.tax_difference_minor == 2


@pytest.fixture
def store(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "ledger"))
    tenants = catalogs.tenants(spark, standard.TENANT_NAMES, standard.TENANT_PLANS)
    attempt = store.begin()
    store.write("tenant", tenants.withColumn("created_at", F.current_timestamp()), attempt)
    store.commit("loading", 0, attempt)
    return store


def delivered(charges, *rows):
    return charges(*rows).withColumn("seq", F.monotonically_increasing_id())


def outcomes(df):
    return {r.charge_id: (r.posted, r.duplicates) for r in df.collect()}


def test_posting_is_idempotent(store, charges):
    first = delivered(charges, (A, ACME, METER, 1, 777, 0), (B, GLOBEX, METER, 1, 250, 40))
    assert outcomes(post_batch(store, first, 1, "seq")) == {A: (1, 0), B: (1, 0)}
    again = delivered(charges, (A, ACME, METER, 1, 777, 0), (C, ACME, METER, 1, 1, 1))
    assert outcomes(post_batch(store, again, 2, "seq")) == {A: (0, 1), C: (1, 0)}
    # The same batch once more changes nothing and answers the same.
    assert outcomes(post_batch(store, again, 2, "seq")) == {A: (0, 1), C: (1, 0)}
    assert store.read("ledger_entry").count() == 9
    assert store.read("ledger_account").count() == 6
    assert {r.tenant_id: r.all_match for r in verify_store(store).collect()} == {
        ACME: True, GLOBEX: True, INITECH: True,
    }
    assert ledger.unbalanced_transactions(store.read("ledger_entry")).isEmpty()


def test_uncommitted_batch_is_invisible_and_its_retry_overwrites(store, charges, monkeypatch):
    def lose(*_, **__):
        raise OSError("lost")

    batch = delivered(charges, (A, ACME, METER, 1, 100, 0))
    monkeypatch.setattr(store, "commit", lose)
    with pytest.raises(OSError):
        post_batch(store, batch, 1, "seq")
    assert store.read("billed_charge").isEmpty()
    monkeypatch.undo()
    assert outcomes(post_batch(store, batch, 1, "seq")) == {A: (1, 0)}
    assert store.read("ledger_entry").count() == 3


def test_drift_is_found(store, charges):
    post_batch(store, delivered(charges, (A, ACME, METER, 1, 100, 0)), 1, "seq")
    accounts = store.read("ledger_account")
    wrong = store.read("account_balance").withColumn(
        "balance_minor", F.col("balance_minor") + 1
    )
    report = ledger.verify(
        store.read("tenant"),
        ledger.balances(wrong, accounts),
        ledger.recomputed_balances(store.read("ledger_entry"), accounts),
    )
    assert {r.tenant_id: r.discrepancies for r in report.collect()} == {ACME: 3, GLOBEX: 0, INITECH: 0}


def test_invoice_run_and_outbox(store, charges):
    post_batch(
        store,
        delivered(charges, (A, ACME, METER, 1_500_000, 40_000, 0), (B, ACME, METER, 1, 9, 40)),
        1, "seq",
    )
    headers = {r.tenant_id: r for r in invoice_run(store, "2026-07", 2).collect()}
    assert (headers[ACME].total_minor, headers[ACME].tax_minor) == (44_000, 4_000)
    assert headers[GLOBEX].total_minor == 0
    line = store.read("invoice_line").collect()
    assert [(r.invoice_id, r.quantity, r.amount_minor) for r in line] == [
        (headers[ACME].id, 1_500_000, 40_000)
    ]
    # Nothing is billed twice: the next run finds no charges.
    rerun = invoice_run(store, "2026-07", 3, run=2)
    assert {r.total_minor for r in rerun.collect()} == {0}
    assert {r.id for r in rerun.collect()}.isdisjoint({h.id for h in headers.values()})

    sent = []
    send = lambda rows: sent.extend(rows.collect())
    assert relay_run(store, send, 4) == 6
    assert relay_run(store, send, 5) == 0
    assert len(sent) == 6 and headers[ACME].id in {r.key for r in sent}
    assert verify_store(store).filter("not all_match").isEmpty()


def test_late_charges_get_invoices_of_their_own(store, charges):
    sent = []
    send = lambda rows: sent.extend(r.key for r in rows.collect())
    post_batch(store, delivered(charges, (A, ACME, METER, 1, 100, 0)), 1, "seq")
    first = {r.tenant_id: r for r in invoice_run(store, "2026-07", 1).collect()}
    assert relay_run(store, send, 1) == 3
    post_batch(store, delivered(charges, (B, ACME, METER, 1, 500, 0)), 2, "seq")
    late = {r.tenant_id: r for r in invoice_run(store, "2026-07", 2).collect()}
    assert (first[ACME].total_minor, late[ACME].total_minor) == (110, 550)
    assert first[ACME].id != late[ACME].id
    assert relay_run(store, send, 2) == 3 and late[ACME].id in sent and len(set(sent)) == 6
    assert store_faults(store).isEmpty()
    # The same numbers answer as before.
    assert {r.id for r in invoice_run(store, "2026-07", 1).collect()} == {r.id for r in first.values()}
    assert relay_run(store, send, 2) == 3 and len(sent) == 6


def test_an_invoice_number_names_one_period(store, charges):
    post_batch(store, delivered(charges, (A, ACME, METER, 1, 100, 0)), 1, "seq")
    invoice_run(store, "2026-07", 1)
    with pytest.raises(ValueError, match="2026-07:1"):
        invoice_run(store, "2026-08", 1)
    with pytest.raises(ValueError, match="2026-07:1"):
        invoice_run(store, "2026-07", 1, run=2)
    with pytest.raises(ValueError, match="another number"):
        invoice_run(store, "2026-07", 2, run=1)
    assert store.read("invoice").count() == 3


def test_a_failed_invoice_run_leaves_its_run_free(store, charges, monkeypatch):
    post_batch(store, delivered(charges, (A, ACME, METER, 1, 100, 0)), 1, "seq")
    monkeypatch.setattr(store, "commit", lambda *_, **__: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        invoice_run(store, "2026-07", 1)
    monkeypatch.undo()
    headers = {r.tenant_id: r.total_minor for r in invoice_run(store, "2026-07", 2).collect()}
    assert headers[ACME] == 110 and store.read("invoice").count() == 3
    assert store.read("invoice_charge_link").count() == 1


@pytest.mark.parametrize("row", [(A, ACME, METER, 1, 999, 0), (A, ACME, METER, 2, 100, 0)])
def test_a_number_is_refused_with_other_amounts(store, charges, row):
    post_batch(store, delivered(charges, (A, ACME, METER, 1, 100, 0)), 1, "seq")
    with pytest.raises(ValueError, match="other charges"):
        post_batch(store, delivered(charges, row), 1, "seq")
    with pytest.raises(ValueError, match="other charges"):
        post_batch(store, delivered(charges, (A, ACME, METER, 1, 100, 0), (A, ACME, METER, 1, 100, 0)), 1, "seq")


def test_repeated_keys_are_faults(spark):
    rows = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "c")], "id string, tenant_id string")
    found = ledger.repeated_keys({"invoice": rows}).collect()
    assert [tuple(r) for r in found] == [("invoice", "key_not_unique", "1")]


def test_batch_numbers_belong_to_a_writer(store, charges):
    post_batch(store, delivered(charges, (A, ACME, METER, 1, 100, 0)), 0, "seq")
    invoice_run(store, "2026-07", 0)
    other = delivered(charges, (B, ACME, METER, 1, 50, 0))
    assert outcomes(post_batch(store, other, 0, "seq", writer="stream:x")) == {B: (1, 0)}
    assert store.read("billed_charge").count() == 2
    with pytest.raises(ValueError, match="other charges"):
        post_batch(store, delivered(charges, (C, ACME, METER, 1, 1, 0)), 0, "seq")
    assert verify_store(store).filter("not all_match").isEmpty()


def test_a_failed_try_leaves_nothing(store, charges, monkeypatch):
    monkeypatch.setattr(store, "commit", lambda *_, **__: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        post_batch(store, delivered(charges, (A, ACME, METER, 1, 999, 0), (B, ACME, METER, 1, 5, 40)), 1, "seq")
    monkeypatch.undo()
    post_batch(store, delivered(charges, (B, ACME, METER, 1, 5, 40)), 1, "seq")
    assert [r.charge_id for r in store.read("billed_charge").collect()] == [B]
    assert store.read("ledger_entry").count() == 3
    assert verify_store(store).filter("not all_match").isEmpty()


def test_batches_may_come_out_of_order(store, charges):
    post_batch(store, delivered(charges, (A, ACME, METER, 1, 100, 0)), 5, "seq")
    post_batch(store, delivered(charges, (B, ACME, METER, 1, 30, 0)), 3, "seq")
    post_batch(store, delivered(charges, (C, ACME, METER, 1, 7, 0)), 4, "seq")
    assert verify_store(store).filter("not all_match").isEmpty()


def test_each_currency_is_invoiced(store, charges):
    both = delivered(charges, (A, ACME, METER, 1, 100, 0), (B, ACME, METER, 1, 700, 0)).withColumn(
        "currency", F.when(F.col("charge_id") == B, "NZD").otherwise(F.col("currency"))
    )
    post_batch(store, both, 1, "seq")
    headers = {(r.tenant_id, r.currency): r for r in invoice_run(store, "2026-07", 1).collect()}
    assert headers[ACME, "AUD"].total_minor == 110 and headers[ACME, "NZD"].total_minor == 770
    links = {r.charge_id: r.invoice_id for r in store.read("invoice_charge_link").collect()}
    assert links == {A: headers[ACME, "AUD"].id, B: headers[ACME, "NZD"].id}
    assert {(r.invoice_id, r.currency) for r in store.read("invoice_line").collect()} == {
        (headers[ACME, c].id, c) for c in ("AUD", "NZD")
    }


def test_relay_drains_the_outbox_once(store, spark):
    rows = spark.range(250).select(
        F.format_string("%03d", "id").alias("id"), F.lit(ACME).alias("tenant_id"),
        F.lit("invoice").alias("aggregate_type"), F.col("id").cast("string").alias("aggregate_id"),
        F.lit("invoice.created").alias("event_type"), F.lit("{}").alias("payload"),
        F.current_timestamp().alias("created_at"),
    )
    attempt = store.begin()
    store.write("outbox", rows, attempt)
    store.commit("loading", 1, attempt)
    sizes, keys = [], []

    def send(batch):
        got = [r.key for r in batch.collect()]
        if len(sizes) == 1 and not keys[100:]:
            keys.append("broken")
            raise OSError("broker is away")
        sizes.append(len(got))
        keys.extend(got)

    with pytest.raises(OSError):
        relay_run(store, send, 1)
    keys.remove("broken")
    keys.append("")
    assert relay_run(store, send, 1) == 250 and sizes == [100, 100, 50]
    assert relay_run(store, send, 1) == 250 and sizes == [100, 100, 50]
    assert relay_run(store, send, 2) == 0
    assert len(set(keys) - {""}) == 250 and store.read("published_log").count() == 250


def test_relay_takes_the_oldest_first(spark):
    rows = spark.createDataFrame(
        [(f"{i:03d}", 500 - i) for i in range(150)], "id string, created_at int"
    )
    published = spark.createDataFrame([("149",)], "id string")
    ids = [r.id for r in outbox.pending(rows, published).collect()]
    assert ids == [f"{i:03d}" for i in range(148, 48, -1)]


def test_recent_transactions_limits(spark):
    rows = spark.createDataFrame(
        [(f"{i:04d}", t, i) for t in "ab" for i in range(600)],
        "id string, tenant_id string, created_at int",
    )
    assert ledger.recent_transactions(rows, 9999).count() == 1000
    assert ledger.recent_transactions(rows, -3).count() == 2
    newest = ledger.recent_of_tenant(rows, "a", 3).collect()
    assert [r.id for r in newest] == ["0599", "0598", "0597"]
    plan = ledger.recent_transactions(rows, 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def plan_of(rows) -> str:
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_sound_references_do_not_read_the_rows_again(spark):
    """Rows are joined to missing parents only if some are missing."""
    parents = spark.createDataFrame([("a",), ("b",)], "id string")
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "n int, parent string")
    key = F.col("n").cast("string")
    sound = ledger.missing_parents(rows, "parent", parents, "id", "child", key)
    assert "Join" not in plan_of(sound) and sound.isEmpty()
    odd = rows.union(spark.createDataFrame([(5, "c"), (6, "c")], rows.schema))
    found = ledger.missing_parents(odd, "parent", parents, "id", "child", key).collect()
    assert sorted((r.table_name, r.rule, r.row_key) for r in found) == [
        ("child", "parent_unknown", "5"), ("child", "parent_unknown", "6")
    ]


def test_drifted_balances_are_found_without_a_join_of_entries(spark, tmp_path):
    """One tenant has charges of 1998, one has not; entries are not joined to the lost ones."""
    from datetime import datetime

    from checks.ledger import verify_drifted

    days = {1: datetime(1998, 5, 1), 2: datetime(1997, 5, 1)}
    spark.createDataFrame(
        [(c, f"c{c}", "BUILDING") for c in days], "c_custkey long, c_name string, c_mktsegment string"
    ).write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(
        [(c, c, "1-URGENT") for c in days], "o_orderkey long, o_custkey long, o_orderpriority string"
    ).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(
        [(c, 1, 7, 30.0, "R", "F", day) for c, day in days.items()],
        "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_returnflag string, "
        "l_linestatus string, l_shipdate timestamp",
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = verify_drifted(spark, str(tmp_path))
    assert "LeftAnti" not in plan_of(found)
    got = {r.tenant_id: (r.all_match, r.discrepancies) for r in found.collect()}
    assert got == {"1": (False, 2), "2": (True, 0)}


def test_reconcile_sums_entries_by_charge_and_invoices_need_no_join(spark, charges):
    """Invoices of what has lines are those of the lines' own keys; entries meet the links summed."""
    book = book_of(charges((A, ACME, METER, 10, 1005, 0), (B, ACME, METER, 1, 5, 1), (C, GLOBEX, METER, 3, 25, 40)))
    billed = invoicing.in_period(book.billed)
    lines = invoicing.invoice_lines(billed)
    headers = invoicing.invoices(lines)
    assert "Join" not in plan_of(headers)
    due = lines.select("tenant_id", "period", "currency").distinct()
    assert sorted(headers.collect()) == sorted(invoicing.invoices(lines, due).collect())
    links = invoicing.charge_links(billed)
    # Entries come in several parts of one type, and a charge may be linked twice.
    entries = book.entries.unionByName(book.entries)
    found = invoicing.reconcile(links.unionByName(links.filter(F.col("charge_id") == A)), entries, headers)
    got = {r.tenant_id: (r.posted_revenue_minor, r.posted_tax_minor, r.tax_difference_minor) for r in found.collect()}
    assert got == {ACME: (4 * 1005 + 2 * 5, 4 * 100 + 2 * 0, 101 - 400), GLOBEX: (2 * 25, 2 * 2, 2 - 4)}


def test_reconcile_shuffles_ids_as_bytes(spark, charges):
    """A UUID takes 16 bytes in a shuffle, and other ids, absent ones and repeated invoices are told apart."""
    odd = B.replace("-", "")
    book = book_of(charges((A, ACME, METER, 10, 1005, 0), (odd, GLOBEX, METER, 1, 50, 1), (B.upper(), GLOBEX, METER, 1, 70, 2)))
    links = spark.createDataFrame(
        [(A, C), (odd, "inv-1"), (B.upper(), C.upper()), (None, C), (A, None)], "charge_id string, invoice_id string"
    )
    headers = spark.createDataFrame(
        [(i, t, 1000, 100) for i, t in ((C, ACME), ("inv-1", GLOBEX), ("inv-1", ACME), (C.upper(), GLOBEX), (None, ACME))],
        "id string, tenant_id string, net_minor bigint, tax_minor bigint",
    )
    found = invoicing.reconcile(links, book.entries, headers)
    got = {(r.invoice_id, r.tenant_id): (r.posted_revenue_minor, r.posted_tax_minor) for r in found.collect()}
    assert got == {
        (C, ACME): (1005, 100), ("inv-1", GLOBEX): (50, 5), ("inv-1", ACME): (50, 5), (C.upper(), GLOBEX): (70, 7), (None, ACME): (0, 0),
    }
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(charge#" in plan and "hashpartitioning(invoice#" in plan
    assert "hashpartitioning(charge_id#" not in plan and "hashpartitioning(invoice_id#" not in plan


def test_invoice_id_is_hashed_once(spark):
    """The id of another currency's invoice has the currency; neither is made in a branch."""
    from tallywork.functions.keys import natural_id

    rows = spark.createDataFrame([("t", "2026-07", c) for c in ("AUD", "NZD", None)], "t string, p string, c string")
    made = rows.select("c", invoicing.invoice_id(F.col("t"), F.col("p"), 2, F.col("c")).alias("id"))
    text = made._jdf.queryExecution().analyzed().toString()
    assert "ELSE concat(" not in text and "THEN concat(" not in text
    got = {r.c: r.id for r in made.collect()}
    plain, foreign = rows.select(
        natural_id(F.lit("t"), F.lit("2026-07"), F.lit(2)), natural_id(F.lit("t"), F.lit("2026-07"), F.lit(2), F.lit("NZD"))
    ).first()
    assert got == {"AUD": plain, "NZD": foreign, None: plain}
