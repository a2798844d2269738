"""Ledger queries, balances and verification, for all tenants at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywork import schemas
from tallywork.operators.posting import normal_side, signed_amount
from tallywork.session import staged

MAX_RECENT = 500
DEFAULT_RECENT = 50


def scoped(rows: DataFrame, tenant_id: str | None) -> DataFrame:
    """Rows of one tenant. Without a tenant there are none: the scope fails closed."""
    return rows.filter(F.col("tenant_id") == F.lit(tenant_id).cast("string"))


def outside_scope(rows: DataFrame, tenant_id: str | None) -> DataFrame:
    """Rows a writer scoped to ``tenant_id`` may not write."""
    inside = F.col("tenant_id") == F.lit(tenant_id).cast("string")
    return rows.filter(~F.coalesce(inside, F.lit(False)))


def balance_deltas(entries: DataFrame) -> DataFrame:
    """Debit-positive change of each account."""
    return entries.groupBy("account_id", "tenant_id", "currency").agg(
        F.sum(signed_amount()).alias("balance_minor")
    )


def apply_deltas(previous: DataFrame, deltas: DataFrame) -> DataFrame:
    """The next balance snapshot: the previous one with the deltas added."""
    columns = ["account_id", "tenant_id", "currency", "balance_minor"]
    return (
        previous.select(*columns)
        .unionByName(deltas.select(*columns))
        .groupBy("account_id", "tenant_id", "currency")
        .agg(F.sum("balance_minor").alias("balance_minor"))
    )


def balances(balance: DataFrame, accounts: DataFrame) -> DataFrame:
    """Materialised balances with their account type, in type order per tenant."""
    named = accounts.select(F.col("id").alias("account_id"), "type")
    return (
        balance.join(named, "account_id")
        .select("tenant_id", "account_id", "type", "balance_minor", "currency")
        .orderBy("tenant_id", "type")
    )


def recomputed_balances(entries: DataFrame, accounts: DataFrame) -> DataFrame:
    """Balances summed from the entries.

    Summed by account first, so the join to the accounts has one row per account.
    """
    sums = entries.groupBy("account_id").agg(F.sum(signed_amount()).alias("balance_minor"))
    named = accounts.select(F.col("id").alias("account_id"), "tenant_id", "type", "currency")
    return sums.join(named, "account_id").select(
        "tenant_id", "account_id", "type", "currency", "balance_minor"
    )


def on_normal_side(rows: DataFrame) -> DataFrame:
    """Balances as positive amounts on the normal side of their account type."""
    side = normal_side(F.col("type"))
    amount = F.when(side == "DEBIT", F.col("balance_minor")).otherwise(-F.col("balance_minor"))
    return rows.withColumn("normal_side", side).withColumn("normal_minor", amount)


def discrepancies(materialised: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Account types whose materialised and recomputed balances differ; missing counts as zero."""

    def by_type(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("tenant_id", "type").agg(F.sum("balance_minor").alias(name))

    zero = F.lit(0).cast("bigint")
    return (
        by_type(materialised, "materialised_minor")
        .join(by_type(recomputed, "recomputed_minor"), ["tenant_id", "type"], "full_outer")
        .select(
            "tenant_id",
            "type",
            F.coalesce("materialised_minor", zero).alias("materialised_minor"),
            F.coalesce("recomputed_minor", zero).alias("recomputed_minor"),
        )
        .filter(F.col("materialised_minor") != F.col("recomputed_minor"))
    )


def verify(tenants: DataFrame, materialised: DataFrame, recomputed: DataFrame) -> DataFrame:
    """One row per tenant: whether every balance matches. Tenants without entries match."""
    faults = (
        discrepancies(materialised, recomputed)
        .groupBy("tenant_id")
        .agg(F.count(F.lit(1)).alias("discrepancies"))
    )
    count = F.coalesce(F.col("discrepancies"), F.lit(0).cast("bigint"))
    return tenants.select(F.col("id").alias("tenant_id")).join(
        faults, "tenant_id", "left"
    ).select("tenant_id", (count == 0).alias("all_match"), count.alias("discrepancies"))


def unbalanced_transactions(entries: DataFrame) -> DataFrame:
    """Posted transactions that break the double-entry invariant."""
    from tallywork.operators.posting import invalid_postings

    return invalid_postings(entries)


def trial_balance(entries: DataFrame) -> DataFrame:
    """Signed total per tenant and currency, which must be zero."""
    return entries.groupBy("tenant_id", "currency").agg(
        F.sum(signed_amount()).alias("total_minor")
    )


def entry_lists(entries: DataFrame) -> DataFrame:
    """The entries of each transaction in line order. A transaction has a handful of lines."""
    line = F.struct("line_no", "account_type", "direction", "amount_minor", "currency")
    return entries.groupBy("transaction_id").agg(
        F.array_sort(F.collect_list(line)).alias("entries")
    )


def with_entries(headers: DataFrame, entries: DataFrame) -> DataFrame:
    """Transactions with their entries: one join for all of them."""
    chosen = entries.join(headers.select(F.col("id").alias("transaction_id")), "transaction_id")
    return headers.join(
        entry_lists(chosen).withColumnRenamed("transaction_id", "id"), "id", "left"
    )


def recent_transactions(transactions: DataFrame, limit: int = DEFAULT_RECENT) -> DataFrame:
    """The newest transactions of every tenant, newest first, at most 500 each.

    Spark cuts each tenant to the limit inside every task before the shuffle.
    """
    n = max(1, min(limit, MAX_RECENT))
    order = Window.partitionBy("tenant_id").orderBy(F.col("created_at").desc(), "id")
    return (
        transactions.withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= n)
    )


def recent_of_tenant(
    transactions: DataFrame, tenant_id: str | None, limit: int = DEFAULT_RECENT
) -> DataFrame:
    """The newest transactions of one tenant."""
    n = max(1, min(limit, MAX_RECENT))
    return scoped(transactions, tenant_id).orderBy(F.col("created_at").desc(), "id").limit(n)


def transaction(transactions: DataFrame, tenant_id: str | None, transaction_id: str) -> DataFrame:
    """One transaction of a tenant by id."""
    return scoped(transactions, tenant_id).filter(F.col("id") == transaction_id)


def tenant_ids(tenants: DataFrame) -> DataFrame:
    return tenants.select("id").orderBy("id")


# The columns of each table that must not be null.
REQUIRED = {
    "ledger_account": ("tenant_id", "type", "currency"),
    "ledger_transaction": ("tenant_id", "description"),
    "ledger_entry": (
        "transaction_id", "tenant_id", "account_id", "direction", "amount_minor", "currency",
    ),
    "account_balance": ("account_id", "tenant_id", "balance_minor", "currency"),
    "invoice": ("tenant_id", "period_start", "period_end", "currency", "total_minor", "tax_minor"),
    "invoice_line": (
        "invoice_id", "tenant_id", "meter_code", "quantity", "amount_minor", "currency",
    ),
    "invoice_charge_link": ("charge_id", "invoice_id"),
    "outbox": ("tenant_id", "aggregate_type", "aggregate_id", "event_type", "payload"),
    "billed_charge": (
        "tenant_id", "meter_code", "window_start", "window_end", "quantity_billed",
        "amount_minor", "currency", "plan_version",
    ),
}


def _faults(rows: DataFrame, table: str, rule: str, key: Column) -> DataFrame:
    return rows.select(
        F.lit(table).alias("table_name"), F.lit(rule).alias("rule"), key.alias("row_key")
    )


def row_faults(rows: DataFrame, table: str, key: Column, rules: dict[str, Column]) -> DataFrame:
    """Rows that break a rule or lack a required value, one row per fault, in one narrow pass."""
    missing = {f"{c}_missing": F.col(c).isNull() for c in REQUIRED[table] if c in rows.columns}
    broken = F.array(*[F.when(bad, rule) for rule, bad in {**missing, **rules}.items()])
    return rows.select(
        F.lit(table).alias("table_name"),
        F.explode(F.array_compact(broken)).alias("rule"),
        key.alias("row_key"),
    )


# What names a row of each table.
KEYS = {
    "ledger_account": ("id",),
    "ledger_transaction": ("id",),
    "ledger_entry": ("transaction_id", "line_no"),
    "account_balance": ("account_id",),
    "invoice": ("id",),
    "invoice_line": ("invoice_id", "meter_code"),
    "invoice_charge_link": ("charge_id",),
    "outbox": ("id",),
    "billed_charge": ("charge_id",),
}


def repeated_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """Keys that name several rows of a table, once each; copies collapse before the shuffle."""
    found = []
    for table, rows in tables.items():
        names = KEYS[table]
        counted = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > 1)
        found.append(_faults(counted, table, "key_not_unique", F.concat_ws("#", *names)))
    return reduce(DataFrame.unionByName, found)


def missing_parents(
    rows: DataFrame, column: str, parents: DataFrame, parent_key: str, table: str, key: Column
) -> DataFrame:
    """Rows whose reference points nowhere.

    References and parents are grouped together, once by value, so a parent that a third
    of the rows refer to is one value after the partial aggregation. What is missing is
    written down; only if there is any, which is not so in a sound table, the rows are
    read again and joined to it.
    """
    names = rows.select(F.col(column).alias(column), F.lit(True).alias("_asked"))
    known = parents.select(F.col(parent_key).alias(column), F.lit(False).alias("_asked"))
    missing = staged(
        names.unionByName(known)
        .filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.min("_asked").alias("_asked"))
        .filter("_asked")
        .select(column)
    )
    if missing.isEmpty():
        return _faults(rows.limit(0), table, f"{column}_unknown", key)
    return _faults(rows.join(missing, column, "left_semi"), table, f"{column}_unknown", key)


def integrity_faults(
    tenants: DataFrame,
    accounts: DataFrame,
    transactions: DataFrame,
    entries: DataFrame,
    invoices: DataFrame | None = None,
    balances: DataFrame | None = None,
    invoice_lines: DataFrame | None = None,
    links: DataFrame | None = None,
    outbox: DataFrame | None = None,
    billed: DataFrame | None = None,
) -> DataFrame:
    """Rows that break a reference, a required or allowed value, a sign or a uniqueness rule.

    Tables that are not given are not checked.
    """
    parents = {
        "tenant_id": tenants, "transaction_id": transactions, "account_id": accounts,
        "invoice_id": invoices,
    }
    id_key = F.col("id")
    checked = [
        ("ledger_account", accounts, id_key, {
            "type_not_allowed": ~F.col("type").isin(*schemas.ACCOUNT_TYPES),
        }),
        ("ledger_transaction", transactions, id_key, {}),
        ("ledger_entry", entries, F.concat_ws("#", "transaction_id", "line_no"), {
            "direction_not_allowed": ~F.col("direction").isin(*schemas.DIRECTIONS),
            "amount_negative": F.col("amount_minor") < 0,
        }),
        ("account_balance", balances, F.col("account_id"), {}),
        ("invoice", invoices, id_key, {"period_empty": F.col("period_end") <= F.col("period_start")}),
        ("invoice_line", invoice_lines, F.concat_ws("#", "invoice_id", "meter_code"), {}),
        ("invoice_charge_link", links, F.col("charge_id"), {}),
        ("outbox", outbox, id_key, {}),
        ("billed_charge", billed, F.col("charge_id"), {}),
    ]
    result = _faults(
        accounts.groupBy("tenant_id", "type", "currency")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1),
        "ledger_account", "account_not_unique", F.concat_ws("|", "tenant_id", "type", "currency"),
    )
    for table, rows, key, rules in checked:
        if rows is None:
            continue
        result = result.unionByName(row_faults(rows, table, key, rules))
        for column, parent in parents.items():
            if column in rows.columns and parent is not None:
                result = result.unionByName(missing_parents(rows, column, parent, "id", table, key))
    return result
