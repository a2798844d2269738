"""Double-entry posting of charges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywork import schemas
from tallywork.functions.keys import iso_instant, natural_id
from tallywork.functions.money import gst
from tallywork.functions.windows import period_of

# Outcomes of posting a charge.
POSTED, DUPLICATE = "POSTED", "DUPLICATE"


def signed_amount() -> Column:
    """Debit-positive amount of an entry."""
    return F.when(F.col("direction") == "DEBIT", F.col("amount_minor")).otherwise(
        -F.col("amount_minor")
    )


def opposite(direction: Column) -> Column:
    return F.when(direction == "DEBIT", "CREDIT").when(direction == "CREDIT", "DEBIT")


def normal_side(account_type: Column) -> Column:
    """The side on which an account of this type normally has its balance."""
    return F.when(account_type == "RECEIVABLE", "DEBIT").when(
        account_type.isin("REVENUE", "CREDITS", "TAX"), "CREDIT"
    )


def account_id(tenant_id: Column, account_type: Column, currency: Column) -> Column:
    """Account identifier, a function of the account's natural key."""
    return natural_id(tenant_id, account_type, currency)


def posting_lines(charges: DataFrame) -> DataFrame:
    """Three balanced lines per charge; lines of zero are kept.

    An ``explode`` of three structs: narrow, no shuffle.
    """

    def line(number: int, direction: str, kind: str, amount: Column) -> Column:
        return F.struct(
            F.lit(number).alias("line_no"),
            F.lit(direction).alias("direction"),
            F.lit(kind).alias("account_type"),
            amount.alias("amount_minor"),
        )

    net, tax = F.col("amount_minor"), F.col("tax_minor")
    taxed = charges.withColumn("tax_minor", gst(net))
    lines = F.array(
        line(1, "DEBIT", "RECEIVABLE", net + tax),
        line(2, "CREDIT", "REVENUE", net),
        line(3, "CREDIT", "TAX", tax),
    )
    keep = [F.col("charge_id").alias("transaction_id"), "tenant_id", "currency"]
    if "billing_month" in charges.columns:
        keep.append("billing_month")
    return taxed.select(*keep, F.explode(lines).alias("line")).select(
        *[c if isinstance(c, str) else "transaction_id" for c in keep], "line.*"
    )


def to_entries(lines: DataFrame) -> DataFrame:
    """Posting lines with their account, which needs no lookup: its id is derived."""
    return lines.withColumn(
        "account_id", account_id(F.col("tenant_id"), F.col("account_type"), F.col("currency"))
    )


def transaction_headers(charges: DataFrame) -> DataFrame:
    """One ledger transaction per charge; the charge id is the transaction id.

    ``created_at`` and ``billing_month`` are kept where the charges have them.
    """
    kept = [c for c in ("created_at", "billing_month") if c in charges.columns]
    description = F.concat(
        F.lit("usage charge: meter="),
        F.col("meter_code"),
        F.lit(" window=["),
        iso_instant(F.col("window.start")),
        F.lit(","),
        iso_instant(F.col("window.end")),
        F.lit(") qty="),
        F.col("quantity_billed").cast("string"),
        F.lit(" plan=v"),
        F.col("plan_version").cast("string"),
    )
    return charges.select(
        F.col("charge_id").alias("id"),
        "tenant_id",
        description.alias("description"),
        F.col("charge_id").alias("source_charge_id"),
        *kept,
    )


def invalid_postings(lines: DataFrame) -> DataFrame:
    """Transactions that may not be posted, with the rule they break.

    Two lines at least, one currency, no negative amount, debits equal credits.
    One shuffle by transaction with partial sums; currencies are compared by
    minimum and maximum, which needs no distinct.
    """
    summary = lines.groupBy("transaction_id").agg(
        F.count(F.lit(1)).alias("line_count"),
        F.min("currency").alias("_low"),
        F.max("currency").alias("_high"),
        F.min("amount_minor").alias("_least"),
        F.sum(F.when(F.col("direction") == "DEBIT", F.col("amount_minor")).otherwise(0)).alias(
            "debit_minor"
        ),
        F.sum(F.when(F.col("direction") == "CREDIT", F.col("amount_minor")).otherwise(0)).alias(
            "credit_minor"
        ),
    )
    problem = (
        F.when(F.col("line_count") < 2, "not_double_entry")
        .when(F.col("_low") != F.col("_high"), "mixed_currency")
        .when(F.col("_least") < 0, "negative_amount")
        .when(F.col("debit_minor") != F.col("credit_minor"), "unbalanced")
    )
    return (
        summary.withColumn("violation", problem)
        .filter(F.col("violation").isNotNull())
        .select("transaction_id", "line_count", "debit_minor", "credit_minor", "violation")
    )


def first_deliveries(charges: DataFrame, order: str) -> DataFrame:
    """One row per charge id, the first delivered by ``order``.

    A ``min`` of a struct instead of a row number: copies of one charge collapse
    before the shuffle, however many there are.
    """
    rest = [c for c in charges.columns if c not in ("charge_id", order)]
    # Maps cannot be compared, so they travel as sorted entries.
    is_map = {c for c in rest if charges.schema[c].dataType == schemas.DIMENSIONS}
    packed = [F.map_entries(c).alias(c) if c in is_map else F.col(c) for c in rest]
    first = charges.groupBy("charge_id").agg(F.min(F.struct(order, *packed)).alias("f"))
    unpacked = [
        (F.map_from_entries(f"f.{c}") if c in is_map else F.col(f"f.{c}")).alias(c) for c in rest
    ]
    return first.select("charge_id", F.col(f"f.{order}").alias(order), *unpacked).select(
        *charges.columns
    )


def new_charges(charges: DataFrame, order: str, posted_ids: DataFrame) -> DataFrame:
    """First deliveries of charges not posted before; ``posted_ids`` has ``charge_id``."""
    return first_deliveries(charges, order).join(posted_ids, "charge_id", "left_anti")


def post_outcomes(charges: DataFrame, posted_ids: DataFrame) -> DataFrame:
    """Per charge id: how often it was posted (0 or 1) and how often it was a duplicate.

    ``conflicting`` marks ids delivered with different amounts: the first one
    stays, as the id does not depend on the amount.
    """
    deliveries = charges.groupBy("tenant_id", "charge_id").agg(
        F.count(F.lit(1)).alias("deliveries"),
        (F.min("amount_minor") != F.max("amount_minor")).alias("conflicting"),
    )
    known = posted_ids.select("charge_id", F.lit(0).cast("bigint").alias("_none"))
    posted = F.coalesce(F.col("_none"), F.lit(1).cast("bigint"))
    return deliveries.join(known, "charge_id", "left").select(
        "tenant_id",
        "charge_id",
        posted.alias("posted"),
        (F.col("deliveries") - posted).alias("duplicates"),
        "conflicting",
    )


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """Deliveries per tenant and outcome."""
    sums = outcomes.groupBy("tenant_id").agg(
        F.sum("posted").alias(POSTED), F.sum("duplicates").alias(DUPLICATE)
    )
    return sums.unpivot("tenant_id", [POSTED, DUPLICATE], "outcome", "charges").filter(
        F.col("charges") > 0
    )


def billed_charges(charges: DataFrame) -> DataFrame:
    """Charges as the ledger keeps them for invoicing, with the month they are filed under."""
    return charges.select(
        "charge_id",
        "tenant_id",
        "meter_code",
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        "quantity_billed",
        "amount_minor",
        "currency",
        "plan_version",
        period_of(F.col("window.start")).alias("billing_month"),
    )


def needed_accounts(lines: DataFrame, existing: DataFrame) -> DataFrame:
    """Accounts the lines post to that do not exist yet."""
    wanted = lines.select("tenant_id", F.col("account_type").alias("type"), "currency").distinct()
    return wanted.join(existing, ["tenant_id", "type", "currency"], "left_anti").select(
        account_id(F.col("tenant_id"), F.col("type"), F.col("currency")).alias("id"),
        "tenant_id",
        "type",
        "currency",
    )
