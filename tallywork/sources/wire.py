"""The JSON wire format: decode text to typed rows, encode rows to keyed text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywork import schemas
from tallywork.functions.keys import iso_instant

CORRUPT = "corrupt_record"

# Wire contracts by topic. Money travels as a nested pair.
MONEY = T.StructType(
    [T.StructField("amountMinor", T.LongType()), T.StructField("currency", T.StringType())]
)
USAGE_TOPIC = "usage.events.v1"
READING_TOPIC = "usage.aggregates.v1"
CHARGE_TOPIC = "billing.charges.v1"
INVOICE_TOPIC = "invoice.created.v1"


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(part.capitalize() for part in rest)


def _wire_schema(table: T.StructType) -> T.StructType:
    fields = []
    for field in table.fields:
        if field.name == "amount_minor":
            fields.append(T.StructField("amount", MONEY))
        elif field.name == "currency" and "amount_minor" in table.names:
            continue
        else:
            fields.append(T.StructField(_camel(field.name), field.dataType))
    return T.StructType(fields)


def decode(raw: DataFrame, table: T.StructType, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Split raw JSON text into typed rows and a quarantine of malformed text.

    Unknown fields are ignored. Text that does not parse, or whose fields have
    the wrong type, goes to the quarantine with the original value. The parse is
    one projection, so both outputs work on streams.
    """
    schema = _wire_schema(table).add(CORRUPT, T.StringType())
    parsed = raw.withColumn(
        "row",
        F.from_json(
            F.col(value).cast("string"),
            schema,
            {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT},
        ),
    )
    bad = F.col("row").isNull() | F.col(f"row.{CORRUPT}").isNotNull()
    columns: list[Column] = []
    for field in table.fields:
        if field.name == "amount_minor":
            source = "row.amount.amountMinor"
        elif field.name == "currency" and "amount_minor" in table.names:
            source = "row.amount.currency"
        else:
            source = f"row.{_camel(field.name)}"
        columns.append(F.col(source).alias(field.name))
    good = parsed.filter(~bad).select(*columns)
    return good, parsed.filter(bad).drop("row")


def _wire_column(field: T.StructField) -> Column:
    column = F.col(field.name)
    if isinstance(field.dataType, T.TimestampType):
        column = iso_instant(column)
    elif field.dataType == schemas.WINDOW:
        column = F.struct(
            iso_instant(column["start"]).alias("start"), iso_instant(column["end"]).alias("end")
        )
    return column.alias(_camel(field.name))


def encode_value(table: T.StructType) -> Column:
    """A row of ``table`` as JSON text."""
    columns = []
    for field in table.fields:
        if field.name == "amount_minor":
            columns.append(
                F.struct(
                    F.col("amount_minor").alias("amountMinor"), F.col("currency").alias("currency")
                ).alias("amount")
            )
        elif field.name == "currency" and "amount_minor" in table.names:
            continue
        else:
            columns.append(_wire_column(field))
    return F.to_json(F.struct(*columns))


def encode(rows: DataFrame, table: T.StructType, key: str = "tenant_id") -> DataFrame:
    """Rows as ``(key, value)`` text pairs; the key decides the topic partition."""
    return rows.select(F.col(key).alias("key"), encode_value(table).alias("value"))
