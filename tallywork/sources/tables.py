"""Ledger tables as parquet, written one attempt at a time and made visible by a commit.

Layout: ``<root>/<table>/billing_month=YYYY-MM/attempt=A`` for tables that carry
a month, ``<root>/<table>/attempt=A`` otherwise, and one commit row per finished
batch under ``<root>/_commits``. A batch is named by its writer and a number, so
posting, invoicing and relaying have numbers of their own. Every try of a batch
writes under a new attempt; the commit names the one that counts, and what
a failed try left stays invisible for good. Commits are numbered in the order
they were made. One process writes to a ledger at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywork import schemas

MONTH = "billing_month"
ATTEMPT = "attempt"

COMMIT = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("writer", T.StringType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField(ATTEMPT, T.StringType()),
        T.StructField("posted", T.BooleanType()),
        T.StructField("content", T.StringType()),
    ]
)

TABLES: dict[str, T.StructType] = {
    "tenant": schemas.TENANT,
    "ledger_account": schemas.LEDGER_ACCOUNT,
    "ledger_transaction": schemas.LEDGER_TRANSACTION,
    "ledger_entry": schemas.LEDGER_ENTRY,
    "account_balance": schemas.ACCOUNT_BALANCE,
    "billed_charge": schemas.BILLED_CHARGE,
    "invoice": schemas.INVOICE,
    "invoice_line": schemas.INVOICE_LINE,
    "invoice_charge_link": schemas.INVOICE_CHARGE_LINK,
    "outbox": schemas.OUTBOX,
    "published_log": schemas.PUBLISHED_LOG,
    "sighting": schemas.SIGHTING,
    "sighting_filter": schemas.SIGHTING_FILTER,
    "bucket_level": schemas.BUCKET_LEVEL,
}
# Columns that lay out a table beside month and attempt.
LAYOUT = {
    "sighting": [
        T.StructField("day", T.DateType()),
        T.StructField("of_buckets", T.IntegerType()),
        T.StructField("bucket", T.IntegerType()),
    ],
    "sighting_filter": [T.StructField("day", T.DateType())],
}
BY_MONTH = {"ledger_transaction", "ledger_entry", "billed_charge", "invoice_charge_link"}


class TableStore:
    """Reads committed batches and writes new ones."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _schema(self, table: str) -> T.StructType:
        fields = list(TABLES[table].fields)
        if table in BY_MONTH:
            fields.append(T.StructField(MONTH, T.StringType()))
        fields.extend(LAYOUT.get(table, []))
        fields.append(T.StructField(ATTEMPT, T.StringType()))
        return T.StructType(fields)

    def _read(self, path: str, schema: T.StructType) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], schema)

    def commits(self) -> DataFrame:
        """One row per visible batch; ``posted`` marks those that left a balance snapshot."""
        return self._read(f"{self.root}/_commits", COMMIT).select(*COMMIT.names)

    def committed(self, writer: str, batch_id: int) -> Row | None:
        """The commit of a writer's batch, if it was made."""
        mine = (F.col("writer") == writer) & (F.col("batch_id") == batch_id)
        return self.commits().filter(mine).first()

    def begin(self) -> str:
        """The name of a new try."""
        return uuid.uuid4().hex

    def last_posted(self) -> str | None:
        """The attempt that left the newest balance snapshot, by order of commit."""
        posted = self.commits().filter("posted")
        return posted.agg(F.max_by(ATTEMPT, "seq")).first()[0]

    def read(self, table: str, months: Iterable[str] | None = None) -> DataFrame:
        """Committed rows. ``months`` prunes partitions of the tables laid out by month."""
        rows = self._read(f"{self.root}/{table}", self._schema(table))
        if months is not None and table in BY_MONTH:
            rows = rows.filter(F.col(MONTH).isin(list(months)))
        return rows.join(self.commits().select(ATTEMPT), ATTEMPT, "left_semi").drop(ATTEMPT)

    def read_attempts(self, table: str) -> DataFrame:
        """All rows with the attempt that wrote them, committed or not."""
        return self._read(f"{self.root}/{table}", self._schema(table))

    def read_attempt(self, table: str, attempt: str | None) -> DataFrame:
        """Rows of one attempt, committed or not; for the writer itself."""
        return self.read_attempts(table).filter(F.col(ATTEMPT) == attempt).drop(ATTEMPT)

    def write(self, table: str, rows: DataFrame, attempt: str) -> None:
        """Write the part of ``table`` that belongs to an attempt."""
        names = [f.name for f in self._schema(table).fields if f.name != ATTEMPT]
        keys = [*([MONTH] if table in BY_MONTH else []), *(f.name for f in LAYOUT.get(table, [])), ATTEMPT]
        columns = [F.col(n).cast(self._schema(table)[n].dataType).alias(n) for n in names]
        (
            rows.select(*columns, F.lit(attempt).alias(ATTEMPT))
            .write.mode("append")
            .partitionBy(*keys)
            .parquet(f"{self.root}/{table}")
        )

    def commit(
        self, writer: str, batch_id: int, attempt: str, posted: bool = False, content: str = ""
    ) -> None:
        """Make the attempt visible; the last step of a run. A number is committed once."""
        seq = self.commits().agg(F.coalesce(F.max("seq") + 1, F.lit(0))).first()[0]
        row = self.spark.createDataFrame([(seq, writer, batch_id, attempt, posted, content)], COMMIT)
        row.coalesce(1).write.mode("errorifexists").parquet(f"{self.root}/_commits/part={seq}")
