"""The corpus pipeline: documents to packed sequences, in stages that each read what the last one wrote.

A stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of
``documents``; rows they keep are as they came.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywork.llm import contamination, exactdedup, jaccard, packing, quality
from tallywork.llm.graph import few
from tallywork.llm.queries import table, vocabulary
from tallywork.session import checkpoint_dir, staged

GROUP_ROWS = 1 << 18  # groups of equal texts, of 48 bytes each, that may be sent to every task


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.classify(docs, model).where(F.col("score") >= quality.THRESHOLD).select("row.*")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, whatever its other rows' ids.

    The row is the longest of those with the group's ``keep_id``, which may be null or name several rows; of
    equally long ones the smallest by its columns, so equal rows leave one.
    """
    groups = exactdedup.exact_groups(docs).where("group_size > 1").groupBy(F.unhex("text_sha256").alias("sha"))
    of_keep = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    groups = staged(groups.agg(F.first("keep_id").alias("keep_id"), F.count_if(of_keep).alias("same")))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    for space in exactdedup.SPACES:
        text = F.replace(text, F.lit(space), F.lit(""))
    keyed = docs.select(F.struct("*").alias("row"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("own_sha"))
    met = keyed.join(few(groups, GROUP_ROWS), F.col("own_sha") == F.col("sha"), "left")
    chosen = F.col("row.doc_id").cast("long").eqNullSafe(F.col("keep_id"))
    kept = met.where(F.col("sha").isNull() | (chosen & (F.col("same") == 1))).select("row.*")
    if groups.where("same > 1").isEmpty():
        return kept
    # Only where an id names several rows of a group are rows compared.
    shorter = -F.coalesce(F.length("row.text"), F.lit(0))
    tied = met.where(chosen & (F.col("same") > 1)).groupBy("sha").agg(F.min(F.struct(shorter.alias("shorter"), "row")).alias("best"))
    return kept.unionByName(tied.select("best.row.*"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of linked documents."""
    groups = jaccard.near_duplicates(docs)
    dropped = few(staged(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("dropped_id")).distinct()))
    return docs.join(dropped, docs.doc_id == dropped.dropped_id, "left_anti")


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    found = contamination.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    dirty = contamination.is_contaminated(F.col("found.n_words"), F.col("found.n_hit"))
    return found.where(~dirty).select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents and their places in sequences."""
    return packing.packed_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("exact", exact_stage),
    ("near", near_stage),
    ("benchmark", benchmark_stage),
    ("packing", packing_stage),
]

# The classifier learns numerically; SQL can't state its decisions. Tests use a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
