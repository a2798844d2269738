"""Connected components of links, by labels that shrink to the smallest id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywork.session import staged


BROADCAST_ROWS = 1 << 20


def few(rows: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint at a broadcast of narrow rows that were written, counted and found to be few.

    Beyond the limit the join shuffles, and Spark splits its skewed partitions.
    """
    return F.broadcast(rows) if rows.count() <= limit else rows


def components(links: DataFrame) -> DataFrame:
    """``node, comp`` for every node of the links ``a, b``: the smallest id it is connected with.

    Every round takes the smallest label among a node's neighbours, then the label of its label, so
    paths halve; each round is written, so a lost executor costs one round. Nothing is gathered.
    """
    pairs = links.where("a <> b").select("a", "b")
    edges = staged(pairs.union(pairs.select("b", "a")).distinct())
    labels = staged(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp")))
    while True:
        known = few(labels)
        near = edges.join(known, edges.b == known.node).groupBy("a").agg(F.min("comp").alias("near"))
        near = few(staged(near))
        lower = labels.join(near, labels.node == near.a, "left").select(
            "node", F.col("comp").alias("old"), F.least("comp", F.coalesce("near", "comp")).alias("comp")
        )
        lower = staged(lower)
        above = few(lower.select(F.col("node").alias("up"), F.col("comp").alias("top")))
        labels = staged(
            lower.join(above, F.col("comp") == F.col("up"), "left").select(
                "node", "old", F.least("comp", F.coalesce("top", "comp")).alias("comp")
            )
        )
        if labels.where("comp <> old").isEmpty():
            return labels.select("node", "comp")
        labels = labels.select("node", "comp")


def merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """``doc_id, comp`` after more links ``a, b`` between documents of ``comps``."""
    left = few(comps.select(F.col("doc_id").alias("a"), F.col("comp").alias("ca")))
    right = few(comps.select(F.col("doc_id").alias("b"), F.col("comp").alias("cb")))
    between = links.join(left, "a").join(right, "b").where("ca <> cb")
    between = staged(between.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
    if between.isEmpty():
        return comps
    joined = few(components(between).select(F.col("node").alias("was"), F.col("comp").alias("now")))
    return staged(
        comps.join(joined, comps.comp == joined.was, "left").select("doc_id", F.coalesce("now", "comp").alias("comp"))
    )
