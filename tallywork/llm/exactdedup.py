"""Exact deduplication by counting filters of slots and remainders (CQF), see :mod:`tallywork.llm.slotfilter`.

Every partition builds such a filter of its texts' fingerprints, cut into segments of the fingerprint
space. Filters of one geometry merge without loss by merging their sorted remainders and adding counts.
Only texts whose fingerprint counts more than one are compared byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywork.llm.slotfilter import Geometry, SlotFilter, geometry, merged
from tallywork.llm.text import SPACE, blocks, bound_batches, flat
from tallywork.session import staged

BROADCAST_ROWS = 1 << 20  # duplicated fingerprints of 8 bytes each

SPACES = " \t\n\x0b\f\r"  # the characters of SPACE

SUSPECT = "doc_id long, points int, fp long, norm binary"
EVERY = "every"  # instead of the wanted fingerprints
SEGMENT = "segment int, slots long, homes binary, ends binary, digits binary, remainders binary"


def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Merge sorted ``(fingerprints, counts)`` runs; equal fingerprints add their counts."""
    prints = np.concatenate([p for p, _ in parts])
    counts = np.concatenate([c for _, c in parts])
    order = np.argsort(prints, kind="stable")
    prints, counts = prints[order], counts[order]
    if not len(prints):
        return prints, counts
    first = np.flatnonzero(np.append(True, prints[1:] != prints[:-1]))
    return prints[first], np.add.reduceat(counts, first)


def _build(batches: Iterator[pa.RecordBatch], shape: Geometry) -> Iterator[pa.RecordBatch]:
    """One filter of the whole partition, sent segment by segment."""
    prints, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for batch in batches:
        own = np.asarray(batch.column("fp")).view(np.uint64)
        got = np.unique(own, return_counts=True)
        prints, counts = merge([(prints, counts), (got[0], got[1].astype(np.int64))])
    segments = (prints // np.uint64(shape.width)).astype(np.int64) // shape.slots
    bounds = np.append(np.flatnonzero(np.diff(segments, prepend=-1)), len(segments))
    rows = [
        SlotFilter.build(shape, int(segments[a]), prints[a:b], counts[a:b]).row()
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())
    ]
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 4]
    names = ["segment", "slots", "homes", "ends", "digits", "remainders"]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)


def _repeated(rows: pa.Table, shape: Geometry) -> pa.Table:
    """What the filters of a segment count more than once together."""
    columns = (rows.column(c).to_pylist() for c in ("segment", "slots", "homes", "ends", "digits", "remainders"))
    filters = [SlotFilter(shape, *row) for row in zip(*columns)]
    found = [(prints[counts > 1], counts[counts > 1]) for prints, counts in merged(filters)]
    prints = np.concatenate([p for p, _ in found]) if found else np.zeros(0, np.uint64)
    counts = np.concatenate([c for _, c in found]) if found else np.zeros(0, np.int64)
    return pa.table({"fp": pa.array(prints.view(np.int64)), "n": pa.array(counts)})


def duplicated(prints: DataFrame) -> DataFrame:
    """``fp, n`` of the fingerprints counted more than once, by filters merged segment by segment.

    ``prints`` has one column ``fp`` and was written. There are as many segments as the rows ask for, about four
    million to each, so a merging task holds some 30 MB of filters however many rows there are, and copies
    collapse before the shuffle.
    """
    parts = prints.select(F.spark_partition_id().alias("part"))
    size = parts.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("part").alias("parts")).first()
    shape = geometry(size.rows, size.parts)
    filters = prints.select("fp").mapInArrow(lambda batches: _build(batches, shape), SEGMENT)
    return filters.groupBy("segment").applyInArrow(lambda rows: _repeated(rows, shape), "fp long, n long")


def _normalised(batches: Iterator[pa.RecordBatch], wanted) -> Iterator[pa.RecordBatch]:
    """What identifies each text without its white space; the bytes too, of the ``wanted`` fingerprints."""
    prints = wanted.value if hasattr(wanted, "value") else None
    for batch in batches:
        data, offsets, _ = flat(batch.column("text"))
        ids, points = batch.column("doc_id"), batch.column("points")
        for i, j in blocks(offsets):
            begin, end = int(offsets[i]), int(offsets[j])
            inside = ~SPACE[data[begin:end]]
            before = np.append(0, np.cumsum(inside))
            at = before[offsets[i : j + 1] - begin]
            kept = data[begin:end][inside].tobytes()
            view = memoryview(kept)
            cuts = at.tolist()
            texts = [view[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
            fp = np.fromiter((xxhash.xxh3_64_intdigest(t) for t in texts), np.uint64, len(texts))
            if wanted is None:
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(i, j - i),
                        points.slice(i, j - i),
                        pa.array(fp.view(np.int64)),
                        pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                    ],
                    ["doc_id", "points", "fp", "text_sha256"],
                )
                continue
            if wanted == EVERY:
                hits = np.arange(len(fp))
            elif len(prints):
                place = np.minimum(np.searchsorted(prints, fp), len(prints) - 1)
                hits = np.flatnonzero(prints[place] == fp)
            else:
                hits = np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(i, j - i).take(pa.array(hits)),
                    points.slice(i, j - i).take(pa.array(hits)),
                    pa.array(fp[hits].view(np.int64)),
                    pa.array([bytes(texts[k]) for k in hits.tolist()], pa.binary()),
                ],
                ["doc_id", "points", "fp", "norm"],
            )


def exact_groups(docs: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row of ``docs``.

    Null texts count as empty, and empty texts equal each other. Of equal texts the row with the
    most code points, then the smallest doc_id (null last) stays. Rows that repeat a doc_id are rows of
    their own; all that tie in length and id with the one that stays are kept. An empty table
    gives no rows. Other columns are ignored.

    The narrow pass runs once and is written. Texts are read again only to compare suspects: their
    fingerprints go to the readers as a sorted array when they are at most ``broadcast_rows`` (8 bytes
    each), else by a join.
    """
    bound_batches(docs)
    rows = docs.select(
        F.col("doc_id").cast("long"),
        F.coalesce(F.length("text"), F.lit(0)).alias("points"),
        F.col("text").cast("string").alias("text"),
    )
    narrow = staged(
        rows.mapInArrow(
            lambda batches: _normalised(batches, None), "doc_id long, points int, fp long, text_sha256 string"
        )
    )
    many = staged(duplicated(narrow))
    if many.count() <= broadcast_rows:
        prints = np.sort(many.select("fp").toArrow().column("fp").to_numpy().view(np.uint64))
        wanted = docs.sparkSession.sparkContext.broadcast(prints)
        suspects = rows.mapInArrow(lambda batches: _normalised(batches, wanted), SUSPECT)
    else:
        suspects = rows.mapInArrow(lambda batches: _normalised(batches, EVERY), SUSPECT)
        suspects = suspects.join(many.select("fp"), "fp", "left_semi")
    # Byte verification: equal fingerprints are grouped by the bytes themselves. Copies collapse in
    # the tasks that read them, so a group of any size sends one row a task.
    best = F.struct((-F.col("points")).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), "doc_id")
    groups = suspects.groupBy("norm").agg(F.count(F.lit(1)).alias("group_size"), F.min(best).alias("best"))
    groups = staged(
        groups.select(
            F.sha2("norm", 256).alias("sha"),
            "group_size",
            F.col("best.doc_id").alias("keep_id"),
            (-F.col("best.shorter")).alias("keep_points"),
        ).where("group_size > 1")
    )
    same = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("keep_points"))
    joined = narrow.join(groups, F.col("text_sha256") == F.col("sha"), "left")
    return joined.select(
        "doc_id",
        F.when(F.col("sha").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("sha").isNull() | same).alias("kept"),
        "text_sha256",
    )
