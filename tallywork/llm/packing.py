"""Best-fit packing of tokenised documents into sequences of a fixed length.

Nodes of a bounded number of pieces pack by best-fit decreasing. A nearly full bin is done.
The underfull ones go up a tree as items, where best-fit places them again.

What goes up stays small by itself: two bins of at most half a sequence always fit
together, so best-fit leaves at most one of them in a node. Only such small bins can still be
placed, one from each of the nodes merged, and the emptiest large bins are the ones that can take
them; a node therefore passes its small bin and as many of its emptiest large bins as small
bins can still meet it on the way to the root.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywork.llm.text import bound_batches, released
from tallywork.llm.tokens import encoder
from tallywork.session import staged

SEQUENCE = 4096
NODE_PIECES = 2048
FAN_IN = 8
NEARLY_FULL = 0  # tokens of room at which a bin counts as full

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
BINS = "level int, node long, bin long, parent long, shift long, load long, up boolean"


def _cut(batches: Iterator[pa.RecordBatch], path: str, end_id: int, size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        out: list[list] = [[], [], [], [], []]
        for i, j, flat_ids, ends in encoder(path).texts(batch.column("text")):
            begin = 0
            for row, end in zip(range(i, j), ends.tolist()):
                own = np.append(flat_ids[begin:end], np.uint32(end_id)).astype("<u4")
                begin = end
                for k, start in enumerate(range(0, len(own), size)):
                    part = own[start : start + size]
                    for column, value in zip(out, (ids[row], k, start, len(part), zlib.crc32(part))):
                        column.append(value)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(out, kinds)],
            ["doc_id", "piece", "start", "length", "ids_crc32"],
        )
        released()


def pieces(docs: DataFrame, path: str, end_id: int = 1, size: int = SEQUENCE) -> DataFrame:
    """The documents' token ids with the end id, cut into pieces; only their checksums leave the task."""
    bound_batches(docs)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text"))
    return rows.mapInArrow(partial(_cut, path=path, end_id=end_id, size=size), PIECES)


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: ``(bin of each item, its offset, load of each bin)``.

    An item goes to the bin with the least room that holds it. Rooms are kept as a sorted
    list of the distinct ones with the bins that have them, so a step is a binary search.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    loads: list[int] = []
    rooms: list[int] = []
    having: dict[int, list[int]] = {}
    for item, length in zip(order.tolist(), lengths[order].tolist()):
        k = bisect.bisect_left(rooms, length)
        if k < len(rooms):
            room = rooms[k]
            chosen = having[room].pop()
            if not having[room]:
                del having[room], rooms[k]
        else:
            room, chosen = size, len(loads)
            loads.append(0)
        bins[item], offsets[item] = chosen, loads[chosen]
        loads[chosen] += length
        if left := room - length:
            if left not in having:
                bisect.insort(rooms, left)
                having[left] = []
            having[left].append(chosen)
    return bins, offsets, np.array(loads, np.int64)


def _upward(loads: np.ndarray, size: int, keep: int, nearly: int) -> np.ndarray:
    """Which bins of a node are passed on: the small ones and the emptiest ``keep`` others."""
    up = loads * 2 <= size
    large = np.flatnonzero(~up & (size - loads > nearly))
    up[large[np.argsort(loads[large], kind="stable")][:keep]] = True
    return up


def _first(key: tuple, table: pa.Table, size: int, keep: int, nearly: int) -> pa.Table:
    node = key[0].as_py()
    table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
    bins, offsets, loads = best_fit(table.column("length").to_numpy(), size)
    up = _upward(loads, size, keep, nearly)
    base = node << 24
    return pa.table(
        {
            **{c: table.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")},
            "bin": base + bins,
            "at": offsets,
            "load": loads[bins],
            "up": up[bins],
        }
    )


def _merging(level: int, size: int, keep: int, nearly: int):
    """The step of one level of the tree: the bins of a node's children as items."""

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        node = key[0].as_py()
        table = table.sort_by([("load", "descending"), ("bin", "ascending")])
        chosen, offsets, loads = best_fit(table.column("load").to_numpy(), size)
        up = _upward(loads, size, keep, nearly)
        n = len(table)
        return pa.table(
            {
                "level": pa.array(np.full(n, level, np.int32)),
                "node": pa.array(np.full(n, node)),
                "bin": table.column("bin"),
                "parent": ((level << 56) | (node << 24)) + chosen,
                "shift": offsets,
                "load": loads[chosen],
                "up": up[chosen],
            }
        )

    return merge


def pack(parts: DataFrame, size: int = SEQUENCE, node_pieces: int = NODE_PIECES, fan_in: int = FAN_IN, nearly: int = NEARLY_FULL) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces that each fit a sequence.

    Pieces are dealt over the nodes by a hash of what they are, so every node sees the same mix
    of lengths. The number of nodes follows the number of pieces; the tree has a level for each
    power of ``fan_in``. The plan holds one shuffle of the pieces and one of the bins a level.
    """
    parts = staged(parts)
    whole = parts.where(F.col("length") == size)
    rest = parts.where(F.col("length") < size)
    nodes = max(1, -(-rest.count() // node_pieces))
    levels = 0
    while fan_in**levels < nodes:
        levels += 1
    keep = lambda level: fan_in * (levels - level)
    dealt = rest.withColumn("node", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(nodes)))
    first = staged(
        dealt.groupBy("node").applyInArrow(
            lambda key, rows: _first(key, rows, size, keep(0), nearly),
            PIECES + ", bin long, at long, load long, up boolean",
        )
    )
    bins = first.where("up and at = 0").select("bin", "load")
    bins = bins.withColumn("node", F.shiftright("bin", 24))
    merged: list[DataFrame] = []
    for level in range(1, levels + 1):
        up = bins.withColumn("node", F.floor(F.col("node") / fan_in).cast("long"))
        merge = _merging(level, size, keep(level), nearly)
        step = staged(up.groupBy("node").applyInArrow(merge, BINS))
        merged.append(step)
        bins = step.where("up and shift = 0").select(F.col("parent").alias("bin"), "load", "node")
    # From the root down: where each bin of a level ends up.
    final = None
    for step in reversed(merged):
        own = step.select("bin", F.col("parent").alias("sequence"), "shift")
        if final is not None:
            above = final.select(F.col("bin").alias("sequence"), F.col("sequence").alias("top"), F.col("shift").alias("more"))
            own = own.join(above, "sequence", "left").select(
                "bin",
                F.coalesce("top", "sequence").alias("sequence"),
                (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"),
            )
        final = own
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    if final is None:
        placed = first.select(*columns, F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
    else:
        moved = first.where("up").join(final, "bin", "left").select(
            *columns,
            F.coalesce("sequence", "bin").alias("sequence_id"),
            (F.col("at") + F.coalesce("shift", F.lit(0))).alias("offset"),
        )
        done = first.where("not up").select(*columns, F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
        placed = done.union(moved)
    # A whole piece is a sequence of its own; its number is apart from those of the tree's bins.
    alone = whole.select(
        *columns,
        (-1 - F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    return placed.union(alone)


def packed_documents(docs: DataFrame, path: str, end_id: int = 1, size: int = SEQUENCE) -> DataFrame:
    """Pieces of all documents with the sequence and the place that hold them.

    A null or empty text is the end id alone, length 1. Rows with a null or a repeated id are
    packed like any other; an empty table gives no rows. Other columns are ignored.
    """
    return pack(pieces(docs, path, end_id, size), size)
