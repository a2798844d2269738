"""Columns of text as flat byte arrays, for numpy steps inside Arrow tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 2 << 20
BATCH_BYTES = 8 << 20  # of an Arrow batch; the rows of a batch can be very long texts

# The white space of the word contracts, and what ends a chunk of text.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def released() -> None:
    """Give unused memory of a worker back to the machine, so that later stages find it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library, which has no such function
        pass


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Buffer]:
    """``(bytes, offsets, buffer)`` of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if "binary" in str(column.type) else "")
    _, offsets, data = column.buffers()
    n = len(column)
    if data is None or not n:
        data = pa.py_buffer(b"")
    if offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64), data
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1]
    return np.frombuffer(data, np.uint8), at.astype(np.int64), data


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``limit`` bytes; a longer row is a run of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


def slices(data: np.ndarray, buffer: pa.Buffer, starts: np.ndarray, end: int) -> pa.Array:
    """The pieces of a byte range that begin at ``starts``, as a binary array without copies.

    ``starts`` are positions in ``data``, ascending; the last piece stops at ``end``.
    """
    base = int(starts[0]) if len(starts) else end
    offsets = np.append(starts, end) - base
    if offsets[-1] >= 2**31:
        kind, offsets = pa.large_binary(), offsets.astype(np.int64)
    else:
        kind, offsets = pa.binary(), offsets.astype(np.int32)
    own = buffer.slice(base, end - base)
    return pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(offsets), own])


def per_row(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Positions in ``starts`` where each row's pieces begin, with the total at the end."""
    return np.searchsorted(starts, offsets, "left")


def words(data: np.ndarray, buffer: pa.Buffer, inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.DictionaryArray, np.ndarray]:
    """The words of contiguous rows: ``(ends per row, dictionary-encoded words, first word of each row)``.

    ``inside`` tells which of the 256 byte values belong to words. Words never cross rows. The first
    result counts words before each row's end, with 0 in front.
    """
    begin, end = int(offsets[0]), int(offsets[-1])
    if begin == end:
        empty = pa.array([], pa.binary()).dictionary_encode()
        return np.zeros(len(offsets), np.int64), empty, np.zeros(0, bool)
    member = inside[data[begin:end]]
    edge = np.ones(end - begin, bool)
    edge[1:] = member[1:] != member[:-1]
    rows = offsets[:-1]
    edge[rows[rows < end] - begin] = True
    starts = np.flatnonzero(edge)
    is_word = member[starts]
    coded = slices(data, buffer, starts + begin, end).dictionary_encode()
    coded = coded.filter(pa.array(is_word))
    own = starts[is_word] + begin
    counts = np.searchsorted(own, offsets, "left")
    first = np.zeros(len(own), bool)
    first[counts[:-1][counts[:-1] < len(own)]] = True
    return counts, coded, first


def bound_batches(docs: DataFrame) -> None:
    """Let no Arrow batch of the session grow much beyond ``BATCH_BYTES``; a lower limit stays."""
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(conf.get(key).rstrip("b"))
    if not 0 < now <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))


def with_result(docs: DataFrame, function: Callable, name: str, text_col: str = "text") -> DataFrame:
    """``row`` (all columns of ``docs``) and ``name``, what an Arrow function makes of the text.

    Only the text goes to Python and only the result comes back; the other columns stay in the JVM.
    """
    bound_batches(docs)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return docs.select(F.struct(*columns).alias("row"), function(F.col(f"`{text_col}`").cast("string")).alias(name))
