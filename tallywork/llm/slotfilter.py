"""Counting filters of slots and remainders (CQF), without false answers: a fingerprint is kept whole.

A fingerprint's place in its segment of the space, divided by a width, names its home slot; the rest of the
division is its remainder. Remainders of one home are a sorted run, at their home or right behind the run
before. Three bits tell the structure: whether a slot is the home of a run, whether it ends one, and whether it
holds a digit of a count instead of a remainder; a count above one has as many digits as it needs. All filters
of one geometry have the same order, so they merge a window of home slots at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

LOAD = 0.92  # fingerprints per home slot aimed at
SEGMENT_ROWS = 1 << 22  # fingerprints of all partitions that a segment is made for
WINDOW = 1 << 15  # home slots or values handled at once
SPACE = 1 << 64


@dataclass(frozen=True)
class Geometry:
    """Segments of the fingerprint space, home slots of each, and the fingerprints that share a home."""

    segments: int
    slots: int
    width: int

    @property
    def bits(self) -> int:
        """Bits of a remainder."""
        return max(1, (self.width - 1).bit_length())


def geometry(rows: int, partitions: int, segment_rows: int = SEGMENT_ROWS) -> Geometry:
    """One for filters of ``partitions`` partitions of ``rows`` rows; fuller filters only have longer runs."""
    segments = max(1, -(-rows // segment_rows))
    slots = max(64, int(rows / max(1, partitions) / segments / LOAD) + 1)
    return Geometry(segments, slots, -(-SPACE // (segments * slots)))


def packed(values: np.ndarray, bits: int) -> bytes:
    """Whole numbers of so many bits each, in a row."""
    parts = []
    for k in range(0, len(values), WINDOW):
        raw = values[k : k + WINDOW].astype(">u8").view(np.uint8).reshape(-1, 8)
        parts.append(np.packbits(np.unpackbits(raw, axis=1)[:, 64 - bits :].ravel()).tobytes())
    return b"".join(parts)


def unpacked(data: np.ndarray, bits: int, first: int, last: int) -> np.ndarray:
    """The numbers from place ``first`` to ``last`` of :func:`packed`."""
    out = []
    for a in range(first, last, WINDOW):
        b = min(last, a + WINDOW)
        low = a * bits // 8
        row = np.unpackbits(data[low : -(-b * bits // 8)])[a * bits - 8 * low :][: (b - a) * bits]
        wide = np.zeros((b - a, 64), np.uint8)
        wide[:, 64 - bits :] = row.reshape(-1, bits)
        out.append(np.packbits(wide, axis=1).view(">u8").ravel().astype(np.uint64))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _flags(at: np.ndarray, size: int) -> bytes:
    bits = np.zeros(size, np.uint8)
    bits[at] = 1
    return np.packbits(bits).tobytes()


def _bits(data: np.ndarray, first: int, last: int) -> np.ndarray:
    last = min(last, 8 * len(data))
    return np.unpackbits(data[first // 8 : -(-last // 8)])[first % 8 :][: max(0, last - first)]


class SlotFilter:
    """The filter of one segment."""

    def __init__(self, shape: Geometry, segment: int, slots: int, homes: bytes, ends: bytes, digits: bytes, values: bytes):
        self.shape, self.segment, self.slots = shape, segment, slots
        self.homes, self.ends, self.digits, self.values = (np.frombuffer(x, np.uint8) for x in (homes, ends, digits, values))

    @classmethod
    def build(cls, shape: Geometry, segment: int, prints: np.ndarray, counts: np.ndarray) -> SlotFilter:
        """From sorted distinct fingerprints of the segment and their counts."""
        width = np.uint64(shape.width)
        home = (prints // width).astype(np.int64) - segment * shape.slots
        more = counts.astype(np.uint64) - np.uint64(1)
        extra = np.zeros(len(prints), np.int64)
        left = more.copy()
        while left.any():
            extra += left > 0
            left = left >> np.uint64(shape.bits) if shape.bits < 64 else np.zeros_like(left)
        sizes = extra + 1
        before = np.cumsum(sizes) - sizes
        at = before + np.maximum.accumulate(home - before) if len(home) else before
        slots = int(at[-1] + sizes[-1]) if len(at) else 0
        values = np.zeros(slots, np.uint64)
        values[at] = prints % width
        digits = []
        for k in range(1, int(extra.max(initial=0)) + 1):
            own = np.flatnonzero(extra >= k)
            values[at[own] + k] = more[own] & np.uint64((1 << shape.bits) - 1)
            more[own] = more[own] >> np.uint64(shape.bits % 64)
            digits.append(at[own] + k)
        last = np.append(home[1:] != home[:-1], True) if len(home) else np.zeros(0, bool)
        every = np.concatenate(digits) if digits else np.zeros(0, np.int64)
        ends = _flags((at + sizes - 1)[last], slots)
        return cls(shape, segment, slots, _flags(home, shape.slots), ends, _flags(every, slots), packed(values, shape.bits))

    def nbytes(self) -> int:
        return sum(len(x) for x in (self.homes, self.ends, self.digits, self.values))

    def row(self) -> tuple:
        return (self.segment, self.slots, *(x.tobytes() for x in (self.homes, self.ends, self.digits, self.values)))

    def windows(self, step: int = WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(home, remainder, count)`` of the fingerprints of each ``step`` home slots, in order."""
        end = -1  # of the run before
        for a in range(0, self.shape.slots, step):
            home = np.flatnonzero(_bits(self.homes, a, min(a + step, self.shape.slots))) + a
            if not len(home):
                yield home, np.zeros(0, np.uint64), np.zeros(0, np.int64)
                continue
            ends, reach = np.zeros(0, np.int64), len(home) + 64
            while len(ends) < len(home):
                ends = np.flatnonzero(_bits(self.ends, end + 1, min(self.slots, end + 1 + reach))) + end + 1
                reach *= 2
            ends = ends[: len(home)]
            starts = np.maximum(home, np.append(end, ends[:-1]) + 1)
            lengths = ends - starts + 1
            first, end = int(starts[0]), int(ends[-1])
            place = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
            values = unpacked(self.values, self.shape.bits, first, end + 1)[place - first]
            digit = _bits(self.digits, first, end + 1)[place - first] == 1
            item = np.cumsum(~digit) - 1
            heads = np.flatnonzero(~digit)
            counts = np.ones(len(heads), np.int64)
            power = (np.arange(len(place)) - heads[item] - 1)[digit] * self.shape.bits
            np.add.at(counts, item[digit], (values[digit] << power.astype(np.uint64)).astype(np.int64))
            yield np.repeat(home, lengths)[heads], values[heads], counts

    def count(self, fingerprint: int) -> int:
        """How often a fingerprint was seen: its home's run is looked through."""
        home, rest = divmod(fingerprint, self.shape.width)
        home -= self.segment * self.shape.slots
        if not 0 <= home < self.shape.slots or not _bits(self.homes, home, home + 1).any():
            return 0
        for homes, values, counts in self.windows():
            hit = (homes == home) & (values == np.uint64(rest))
            if hit.any():
                return int(counts[hit][0])
        return 0


def merged(filters: list[SlotFilter], step: int = WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(fingerprints, counts)`` of all filters of a segment, in order, a window of home slots at a time."""
    if not filters:
        return
    shape, segment = filters[0].shape, filters[0].segment
    for parts in zip(*(f.windows(step) for f in filters)):
        home, rest, counts = (np.concatenate([p[k] for p in parts]) for k in range(3))
        if not len(home):
            continue
        order = np.lexsort((rest, home))
        home, rest, counts = home[order], rest[order], counts[order]
        first = np.flatnonzero(np.append(True, (home[1:] != home[:-1]) | (rest[1:] != rest[:-1])))
        whole = (home[first] + segment * shape.slots).astype(np.uint64) * np.uint64(shape.width) + rest[first]
        yield whole, np.add.reduceat(counts, first)
