"""Runs: stretches of words that repeat with a period, as long as they go.

Short periods are found by comparing the words with themselves, moved. Longer ones are proposed at dyadic
scales. At scale t, hashes of t words select positions that depend on the 2t words from there alone, a string
synchronising set: it leaves out positions whose t words repeat with a period of at most t/3, and has a member in
each t positions elsewhere. A run with a period from 3t to 6t holds two members with equal contexts one period
apart, or its period is a highly periodic stretch itself. Members' pairs propose the former; pairs of
neighbouring stretches of one short period, found before, propose the latter. What is proposed is
extended as far as it goes and compared word by word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywork.llm.text import SPACE, blocks, flat, with_result, words

LEAST = 12  # words of a run
SCALE = 4  # the first scale; periods below three times that are compared directly
LAST = np.uint64(0xFFFFFFFFFFFFFFFF)
# Primes below 2^31 and bases of two polynomial hashes; odd multipliers.
PRIMES = ((2147483647, 911382323), (2147483629, 972663749))
ODD = np.uint64(0x9E3779B97F4A7C15)

Runs = tuple[np.ndarray, np.ndarray, np.ndarray]  # starts, ends, periods


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


class Prefixes:
    """Hashes of prefixes, which tell whether two stretches are equal."""

    def __init__(self, codes: np.ndarray):
        self.tables = []
        hashed = mix(codes.astype(np.uint64) + ODD)
        for prime, base in PRIMES:
            prime, n = np.uint64(prime), len(codes) + 1
            powers = np.ones(n, np.uint64)
            have, step = 1, np.uint64(base)
            while have < n:  # step is base ** have
                more = min(have, n - have)
                powers[have : have + more] = powers[:more] * step % prime
                step = step * step % prime
                have *= 2
            sums = np.zeros(n, np.uint64)
            np.cumsum(hashed % prime * powers[:-1] % prime, out=sums[1:])
            self.tables.append((prime, powers, sums))

    def same(self, i: np.ndarray, j: np.ndarray, length) -> np.ndarray:
        """Whether ``length`` words from i and from j, i <= j, are equal."""
        equal = np.ones(len(i), bool)
        for prime, powers, sums in self.tables:
            left = (sums[i + length] - sums[i]) % prime * powers[j - i] % prime
            equal &= left == (sums[j + length] - sums[j]) % prime
        return equal

    def forward(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many words from i and from j on are equal, at most ``limit``."""
        got = np.zeros(len(i), np.int64)
        for k in reversed(range(int(limit.max(initial=0)).bit_length())):
            more = np.flatnonzero(got + (1 << k) <= limit)
            at = got[more]
            got[more[self.same(i[more] + at, j[more] + at, 1 << k)]] += 1 << k
        return got

    def backward(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many words before i and before j are equal, at most ``limit``."""
        got = np.zeros(len(i), np.int64)
        for k in reversed(range(int(limit.max(initial=0)).bit_length())):
            more = np.flatnonzero(got + (1 << k) <= limit)
            at = got[more] + (1 << k)
            got[more[self.same(i[more] - at, j[more] - at, 1 << k)]] += 1 << k
        return got


def direct(codes: np.ndarray, period: int) -> Runs:
    """All stretches with a period, of twice its length or more."""
    equal = np.zeros(max(0, len(codes) - period) + 2, np.int8)
    equal[1:-1] = codes[period:] == codes[: max(0, len(codes) - period)]
    edge = np.flatnonzero(np.diff(equal))
    starts, stops = edge[::2], edge[1::2]
    kept = stops - starts >= period
    return starts[kept], stops[kept] + period, np.full(int(kept.sum()), period, np.int64)


def joined(parts: list[Runs]) -> Runs:
    return tuple(np.concatenate([p[k] for p in parts]) for k in range(3)) if parts else (np.zeros(0, np.int64),) * 3


def smallest(runs: Runs) -> Runs:
    """Each stretch once, with the smallest of its periods: a multiple of it gives the same stretch."""
    starts, ends, periods = runs
    order = np.lexsort((periods, ends, starts))
    starts, ends, periods = starts[order], ends[order], periods[order]
    first = np.ones(len(starts), bool)
    first[1:] = (starts[1:] != starts[:-1]) | (ends[1:] != ends[:-1])
    return starts[first], ends[first], periods[first]


def synchronising(names: np.ndarray, scale: int, runs: Runs) -> np.ndarray:
    """Positions chosen by the smallest name among their ``scale`` + 1 neighbours to the right.

    ``names`` are hashes of ``scale`` words; ``runs`` holds all with a period of at most a third of that.
    """
    starts, ends, periods = runs
    high = (3 * periods <= scale) & (ends - starts >= scale) & (ends - scale < len(names))
    cover = np.zeros(len(names) + 1, np.int64)
    np.add.at(cover, starts[high], 1)
    np.add.at(cover, ends[high] - scale + 1, -1)
    names = np.where(np.cumsum(cover[:-1]) > 0, LAST, names)
    least, width = names, 1
    while width < scale:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:-1], least[1:])
    n = len(least)
    return np.flatnonzero(((least == names[:n]) | (least == names[scale : scale + n])) & (least != LAST))


def equal_contexts(chosen: np.ndarray, contexts: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """``(position, distance)`` of pairs of chosen positions with equal contexts, 3 to 6 scales apart."""
    places, gaps = [], []
    left, k = np.arange(len(chosen)), 1
    while True:
        left = left[: np.searchsorted(left, len(chosen) - k)]
        gap = chosen[left + k] - chosen[left]
        left, gap = left[gap < 6 * scale], gap[gap < 6 * scale]
        if not len(left):
            break
        hit = (gap >= 3 * scale) & (contexts[left + k] == contexts[left])
        places.append(chosen[left[hit]])
        gaps.append(gap[hit])
        k += 1
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *places]), np.concatenate([none, *gaps])


def between(prefixes: Prefixes, scale: int, runs: Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(first, end, period)`` of what neighbouring stretches of one short period have in common, moved.

    A run whose period is itself such a stretch lies on two of them that meet.
    """
    starts, ends, periods = runs
    high = np.flatnonzero((3 * periods <= scale) & (ends - starts >= 3 * scale))
    high = high[np.lexsort((starts[high], periods[high]))]
    pairs = (periods[high[1:]] == periods[high[:-1]]) & (starts[high[1:]] <= ends[high[:-1]])
    found = []
    for x, y in zip(high[:-1][pairs].tolist(), high[1:][pairs].tolist()):
        p, a, b, c, d = int(periods[x]), int(starts[x]), int(ends[x]), int(starts[y]), int(ends[y])
        turns = np.arange(p)
        turn = turns[prefixes.same(a + turns, np.full(p, c), p)]
        if not len(turn):
            continue
        first = 3 * scale + (c - a - int(turn[0]) - 3 * scale) % p
        q = np.arange(first, 6 * scale, p)
        low, top = np.maximum(a, c - q), np.minimum(b, d - q)
        whole = top - low >= q
        found.append((low[whole], top[whole], q[whole]))
    return joined(found)


def extended(codes: np.ndarray, prefixes: Prefixes, proposed: Runs) -> Runs:
    """Proposed ``(first, end, period)``, words equal to those a period on, as far as they go."""
    first, end, q = proposed
    if not len(first):
        return proposed
    # Proposals of one period that touch are one.
    order = np.lexsort((first, q))
    first, end, q = first[order], end[order], q[order]
    new = np.ones(len(first), bool)
    new[1:] = (q[1:] != q[:-1]) | (first[1:] > end[:-1])
    at = np.flatnonzero(new)
    first, end, q = first[at], np.maximum.reduceat(end, at), q[at]
    starts = first - prefixes.backward(first, first + q, first)
    stops = end + prefixes.forward(end, end + q, len(codes) - end - q)
    kept = stops - starts >= q
    return starts[kept], stops[kept] + q[kept], q[kept]


def confirmed(codes: np.ndarray, runs: Runs) -> Runs:
    """The runs compared word by word; should hashes have erred, the period is compared directly."""
    wrong = {
        q for s, e, q in zip(*(x.tolist() for x in runs)) if not np.array_equal(codes[s : e - q], codes[s + q : e])
    }
    if not wrong:
        return runs
    right = ~np.isin(runs[2], list(wrong))
    return joined([tuple(x[right] for x in runs), *(direct(codes, q) for q in wrong)])


def find_runs(codes: np.ndarray, lengths: np.ndarray) -> Runs:
    """All runs of texts in a row, longest text first, each with a code of its own behind it."""
    stops = np.cumsum(lengths + 1)
    runs = smallest(joined([direct(codes, q) for q in range(1, 3 * SCALE)]))
    scale, prefixes = SCALE, None
    names, width = mix(codes.astype(np.uint64) + np.uint64(1)), 1
    while True:
        texts = int(np.searchsorted(-lengths, -6 * scale, "right"))
        if not texts:
            break
        size = int(stops[texts - 1])
        names = names[: size - width + 1]
        while width < scale:
            names = mix(names[:-width] * ODD + names[width:])
            width *= 2
        contexts = mix(names[:-scale] * ODD + names[scale:])
        prefixes = prefixes or Prefixes(codes[:size])
        chosen = synchronising(names, scale, runs)
        places, gaps = equal_contexts(chosen, contexts[chosen], scale)
        proposed = joined([(places, places + 2 * scale, gaps), between(prefixes, scale, runs)])
        more = extended(codes[:size], prefixes, proposed)
        runs = smallest(joined([runs, confirmed(codes[:size], smallest(more))]))
        names, width, scale = contexts, 2 * scale, 2 * scale
    return runs


RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("runs", T.ArrayType(RUN)),
        T.StructField("collapsed", T.StringType()),
    ]
)
ARROW_RUN = pa.struct([(n, pa.int64()) for n in RUN.names])


def runs_of_block(data: np.ndarray, buffer: pa.Buffer, offsets: np.ndarray, least: int) -> pa.StructArray:
    """``RESULT`` of rows that are contiguous in ``data``."""
    ends, coded, _ = words(data, buffer, ~SPACE, offsets)
    own = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = np.diff(ends)
    order = np.argsort(-lengths, kind="stable")
    sizes = lengths[order]
    # Texts in order of length, each with a separator behind it that occurs nowhere else.
    starts = np.append(0, np.cumsum(sizes + 1))
    codes = len(coded.dictionary) + np.searchsorted(starts, np.arange(starts[-1]), "right")
    inner = np.ones(len(codes), bool)
    inner[starts[1:] - 1] = False
    codes[inner] = own[np.repeat(ends[:-1][order] - (starts[:-1] - np.arange(len(order))), sizes) + np.arange(len(own))]
    begin, end, period = find_runs(codes, sizes)
    kept = end - begin >= np.maximum(least, 2 * period)
    begin, end, period = begin[kept], end[kept], period[kept]

    # Back to the order of the rows.
    rank = np.searchsorted(starts, begin, "right") - 1
    row, place = order[rank], begin - starts[rank]
    sort = np.lexsort((period, place, row))
    row, place, length, period = row[sort], place[sort], (end - begin)[sort], period[sort]
    drop = np.zeros(len(own) + 1, np.int64)
    np.add.at(drop, ends[row] + place + period, 1)
    np.add.at(drop, ends[row] + place + length, -1)
    keep = np.cumsum(drop[:-1]) == 0
    count = np.append(0, np.cumsum(keep))[ends].astype(np.int32)
    text = coded.dictionary.take(pa.array(own[keep])).cast(pa.string())
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(count), text), " ")
    fields = pa.StructArray.from_arrays([pa.array(x) for x in (place, length, period)], fields=list(ARROW_RUN))
    upto = np.searchsorted(row, np.arange(len(lengths) + 1)).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(upto), fields)
    return pa.StructArray.from_arrays([pa.array(lengths.astype(np.int64)), lists, collapsed], RESULT.names)


def periodic_runs(docs: DataFrame, least: int = LEAST, text_col: str = "text") -> DataFrame:
    """``row`` (all columns of ``docs``) and ``found``: n_words, runs, collapsed.

    ``runs`` are all maximal stretches of at least ``least`` words and two smallest periods, by start and
    period, words numbered from 0; ``collapsed`` are the words no run repeats, joined by one space. A null or
    empty text has no words and no runs; repeated rows are searched each by itself, a null id is nothing special,
    and an empty table gives no rows. Narrow: a text is searched in the task that reads it, in blocks of 2 MB,
    a longer text by itself in memory of some hundred bytes a word.
    """

    def search(text: pa.Array) -> pa.Array:
        data, offsets, buffer = flat(text)
        found = [runs_of_block(data, buffer, offsets[i : j + 1], least) for i, j in blocks(offsets)]
        empty = pa.array([], pa.struct([("n_words", pa.int64()), ("runs", pa.list_(ARROW_RUN)), ("collapsed", pa.string())]))
        return pa.concat_arrays(found) if found else empty

    return with_result(docs, F.arrow_udf(search, RESULT), "found", text_col)


def looped(text: Column, seed: Column) -> Column:
    """Words of ``text`` that loop: from word a = seed % n on, the p words there are said again and again.

    p = 1 + floor((n - a) / (3 + seed % 8)); joined by one space. Null without a word.
    """
    listed = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    n = F.size(listed)
    a = F.pmod(seed, n).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (3 + seed % 8))).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    turn = F.flatten(F.array_repeat(F.slice(listed, a + 1, p), times))
    tail = F.slice(turn, F.lit(1), n - a)
    return F.when(n > 0, F.array_join(F.concat(F.slice(listed, F.lit(1), a), tail), " "))
