"""Benchmark decontamination with an FM-index per shard of training text.

A shard is a run of whole documents of bounded size. Its words that occur in the phrases
become symbols; all others separate. The index is the Burrows-Wheeler transform of that
sequence in a wavelet matrix. All phrase windows are searched backward at once, occurrences
are located by walking to a sampled suffix position, and overlapping ones merge to spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywork.llm.text import blocks, flat, released, with_result, words

WINDOW = 13
SAMPLE_RATE = 8
PHRASE_BYTES = 16 << 20  # of phrase text in a block that is searched at once
SHARD_BYTES = 4 << 20

# Bytes of words, after A-Z are lower-cased.
INSIDE = np.zeros(256, bool)
INSIDE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Buffer]:
    data, offsets, _ = flat(column)
    data = LOWER[data]
    return data, offsets, pa.py_buffer(data)


@dataclass
class Phrases:
    """A block of benchmark items: their vocabulary and distinct windows, grouped by length."""

    vocabulary: dict[bytes, int]  # word -> symbol; 0 ends the text, 1 separates
    windows: list[np.ndarray]  # one array of symbols a length
    items: list[list[list[int]]]  # of each window, numbers of the items that have it
    names: list[str]  # item ids as text


def phrases(ids: list, column: pa.Array, window: int = WINDOW) -> Phrases:
    """Windows of the items; items without words have none, rows of one id are one item.

    An item with a null id has windows, but no name.
    """
    data, offsets, buffer = lowered(column)
    ends, coded, _ = words(data, buffer, INSIDE, offsets)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    used = np.unique(codes)
    symbol = np.zeros(len(coded.dictionary), np.int64)
    symbol[used] = np.arange(2, len(used) + 2)
    texts = coded.dictionary.to_pylist()
    vocabulary = {texts[c]: int(symbol[c]) for c in used.tolist()}
    names: dict[str, int] = {}
    by_length: dict[int, dict[tuple, set[int]]] = {}
    for k, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
        if a == b:
            continue
        own = symbol[codes[a:b]].tolist()
        length = min(window, b - a)
        name = -1 if ids[k] is None else names.setdefault(str(ids[k]), len(names))
        group = by_length.setdefault(length, {})
        for s in range(b - a - length + 1):
            group.setdefault(tuple(own[s : s + length]), set()).add(name)
    lengths = sorted(by_length)
    return Phrases(
        vocabulary,
        [np.array(list(by_length[n]), np.int64).reshape(-1, n) for n in lengths],
        [[sorted(x for x in v if x >= 0) for v in by_length[n].values()] for n in lengths],
        list(names),
    )


def suffix_array(text: np.ndarray, bits: int) -> np.ndarray:
    """Order of the suffixes of ``text``, whose last symbol is the only 0, by prefix doubling.

    A first sort takes as many symbols as fit 62 bits; later ones touch only what still ties.
    """
    n = len(text)
    depth = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for k in range(depth):
        key <<= bits
        key[: n - k] |= text[k:]
    order = np.argsort(key, kind="stable")
    del_key = key[order]
    new = np.append(True, del_key[1:] != del_key[:-1])
    heads = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = heads
    while True:
        # Places of the order whose group has other members.
        tied = np.append(heads[1:] == heads[:-1], False)
        tied[1:] |= heads[1:] == heads[:-1]
        places = np.flatnonzero(tied)
        if not len(places):
            return order
        own = order[places]
        after = own + depth
        following = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        sort = np.lexsort((following, heads[places]))
        own, following = own[sort], following[sort]
        group = heads[places]  # unchanged by a sort within groups
        new = np.append(True, (group[1:] != group[:-1]) | (following[1:] != following[:-1]))
        head = np.maximum.accumulate(np.where(new, places, 0))
        order[places] = own
        heads[places] = head
        rank[own] = head
        depth *= 2


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit a level."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.bits = bits
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        self.raw: list[np.ndarray] = []
        for level in range(bits - 1, -1, -1):
            bit = (sequence >> level) & 1
            ones = np.zeros(len(sequence) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(sequence) - int(ones[-1]))
            sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])
        # Where the run of each symbol begins below the last level.
        symbols = np.arange(1 << bits)
        self.begin = self._follow(symbols, np.zeros(1 << bits, np.int64))

    def _follow(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            one = ones[at]
            at = np.where((symbols >> (self.bits - 1 - k)) & 1, zeros + one, at - one)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        return self._follow(symbols, at) - self.begin[symbols]

    def access_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and its rank there."""
        symbols = np.zeros(len(at), np.int64)
        for ones, zeros in zip(self.ones, self.zeros):
            one = ones[at]
            bit = ones[at + 1] - one
            symbols = (symbols << 1) | bit
            at = np.where(bit, zeros + one, at - one)
        return symbols, at - self.begin[symbols]


class FMIndex:
    def __init__(self, text: np.ndarray, bits: int, rate: int = SAMPLE_RATE):
        order = suffix_array(text, bits)
        self.n = len(text)
        self.tree = WaveletMatrix(text[order - 1], bits)
        counts = np.bincount(text, minlength=1 << bits)
        self.before = np.cumsum(counts) - counts
        sampled = order % rate == 0
        self.sampled = np.append(0, np.cumsum(sampled))
        self.samples = order[sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(pattern, low, high)`` of the patterns, all of one length, that occur."""
        alive = np.arange(len(patterns))
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n)
        for k in range(patterns.shape[1] - 1, -1, -1):
            symbols = patterns[alive, k]
            low = self.before[symbols] + self.tree.rank(symbols, low)
            high = self.before[symbols] + self.tree.rank(symbols, high)
            found = low < high
            alive, low, high = alive[found], low[found], high[found]
        return alive, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the index, by steps back to a sampled position."""
        out = np.empty(len(rows), np.int64)
        todo, steps = np.arange(len(rows)), 0
        rows = rows.copy()
        while len(todo):
            here = self.sampled[rows + 1] > self.sampled[rows]
            out[todo[here]] = self.samples[self.sampled[rows[here]]] + steps
            todo, rows = todo[~here], rows[~here]
            if len(rows):
                symbols, ranks = self.tree.access_rank(rows)
                rows = self.before[symbols] + ranks
            steps += 1
        return out


def occurrences(symbols: np.ndarray, block: Phrases) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(length group, window, place)`` of every occurrence in a sequence of symbols (1: any other word)."""
    if not block.windows or not len(symbols):
        return
    # Runs that are shorter than the shortest window hold no occurrence; separators need be single.
    known = symbols > 1
    edge = np.flatnonzero(np.diff(np.concatenate([[False], known, [False]]).astype(np.int8)))
    begins, ends = edge[::2], edge[1::2]
    long = ends - begins >= block.windows[0].shape[1]
    begins, ends = begins[long], ends[long]
    if not len(begins):
        return
    sizes = ends - begins + 1
    total = np.cumsum(sizes)
    places = np.repeat(begins - (total - sizes), sizes) + np.arange(total[-1])
    places[total - 1] = -1
    text = np.where(places < 0, 1, symbols[places])
    text[-1] = 0
    bits = int(max(2, len(block.vocabulary) + 1)).bit_length()
    index = FMIndex(text, bits)
    for group, windows in enumerate(block.windows):
        if windows.shape[1] > int((ends - begins).max()):
            continue
        which, low, high = index.search(windows)
        if not len(which):
            continue
        counts = high - low
        rows = np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        yield group, np.repeat(which, counts), places[index.locate(rows)]


def search_shard(data: np.ndarray, buffer: pa.Buffer, offsets: np.ndarray, searched: list[Phrases]) -> list[tuple]:
    """``(words, hit words, item ids, spans)`` of each document of a shard."""
    ends, coded, first = words(data, buffer, INSIDE, offsets)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    n_docs = len(ends) - 1
    # One more place after every document, so that no run crosses documents.
    owner = np.repeat(np.arange(n_docs), np.diff(ends))
    place = np.arange(len(codes)) + owner
    size = len(codes) + n_docs
    cover = np.zeros(size + 1, np.int64)
    found: list[set[str]] = [set() for _ in range(n_docs)]
    starts = ends[:-1] + np.arange(n_docs)
    texts = coded.dictionary.to_pylist()
    for block in searched:
        lookup = np.array([block.vocabulary.get(t, 1) for t in texts], np.int64)
        symbols = np.ones(size, np.int64)
        symbols[place] = lookup[codes] if len(codes) else 1
        for group, which, at in occurrences(symbols, block):
            length = block.windows[group].shape[1]
            np.add.at(cover, at, 1)
            np.add.at(cover, at + length, -1)
            docs = np.searchsorted(starts, at, "right") - 1
            for pair in np.unique((docs << 32) | which).tolist():
                found[pair >> 32].update(block.names[k] for k in block.items[group][pair & 0xFFFFFFFF])
    hit = np.cumsum(cover[:-1]) > 0
    total = np.append(0, np.cumsum(hit))
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    span_docs = np.searchsorted(starts, edge[::2], "right") - 1
    spans: list[list[dict]] = [[] for _ in range(n_docs)]
    for d, a, b in zip(span_docs.tolist(), edge[::2].tolist(), edge[1::2].tolist()):
        base = int(starts[d])
        spans[d].append({"first": a - base, "last": b - 1 - base})
    stops = starts + np.diff(ends)
    n_hit = total[stops] - total[starts]
    return [
        (int(ends[d + 1] - ends[d]), int(n_hit[d]), sorted(found[d]), spans[d]) for d in range(n_docs)
    ]


RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField(
            "spans",
            T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())])),
        ),
    ]
)
ARROW_RESULT = pa.struct(
    [
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("items", pa.list_(pa.string())),
        ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
    ]
)


def phrase_blocks(benchmark: DataFrame, window: int, limit: int = PHRASE_BYTES) -> list:
    """The stated phrase set as broadcasts of at most about ``limit`` bytes of text each."""
    rows = benchmark.select("item_id", F.col("text").cast("string").alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first().b
    n = -(-total // limit) if total else 0
    context = benchmark.sparkSession.sparkContext
    out = []
    for k in range(n):
        # An id is whole in one block, so the names of different blocks differ.
        part = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).toArrow().combine_chunks()
        if len(part):
            block = phrases(part.column("item_id").to_pylist(), part.column("text").chunk(0), window)
            out.append(context.broadcast(block))
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """``row`` (all columns of ``docs``) and ``found``: n_words, n_hit, items, spans of hit words.

    Narrow: a document is searched in the task that reads it. Null and empty texts have no words;
    a null item id has windows without a name; an empty benchmark hits nothing; repeated rows are
    searched each by itself; an empty table gives no rows. ``spans`` number words from 0.
    """
    searched = phrase_blocks(benchmark, window)

    def search(text: pa.Array) -> pa.Array:
        own = [b.value for b in searched]
        names = [f.name for f in ARROW_RESULT]
        data, offsets, buffer = lowered(text)
        found = []
        for i, j in blocks(offsets, SHARD_BYTES):
            got = search_shard(data, buffer, offsets[i : j + 1], own)
            found.append(pa.array([dict(zip(names, r)) for r in got], ARROW_RESULT))
        released()
        return pa.concat_arrays(found) if found else pa.array([], ARROW_RESULT)

    return with_result(docs, F.arrow_udf(search, RESULT), "found", text_col)


def is_contaminated(n_words, n_hit):
    """The rule of contamination: some words are hit, and at least a twentieth of all."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
