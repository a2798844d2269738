"""Exact Jaccard join of documents as points of a metric space.

Jaccard distance is a metric, but unrelated documents all are about 1 apart, so a pivot alone
can't tell them from each other. A first level therefore puts documents into regions by shingle: by the
rarest-first order of its shingles a document enters the regions of its first n - ceil(0.8 n) + 1,
and two documents within reach of each other share such a region. Inside the regions it is metric:

* the smallest document of a region is its first pivot; distances to it link most near copies;
* a region whose documents all are in one component can't add anything and is closed;
* an open region of bounded size is joined in one task, by recursive Voronoi cells: a document goes to its
  nearest pivot and into every other cell that the triangle inequality can't exclude;
* a larger one is split by distributed pivots into such cells until all are closed or small.

Equal sets are one point from the start. Only links inside one component are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallywork.llm.graph import few, merged
from tallywork.llm.text import SPACE, blocks, bound_batches, flat, released
from tallywork.session import staged

SHINGLE = 5
PERCENT = 80  # similarity of a link
REACH = 1 - PERCENT / 100  # the same as a distance
BROADCAST_ROWS = 1 << 20  # ids or shingles of 8 bytes that may be sent to every task
REGION_SHINGLES = 1 << 21  # shingles of all documents of a region that one task joins
PIVOTS = 16  # of a large region in one round
CELL = 48  # documents that a leaf compares with each other
COUNTED = 1 << 22  # shingles that a task counts at once
DENSE = 10  # regions of shingles in 2 ** DENSE documents or more are formed without gathering them
BLOCK = 2 << 20  # bytes of text hashed at once
MARGIN = 1e-9  # for rounding, on the safe side

INSIDE = ~SPACE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
# Odd multipliers, one for each word of a shingle.
ODD = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64
)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(hash of every word, words before each row's end)`` of contiguous rows."""
    begin, end = int(offsets[0]), int(offsets[-1])
    rows = offsets[:-1] - begin
    text = data[begin:end]
    member = INSIDE[text]
    head = member.copy()
    head[1:] &= ~member[:-1]
    rows = rows[rows < len(text)]
    head[rows] = member[rows]
    starts = np.flatnonzero(head)
    counts = np.searchsorted(starts, offsets - begin, "left")
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    place = np.arange(starts[0], len(text)) - np.repeat(starts, np.diff(np.append(starts, len(text))))
    # White space after a word adds nothing.
    term = mix((place.astype(np.uint64) << np.uint64(9)) + text[starts[0] :] + np.uint64(1))
    term *= member[starts[0] :]
    return mix(np.add.reduceat(term, starts - starts[0])), counts


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    values = np.sort(values)
    if len(values) > 1:
        values = values[np.append(True, values[1:] != values[:-1])]
    return values


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For runs of rows: the first row, and each row's sorted distinct shingle hashes."""
    raw, offsets, _ = flat(column)
    for i, j in blocks(offsets, BLOCK):
        begin = int(offsets[i])
        hashes, ends = word_hashes(LOWER[raw[begin : offsets[j]]], offsets[i : j + 1] - begin)
        n = max(0, len(hashes) - SHINGLE + 1)
        rolled = np.full(n, SHINGLE, np.uint64)
        for k in range(SHINGLE):
            rolled += hashes[k : k + n] * ODD[k]
        rolled = mix(rolled)
        sets = []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            if b - a >= SHINGLE:
                sets.append(distinct(rolled[a : b - SHINGLE + 1]))
            elif b > a:
                short = np.uint64(b - a) + (hashes[a:b] * ODD[: b - a]).sum(dtype=np.uint64)
                sets.append(mix(np.array([short], np.uint64)))
            else:
                sets.append(np.zeros(0, np.uint64))
        yield i, sets
    released()


def window(n: int) -> int:
    """How many of its n shingles, in a common order, a document shares at least one of with any in reach."""
    return n + (-PERCENT * n // 100) + 1 if n else 0


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, and rows of shingles that repeat."""
    names = ["doc_id", "n", "sig_a", "sig_b", "shingle", "times"]
    held: list[np.ndarray] = []
    total = 0
    for batch in batches:
        ids = batch.column("doc_id")
        for i, sets in shingle_sets(batch.column("text")):
            m = len(sets)
            n = np.fromiter(map(len, sets), np.int64, m)
            every = np.concatenate(sets) if m else np.zeros(0, np.uint64)
            at = np.append(0, np.cumsum(n))
            sums = np.append(np.uint64(0), np.cumsum(mix(every + np.uint64(1)), dtype=np.uint64))
            others = np.append(np.uint64(0), np.cumsum(mix(every ^ ODD[0]), dtype=np.uint64))
            sig_a, sig_b = sums[at[1:]] - sums[at[:-1]], others[at[1:]] - others[at[:-1]]
            none = pa.nulls(m, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [ids.slice(i, m), pa.array(n), pa.array(sig_a.view(np.int64)), pa.array(sig_b.view(np.int64)), none, none],
                names,
            )
            held.append(every)
            total += len(every)
            if total >= COUNTED:
                yield _repeated(held, names)
                held, total = [], 0
    if held:
        yield _repeated(held, names)


def _repeated(held: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    """Rows of the shingles that several documents of a task have."""
    every = np.sort(np.concatenate(held))
    first = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(every)))
    many = times > 2
    none = pa.nulls(int(many.sum()), pa.int64())
    return pa.RecordBatch.from_arrays(
        [none, none, none, none, pa.array(every[first[many]].view(np.int64)), pa.array(times[many])], names
    )


def frequent_shingles(times: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles and their levels (log2 of their count), of as many upper levels as hold at most ``limit``.

    Any order of shingles gives right results; this one keeps windows off common passages.
    """
    counted = times.groupBy("shingle").agg(F.sum("times").alias("times"))
    counted = staged(counted.withColumn("level", F.floor(F.log2("times")).cast("int")))
    sizes = {r.level: r.n for r in counted.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()}
    total, lowest = 0, 64
    for level in sorted(sizes, reverse=True):
        total += sizes[level]
        if total > limit:
            break
        lowest = level
    got = counted.where(F.col("level") >= lowest).select("shingle", "level").toArrow()
    values = got.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(values)
    return values[order], got.column("level").to_numpy().astype(np.uint8)[order]


def _entries(batches: Iterator[pa.RecordBatch], frequent, dense: bool) -> Iterator[pa.RecordBatch]:
    """The regions a document enters: its first shingles, infrequent ones first.

    Gives those of shingles that are ``dense``, or the others.
    """
    often, levels = frequent.value
    for batch in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        for i, sets in shingle_sets(batch.column("text")):
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            every = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
            level = np.zeros(len(every), np.uint8)
            if len(often):
                place = np.minimum(np.searchsorted(often, every), len(often) - 1)
                known = often[place] == every
                level[known] = levels[place[known]]
            at = np.append(0, np.cumsum(sizes)).tolist()
            chosen = []
            for a, b, n in zip(at[:-1], at[1:], sizes.tolist()):
                if n:
                    # Sets are sorted, so a stable order by level is one by level and shingle.
                    chosen.append(np.argsort(level[a:b], kind="stable")[: window(n)] + a)
            index = np.concatenate(chosen) if chosen else np.zeros(0, np.int64)
            index = index[(level[index] >= DENSE) == dense]
            owner = np.searchsorted(np.array(at), index, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(every[index].view(np.int64)), pa.array(ids[i + owner].astype(np.int64)), pa.array(sizes[owner])],
                ["region", "doc_id", "n"],
            )


MEMBER = "region long, doc_id long, n long, pivot long, pivot_n long"


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From entries sorted by region and document, those of regions with two documents or more.

    Streams: of a region that goes on in the next batch only its first row is remembered.
    """
    names = ["region", "doc_id", "n", "pivot", "pivot_n"]
    held = None  # first row of the last region
    sent = True  # whether that row has gone out
    for batch in batches:
        region, doc, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("region", "doc_id", "n"))
        if not len(region):
            continue
        if held is not None:
            # Put the remembered row in front; it is skipped below if it has gone out already.
            region, doc, n = (np.append(x, y) for x, y in zip(held, (region, doc, n)))
        skip = held is not None and sent
        new = np.append(True, region[1:] != region[:-1])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(region)))
        head = np.repeat(starts, sizes)
        shared = np.repeat(sizes > 1, sizes)
        last = starts[-1]
        held = (region[last : last + 1], doc[last : last + 1], n[last : last + 1])
        sent = bool(sizes[-1] > 1) or (skip and last == 0)
        if skip:
            shared[0] = False
        yield pa.RecordBatch.from_arrays(
            [pa.array(x[shared]) for x in (region, doc, n, doc[head], n[head])], names
        )


def reachable(n: str, m: str):
    """Sizes that a link allows."""
    return (100 * F.least(n, m)) >= (PERCENT * F.greatest(n, m))


class Region:
    """The documents of a region in one task: concatenated sorted sets."""

    def __init__(self, sets: list[np.ndarray], comps: np.ndarray):
        self.sets = sets
        self.sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        self.parent = list(range(len(sets)))
        seen: dict[int, int] = {}
        for k, c in enumerate(comps.tolist()):
            self.parent[k] = seen.setdefault(c, k)
        self.links: list[tuple[int, int]] = []

    def root(self, k: int) -> int:
        while self.parent[k] != k:
            self.parent[k] = self.parent[self.parent[k]]
            k = self.parent[k]
        return k

    def link(self, a: int, b: int) -> None:
        ra, rb = self.root(a), self.root(b)
        if ra != rb:
            self.parent[max(ra, rb)] = min(ra, rb)
            self.links.append((a, b))

    def common(self, pivot: int, members: np.ndarray, every: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Shared shingles of the pivot and each member; ``every`` are the members' sets in a row."""
        own = self.sets[pivot]
        place = np.minimum(np.searchsorted(own, every), len(own) - 1)
        total = np.append(0, np.cumsum(own[place] == every))
        return total[at[1:]] - total[at[:-1]]

    def measure(self, pivot: int, members: np.ndarray, every: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Distances to a pivot; its links are made on the way."""
        both = self.common(pivot, members, every, at)
        union = self.sizes[members] + self.sizes[pivot] - both
        for k in members[100 * both >= PERCENT * union].tolist():
            self.link(pivot, k)
        return 1 - both / union

    def join(self, members: np.ndarray, depth: int = 0) -> None:
        """Find all links among ``members`` that change components, recursively."""
        roots = {self.root(k) for k in members.tolist()}
        if len(roots) < 2:
            return
        every = np.concatenate([self.sets[k] for k in members.tolist()])
        at = np.append(0, np.cumsum(self.sizes[members]))
        if len(members) <= CELL or depth > 40:
            for i, k in enumerate(members[:-1].tolist()):
                rest = members[i + 1 :]
                self.measure(k, rest, every[at[i + 1] :], at[i + 1 :] - at[i + 1])
            return
        # Pivots: one each of some components, those that are spread out first.
        pivots: list[int] = []
        nearest = np.full(len(members), 2.0)
        distances = []
        candidate = 0
        while len(pivots) < 8 and nearest[candidate] > REACH:
            pivots.append(int(members[candidate]))
            distances.append(self.measure(pivots[-1], members, every, at))
            nearest = np.minimum(nearest, distances[-1])
            candidate = int(np.argmax(nearest))
        table = np.stack(distances)
        cell = table.argmin(axis=0)
        # A cell holds what is nearest to its pivot and shares something with it; the rest are apart from all.
        apart = nearest > 0.6
        cells = []
        for q in range(len(pivots)):
            own = (cell == q) & ~apart
            if not own.any():
                continue
            radius = table[q][own].max()
            # d(x, q) <= d(x, y) + d(y, q), and no member of the cell is nearer to another pivot.
            window = (table[q] <= radius + REACH + MARGIN) & (table[q] - nearest <= 2 * REACH + MARGIN)
            cells.append(members[own | window])
        rest = apart | (nearest >= 0.6 - REACH - MARGIN)
        done = np.isin(members, pivots)
        rest &= ~done
        if rest.any() and apart[~done].any():
            cells.append(members[rest])
        cells = [own[~np.isin(own, pivots)] for own in cells]
        if sum(map(len, cells)) > 1.5 * len(members):
            # Cells overlap too much to be of use: meet from the smaller components outward.
            self.peel(members, every, at)
            return
        for own in cells:
            if len(own) > 1:
                # Pivots have met everybody, so each level is smaller by them at least.
                self.join(own, depth + 1)

    def peel(self, members: np.ndarray, every: np.ndarray, at: np.ndarray) -> None:
        """Compare everybody outside the largest component with all others."""
        roots = np.array([self.root(k) for k in members.tolist()])
        named, sizes = np.unique(roots, return_counts=True)
        for k in members[roots != named[sizes.argmax()]].tolist():
            if len({self.root(x) for x in members.tolist()}) < 2:
                return
            self.measure(k, members, every, at)


def profile(own: np.ndarray) -> bytes:
    """Shingles of a set counted in buckets, one or two in each; at most 255 count.

    The buckets are pivots that any two sets share: the distance of two profiles, summed over
    the buckets, is a lower bound of the size of the sets' difference.
    """
    size = 1 << max(3, len(own).bit_length() - 1)
    counts = np.bincount((own & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def folded(counts: np.ndarray, size: int) -> np.ndarray:
    """Profiles (rows) brought to fewer buckets."""
    while counts.shape[1] > size:
        half = counts.shape[1] // 2
        counts = np.minimum(counts[:, :half] + counts[:, half:], 255)
    return counts


def may_link(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Whether profiles and set sizes allow a link: at most a fifth of the union may differ."""
    gap = np.abs(x - y).sum(axis=-1)
    # |x ^ y| <= (1 - t) |x | y| and |x | y| = (|x| + |y| + |x ^ y|) / 2.
    return gap * (100 + PERCENT) <= (nx + ny) * (100 - PERCENT)


def _near_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Those of the pairs that profiles and sizes allow."""
    for batch in batches:
        x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
        nx, ny = (batch.column(c).to_numpy() for c in ("nx", "ny"))
        ok = np.zeros(len(x), bool)
        for k, (a, b) in enumerate(zip(x, y)):
            size = min(len(a), len(b))
            a, b = (folded(np.frombuffer(v, np.uint8).astype(np.int64)[None], size) for v in (a, b))
            ok[k] = may_link(a[0], nx[k], b[0], ny[k])
        kept = pa.array(ok)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").filter(kept), batch.column("pivot").filter(kept)], ["doc_id", "pivot"]
        )


def by_region(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that are sorted by region, one batch for each region."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        region = batch.column("region").to_numpy()
        if not len(region):
            continue
        starts = np.flatnonzero(np.append(True, region[1:] != region[:-1]))
        ends = np.append(starts[1:], len(region))
        if held and held[-1].column("region")[0].as_py() != int(region[0]):
            yield pa.concat_batches(held)
            held = []
        for a, b in zip(starts.tolist(), ends.tolist()):
            if held and a:
                yield pa.concat_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.concat_batches(held)


def _suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of each region whose profile allows a link to one of another component."""
    for rows in by_region(batches):
        n, comp = rows.column("n").to_numpy(), rows.column("comp").to_numpy()
        raw = rows.column("profile").to_pylist()
        keep = np.zeros(len(n), bool)
        widths = np.fromiter(map(len, raw), np.int64, len(raw))
        by_width = {w: np.flatnonzero(widths == w) for w in np.unique(widths).tolist()}
        tables = {
            w: np.frombuffer(b"".join(raw[k] for k in own.tolist()), np.uint8).reshape(-1, w).astype(np.int16)
            for w, own in by_width.items()
        }
        for w, own in by_width.items():
            # Sizes within reach have at most twice the buckets.
            for v in (w, 2 * w):
                if v not in by_width:
                    continue
                other = folded(tables[v], w)
                theirs = by_width[v]
                for i, k in enumerate(own.tolist()):
                    apart = comp[theirs] != comp[k]
                    if keep[k] and keep[theirs].all():
                        continue
                    ok = apart & may_link(tables[w][i][None], n[k], other, n[theirs])
                    if ok.any():
                        keep[k] = True
                        keep[theirs[ok]] = True
        if keep.any():
            kept = pa.array(keep)
            yield pa.RecordBatch.from_arrays(
                [rows.column(c).filter(kept) for c in ("region", "doc_id", "n", "comp")], ["region", "doc_id", "n", "comp"]
            )


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links between components inside each region, found recursively."""
    for rows in by_region(batches):
        ids = rows.column("doc_id").to_numpy()
        lists = rows.column("shingles")
        values = np.asarray(lists.values).view(np.uint64)
        at = np.asarray(lists.offsets)
        region = Region([values[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())], rows.column("comp").to_numpy())
        region.join(np.arange(len(ids)))
        if region.links:
            pairs = np.array(region.links, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids[pairs[:, 0]]), pa.array(ids[pairs[:, 1]])], ["a", "b"])


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id")
        for i, sets in shingle_sets(batch.column("text")):
            n = np.fromiter(map(len, sets), np.int64, len(sets))
            yield pa.RecordBatch.from_arrays(
                [ids.slice(i, len(sets)), pa.array(n), pa.array([profile(x) for x in sets], pa.binary())],
                ["doc_id", "n", "profile"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id")
        for i, sets in shingle_sets(batch.column("text")):
            n = np.fromiter(map(len, sets), np.int64, len(sets))
            every = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
            at = np.append(0, np.cumsum(n)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(every.view(np.int64)))
            yield pa.RecordBatch.from_arrays([ids.slice(i, len(sets)), pa.array(n), lists], ["doc_id", "n", "shingles"])


def chosen_texts(rows: DataFrame, ids: DataFrame, limit: int) -> DataFrame:
    """The rows of some documents; their ids were written."""
    return rows.join(few(ids, limit), "doc_id", "left_semi")


def near_pairs(pairs: DataFrame, lean: DataFrame) -> DataFrame:
    """``doc_id, pivot`` of the pairs whose profiles, a fraction of the sets, allow a link."""
    met = pairs.join(lean.select("doc_id", F.col("n").alias("nx"), F.col("profile").alias("x")), "doc_id")
    met = met.join(lean.select(F.col("doc_id").alias("pivot"), F.col("n").alias("ny"), F.col("profile").alias("y")), "pivot")
    met = met.select("doc_id", "pivot", "nx", "x", "ny", "y")
    return met.mapInArrow(_near_pairs, "doc_id long, pivot long").distinct()


def both_ends(pairs: DataFrame) -> DataFrame:
    return staged(pairs.select("doc_id").union(pairs.select(F.col("pivot").alias("doc_id"))).distinct())


def distances(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``doc_id, pivot, distance, linked`` of distinct pairs, from the documents' sets."""
    left = sets.select("doc_id", F.col("shingles").alias("x"))
    right = sets.select(F.col("doc_id").alias("pivot"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y")).cast("long")
    met = pairs.join(left, "doc_id").join(right, "pivot").select(
        "doc_id", "pivot", both.alias("both"), (F.size("x") + F.size("y")).cast("long").alias("sizes")
    )
    union = F.col("sizes") - F.col("both")
    # An id that names several texts has several sets; any of them may link.
    return met.groupBy("doc_id", "pivot").agg(
        F.min(1 - F.col("both") / union).alias("distance"),
        F.bool_or(100 * F.col("both") >= PERCENT * union).alias("linked"),
    )


def _sorted(rows: DataFrame, parts: int) -> DataFrame:
    """Regions whole and in a row; none has more shingles than one task may hold."""
    return rows.repartition(parts, "region").sortWithinPartitions("region", "doc_id", "n")


def _halves(h: Column) -> list[Column]:
    return [h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)]


def _open(members: DataFrame, comps: DataFrame) -> DataFrame:
    """``region, doc_id, n, comp, weight`` of regions with more than one component, each set of members once."""
    rows = members.select("region", "doc_id", "n").join(few(comps), "doc_id")
    # Sums of halves of a hash: repeated rows add up, and don't cancel.
    halves = [h for seed in range(2) for h in _halves(F.xxhash64("doc_id", "n", F.lit(seed)))]
    marks = [F.sum(h).alias(f"mark_{k}") for k, h in enumerate(halves)]
    stats = rows.groupBy("region").agg(
        F.min("comp").alias("low"),
        F.max("comp").alias("high"),
        F.sum("n").alias("weight"),
        F.count(F.lit(1)).alias("size"),
        *marks,
    ).where("low <> high")
    once = stats.groupBy("size", "weight", *[f"mark_{k}" for k in range(len(marks))]).agg(F.min("region").alias("region"))
    once = staged(once.select("region", "weight"))
    return staged(rows.join(few(once), "region"))


def _split(rows: DataFrame, sets_of, pivots: int) -> tuple[DataFrame, DataFrame]:
    """Cells of large open regions, and links found.

    The components with the fewest documents of a region give a pivot each. A cell holds such a
    component and the documents within its radius plus the reach of a link; all other components
    stay together. Pivots have met everybody in their region and leave it.
    """
    per = rows.groupBy("region", "comp").agg(F.count(F.lit(1)).alias("size"), F.min("doc_id").alias("pivot"))
    # Spark limits each group before the shuffle: a region with many components sends so many rows a task.
    order = Window.partitionBy("region").orderBy("size", "comp")
    top = per.withColumn("k", F.row_number().over(order)).where(F.col("k") <= pivots)
    chosen = staged(top.select("region", "comp", "pivot"))
    cells = chosen.select("region", F.col("comp").alias("cell"), "pivot")
    crossed = rows.select("region", "doc_id", "n", "comp").join(cells, "region")
    pairs = staged(crossed.where("doc_id <> pivot").select("doc_id", "pivot").distinct())
    met = staged(distances(pairs, sets_of(both_ends(pairs))))
    links = met.where("linked").select(F.col("doc_id").alias("a"), F.col("pivot").alias("b"))
    placed = crossed.join(met, ["doc_id", "pivot"])
    radius = placed.where("comp = cell").groupBy("region", "cell").agg(F.max("distance").alias("radius"))
    inside = placed.join(radius, ["region", "cell"]).where(
        (F.col("comp") == F.col("cell")) | (F.col("distance") <= F.col("radius") + F.lit(REACH + MARGIN))
    )
    inside = inside.select(F.xxhash64("region", "cell").alias("region"), "doc_id", "n")
    rest = rows.join(chosen.select("region", "comp"), ["region", "comp"], "left_anti")
    rest = rest.select(F.xxhash64("region", F.lit("rest")).alias("region"), "doc_id", "n")
    return staged(inside.union(rest)), links


def near_duplicates(
    docs: DataFrame,
    region_shingles: int = REGION_SHINGLES,
    pivots: int = PIVOTS,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs``.

    A null text, and one without words, has an empty set and is linked with nothing. Rows that share a
    doc_id are one document, linked by any of its texts; rows with a null id keep a null
    component. An empty table gives no rows. Other columns are ignored.
    """
    bound_batches(docs)
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen = staged(
        rows.mapInArrow(_summaries, "doc_id long, n long, sig_a long, sig_b long, shingle long, times long")
    )
    points = seen.where("n is not null").select("doc_id", "n", "sig_a", "sig_b")
    times = seen.where("times is not null").select("shingle", "times")
    frequent = spark.sparkContext.broadcast(frequent_shingles(times, broadcast_rows))

    # Equal sets are one point, named by its smallest document.
    named = points.where("n > 0 and doc_id is not null")
    classes = staged(
        named.groupBy("n", "sig_a", "sig_b").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1")
    )
    copies = staged(named.join(classes, ["n", "sig_a", "sig_b"]).where("doc_id <> first").select("doc_id").distinct())
    # A document that repeats its id with other texts is kept whole.
    several = points.groupBy("doc_id").agg(F.count_distinct("sig_a").alias("texts")).where("texts > 1").select("doc_id")
    copies = staged(copies.join(several, "doc_id", "left_anti"))
    single = rows.where("doc_id is not null").join(few(copies, broadcast_rows), "doc_id", "left_anti")

    entry = "region long, doc_id long, n long"
    light = single.mapInArrow(lambda batches: _entries(batches, frequent, False), entry)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    light = light.repartition(parts, "region").sortWithinPartitions("region", "doc_id", "n").mapInArrow(_regions, MEMBER)
    # Each task sends one head of a dense region; the rows themselves meet it in a join that Spark can split.
    dense = staged(single.mapInArrow(lambda batches: _entries(batches, frequent, True), entry))
    heads = dense.groupBy("region").agg(F.min(F.struct("doc_id", "n")).alias("head"), F.count(F.lit(1)).alias("size"))
    heads = heads.where("size > 1").select("region", F.col("head.doc_id").alias("pivot"), F.col("head.n").alias("pivot_n"))
    members = staged(light.union(dense.join(heads, "region").select("region", "doc_id", "n", "pivot", "pivot_n")))

    # Profiles of the documents that meet another, and sets of those that may link with a first pivot.
    def sets_of(ids: DataFrame) -> DataFrame:
        sets = chosen_texts(rows, ids, broadcast_rows).mapInArrow(_sets, "doc_id long, n long, shingles array<long>")
        return staged(sets.where("n > 0"))

    met = staged(members.select("doc_id").distinct())
    lean = chosen_texts(rows, met, broadcast_rows).mapInArrow(_profiles, "doc_id long, n long, profile binary")
    lean = staged(lean.where("n > 0"))
    pairs = members.where((F.col("doc_id") != F.col("pivot")) & reachable("n", "pivot_n")).select("doc_id", "pivot")
    pairs = staged(near_pairs(pairs.distinct(), lean))
    found = staged(distances(pairs, sets_of(both_ends(pairs))).where("linked"))
    comps = merged(met.withColumn("comp", F.col("doc_id")), found.select(F.col("doc_id").alias("a"), F.col("pivot").alias("b")))

    todo = members
    while True:
        todo = _open(todo, comps)
        small, large = todo.where(F.col("weight") <= region_shingles), todo.where(F.col("weight") > region_shingles)
        if todo.isEmpty():
            break
        profiled = small.select("region", "doc_id", "comp").join(lean, "doc_id")
        suspects = staged(_sorted(profiled, parts).mapInArrow(_suspects, "region long, doc_id long, n long, comp long"))
        sets = sets_of(staged(suspects.select("doc_id").distinct()))
        leaves = suspects.join(sets, ["doc_id", "n"])
        links = _sorted(leaves, parts).mapInArrow(_leaves, "a long, b long")
        if large.isEmpty():
            comps = merged(comps, staged(links))
            break
        todo, more = _split(large, sets_of, pivots)
        comps = merged(comps, staged(links.union(more)))

    # Documents of a class follow its first; all others stand for themselves.
    belongs = classes.join(few(comps), classes["first"] == comps.doc_id, "left").select(
        "n", "sig_a", "sig_b", F.coalesce("comp", "first").alias("of_class")
    )
    own = few(staged(comps.where("doc_id <> comp").select(F.col("doc_id").alias("own_id"), F.col("comp").alias("own"))))
    belongs = few(staged(belongs))
    result = points.join(belongs, ["n", "sig_a", "sig_b"], "left").join(own, F.col("doc_id") == F.col("own_id"), "left")
    return result.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("of_class", "own", "doc_id")).alias("component_id"),
    )

