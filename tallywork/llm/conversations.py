"""Repair of conversations: the cheapest edits that make roles alternate.

A conversation is read as a path through four states: nothing said, after the system, after the user, after the
assistant. Costs from a row to the end are a vector of four numbers. Only the vectors of every
square root of n-th row are stored; walking forward, the vectors in between are computed again, one stretch at a
time, and the least of the edits that keep the cost is taken.

Rows are dealt by ranges, so a long conversation lies on several tasks as blocks of bounded size. One that is
whole in a block is decided there. For the others, each block gives the costs from each of its first states to
each last one, these blocks are summed up from the end, and then walked through from each state a block can begin in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywork.llm.text import bound_batches
from tallywork.session import staged

BLOCK = 4096  # rows of a conversation that a task decides at once
BLOCK_BYTES = 16 << 20
PART_ROWS = 1 << 17  # aimed at in a range of rows

# Costs of edits, the white space and closing marks of the contract.
DELETE, INSERT, REROLE, CUT_OFF = 2, 5, 1, 5
SPACES = " \t\n\x0b\x0c\r"
CLOSING = (".", "!", "?")
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3

# States: 0 nothing, 1 after s, 2 after u, 3 after a. The state after a role that fits, and the role that is wanted.
FAR = 1 << 40
FITS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
WANTED = ((2, "user"), (2, "user"), (3, "assistant"), (2, "user"))
LEGAL = {"su", "ua", "au"}

Vector = tuple[int, int, int, int]
Row = tuple[int, str, int]  # copies, role initial, fault


def closed(costs: list[int]) -> Vector:
    """Costs when rows may be inserted first."""
    user, other = costs[2], costs[3]
    after_user = min(user, INSERT + other)
    return (
        min(costs[0], INSERT + after_user),
        min(costs[1], INSERT + after_user),
        after_user,
        min(other, INSERT + user),
    )


END: Vector = closed([0, FAR, FAR, 0])


def options(state: int, row: Row) -> list[tuple[str, int, int]]:
    """``(edit, cost, next state)`` of a row's first copy."""
    _, initial, fault = row
    found = [("D", DELETE, state)]
    if fault not in (BLANK, DUPLICATE):
        extra = CUT_OFF if fault == TRUNCATED else 0
        if (state, initial) in FITS:
            found.append(("K", extra, FITS[state, initial]))
        found.append(("R", REROLE + extra, WANTED[state][0]))
    return found


CHOICES: dict[tuple[str, int], list[list[tuple[str, int, int]]]] = {
    (initial, fault): [options(state, (1, initial, fault)) for state in range(4)]
    for initial in ("s", "u", "a", "")
    for fault in range(4)
}


def before(row: Row, after: Vector) -> Vector:
    """Costs from a row on, given those from the next one; further copies can only be deleted."""
    rest = DELETE * (row[0] - 1)
    choices = CHOICES[row[1], row[2]]
    return closed([rest + min([cost + after[then] for _, cost, then in choices[state]]) for state in range(4)])


def walk(rows: list[Row], end: Vector, state: int) -> tuple[list[int], list[str], int]:
    """``(states, edits, last state)``: the least cheapest edits from a state; ``edits`` are each row's, inserts first."""
    n = len(rows)
    step = max(1, int(n**0.5))
    marks = {n: end}
    costs = end
    for k in reversed(range(n)):
        costs = before(rows[k], costs)
        if k % step == 0:
            marks[k] = costs
    states, edits = [], []
    for first in range(0, n, step):
        last = min(n, first + step)
        vectors = [marks[last]]
        for k in reversed(range(first, last)):
            vectors.append(before(rows[k], vectors[-1]))
        vectors.reverse()
        for k in range(first, last):
            here, after = vectors[k - first], vectors[k - first + 1]
            row = rows[k]
            rest = DELETE * (row[0] - 1)
            states.append(state)
            taken = []
            while True:
                tight = {e: s for e, cost, s in CHOICES[row[1], row[2]][state] if cost + rest + after[s] == here[state]}
                if "D" not in tight and INSERT + here[WANTED[state][0]] == here[state]:
                    taken.append("I")
                    state = WANTED[state][0]
                    continue
                edit = min(tight)
                state = tight[edit]
                taken.append(edit + "D" * (row[0] - 1))
                break
            edits.append("".join(taken))
    return states, edits, state


def closing(state: int) -> str:
    """Inserts that end a conversation."""
    taken = ""
    while END[state]:
        taken, state = taken + "I", WANTED[state][0]
    return taken


def _listed(rows: pa.Table | pa.RecordBatch) -> list[Row]:
    return list(zip(*(rows.column(c).to_pylist() for c in ("times", "initial", "fault"))))


def _starts(ids: pa.Array) -> np.ndarray:
    """Where a new id begins; null is an id."""
    codes = ids.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))


def _decided(batches: Iterator[pa.RecordBatch], block_rows: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows with block and place, and state and edits where a conversation surely is whole."""
    number = TaskContext.get().partitionId() << 32
    held: pa.RecordBatch | None = None
    whole = False  # whether the held conversation began in this task

    def put(rows: pa.RecordBatch, starts: list[int], first_whole: bool) -> pa.RecordBatch:
        nonlocal number
        block, place, states, edits = [], [], [], []
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], rows.num_rows])):
            block += [number] * (b - a)
            place += range(b - a)
            number += 1
            if k or first_whole:
                own, taken, last = walk(_listed(rows.slice(a, b - a)), END, 0)
                taken[-1] += closing(last)
            else:
                own, taken = [None] * (b - a), [None] * (b - a)
            states += own
            edits += taken
        more = [pa.array(block, pa.int64()), pa.array(place, pa.int64()), pa.array(states, pa.int32()), pa.array(edits, pa.string())]
        names = [*rows.schema.names, "block", "place", "state", "edits"]
        return pa.RecordBatch.from_arrays([*rows.columns, *more], names)

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.concat_batches([held, batch]) if held is not None else batch
        starts = _starts(rows.column("conv_id")).tolist()
        last = starts.pop()
        if last:
            yield put(rows.slice(0, last), starts, whole)
            whole = True
        held = rows.slice(last)
        if held.num_rows >= block_rows or held.nbytes >= BLOCK_BYTES:
            # More of it may follow: it is not decided here.
            for a in range(0, held.num_rows, block_rows):
                yield put(held.slice(a, block_rows), [0], False)
            held, whole = None, False
    if held is not None:
        yield put(held, [0], False)


def _costs(rows: pa.Table) -> pa.Table:
    """The costs of a block from each first state to each last one, without what is inserted behind it."""
    rows = rows.sort_by("place")
    listed = _listed(rows)
    columns = []
    for last in range(4):
        costs: Vector = tuple(0 if s == last else FAR for s in range(4))
        for row in reversed(listed):
            costs = before(row, costs)
        columns.append(costs)
    matrix = [columns[e][s] for s in range(4) for e in range(4)]
    return pa.table({"conv_id": rows.column("conv_id")[:1], "block": rows.column("block")[:1], "costs": pa.array([matrix], pa.list_(pa.int64()))})


def _ends(blocks: pa.Table) -> pa.Table:
    """The costs behind each block of a conversation."""
    blocks = blocks.sort_by("block")
    end, ends = END, []
    for matrix in reversed(blocks.column("costs").to_pylist()):
        ends.append(list(end))
        end = closed([min(matrix[4 * s + e] + end[e] for e in range(4)) for s in range(4)])
    is_last = np.arange(blocks.num_rows) == blocks.num_rows - 1
    return pa.table(
        {"of_block": blocks.column("block"), "ending": pa.array(ends[::-1], pa.list_(pa.int64())), "is_last": pa.array(is_last)}
    )


def _tried(rows: pa.Table) -> pa.Table:
    """A block's states and edits for each state it may begin in, and the state it ends in."""
    rows = rows.sort_by("place")
    listed, end = _listed(rows), tuple(rows.column("ending")[0].as_py())
    states, edits, lasts = [], [], []
    for first in range(4):
        own, taken, last = walk(listed, end, first)
        if rows.column("is_last")[0].as_py():
            taken[-1] += closing(last)
        states.append(own)
        edits.append(taken)
        lasts.append(last)
    n = len(listed)
    return pa.table(
        {
            "conv_id": rows.column("conv_id"),
            "block": rows.column("block"),
            "place": rows.column("place"),
            "states": pa.array([list(x) for x in zip(*states)], pa.list_(pa.int32())),
            "tried": pa.array([list(x) for x in zip(*edits)], pa.list_(pa.string())),
            "lasts": pa.array([lasts] + [None] * (n - 1), pa.list_(pa.int32())),
        }
    )


def _entered(blocks: pa.Table) -> pa.Table:
    """The state each block of a conversation begins in."""
    blocks = blocks.sort_by("block")
    state, entered = 0, []
    for lasts in blocks.column("lasts").to_pylist():
        entered.append(state)
        state = lasts[state]
    return pa.table({"of_block": blocks.column("block"), "entered": pa.array(entered, pa.int32())})


def units(rows: DataFrame) -> DataFrame:
    """Equal rows as one with their number, and each row's fault and role initial; nulls are one space.

    Repeated rows collapse before the shuffle. ``fault`` is the first copy's: 1 blank, 2 duplicate, 3 truncated.
    """
    filled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    own = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *filled, "times")
    own = staged(own.groupBy("conv_id", "turn", "role", "text").agg(F.sum("times").alias("times")))
    said = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))
    own = own.withColumn("said", F.unhex(said))
    at = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = own.groupBy(F.col("conv_id").alias("of_conv"), F.col("said").alias("of_said")).agg(F.min(at).alias("first"))
    met = own.join(first, F.col("conv_id").eqNullSafe(F.col("of_conv")) & (F.col("said") == F.col("of_said")))
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = (
        F.when(bare == "", BLANK)
        .when(~at.eqNullSafe(F.col("first")), DUPLICATE)
        .when(~F.right(bare, F.lit(1)).isin(*CLOSING), TRUNCATED)
        .otherwise(0)
    )
    initial = F.left("role", F.lit(1))
    return met.select(
        "conv_id", "turn", "role", "text", "times", F.when(initial.isin("s", "u", "a"), initial).otherwise("").alias("initial"), fault.alias("fault")
    )


def repair(rows: DataFrame, block_rows: int = BLOCK) -> DataFrame:
    """The distinct rows of each conversation in order, with the edits that repair it.

    ``rows`` has conv_id, turn, role, text, and may have ``times``, the copies a row stands for. Returns conv_id,
    block, place (their order), turn, role, text, times, initial, fault, state (before the row), edits: K keep,
    R rerole, D delete, I insert, those inserted before the row first, and copies' deletions last.
    Null roles and texts are one space; a null turn comes first, a null conv_id is a conversation; rows of one
    turn are in order of role and text; empty tables give no rows; other columns are left out.
    """
    if "times" not in rows.columns:
        rows = rows.withColumn("times", F.lit(1).cast("long"))
    bound_batches(rows)
    spark = rows.sparkSession
    found = staged(units(rows))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-found.count() // PART_ROWS))
    dealt = found.repartitionByRange(parts, "conv_id", "turn", "role", F.left("text", F.lit(64)))
    dealt = dealt.sortWithinPartitions("conv_id", "turn", "role", "text")
    more = [T.StructField("block", T.LongType()), T.StructField("place", T.LongType()), T.StructField("state", T.IntegerType())]
    schema = T.StructType([*found.schema.fields, *more, T.StructField("edits", T.StringType())])
    lined = staged(dealt.mapInArrow(partial(_decided, block_rows=block_rows), schema))

    open_rows = lined.where("edits is null")
    narrow = open_rows.select("conv_id", "block", "place", "times", "initial", "fault")
    kind = found.schema["conv_id"].dataType.simpleString()
    costs = narrow.groupBy("block").applyInArrow(_costs, f"conv_id {kind}, block long, costs array<long>")
    ends = costs.groupBy("conv_id").applyInArrow(_ends, "of_block long, ending array<long>, is_last boolean")
    met = narrow.join(ends, F.col("block") == F.col("of_block"))
    tried = met.groupBy("block").applyInArrow(
        _tried, f"conv_id {kind}, block long, place long, states array<int>, tried array<string>, lasts array<int>"
    )
    tried = staged(tried)
    lasts = tried.where("lasts is not null").select("conv_id", "block", "lasts")
    entered = lasts.groupBy("conv_id").applyInArrow(_entered, "of_block long, entered int")
    chosen = tried.join(entered, F.col("block") == F.col("of_block")).select(
        "block", "place", F.get("states", "entered").alias("state"), F.get("tried", "entered").alias("edits")
    )
    rest = open_rows.drop("state", "edits").join(chosen, ["block", "place"]).select(*lined.columns)
    return lined.where("edits is not null").unionByName(rest)


def _lines(role: str, text: str, state: int, edits: str) -> Iterator[tuple[str, str]]:
    """The repaired rows that a row's edits give."""
    for edit in edits:
        if edit == "I":
            state, wanted = WANTED[state]
            yield wanted, ""
        elif edit == "R":
            state, wanted = WANTED[state]
            yield wanted, text
        elif edit == "K":
            state = FITS[state, role[0]]
            yield role, text


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        owner, place, role, text = [], [], [], []
        columns = (batch.column(c).to_pylist() for c in ("role", "text", "state", "edits"))
        for k, row in enumerate(zip(*columns)):
            for j, (r, t) in enumerate(_lines(*row)):
                owner.append(k)
                place.append(j)
                role.append(r)
                text.append(t)
        kept = batch.select(["conv_id", "block", "place"]).take(pa.array(owner, pa.int64()))
        more = [pa.array(place, pa.int64()), pa.array(role, pa.string()), pa.array(text, pa.string())]
        yield pa.RecordBatch.from_arrays([*kept.columns, *more], ["conv_id", "block", "place", "part", "role", "text"])


def repaired_rows(edited: DataFrame) -> DataFrame:
    """The rows of the repaired conversations, in order of block, place and part; narrow."""
    kind = edited.schema["conv_id"].dataType.simpleString()
    return edited.mapInArrow(_repaired, f"conv_id {kind}, block long, place long, part long, role string, text string")


class _Tally:
    """What a conversation's rows, met in order, add up to."""

    NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

    def __init__(self):
        self.faults, self.illegal, self.cost = [0, 0, 0, 0], 0, 0
        self.low = self.high = None
        self.turns, self.before, self.empty = 0, None, True
        self.audit: list[str] = []
        self.hash = hashlib.sha256()

    def add(self, turn, role: str, text: str, times: int, initial: str, fault: int, state: int, edits: str) -> None:
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        self.faults[fault] += 1
        self.faults[BLANK if fault == BLANK else DUPLICATE] += times - 1
        self.illegal += times - 1 + (self.before is not None and self.before + initial not in LEGAL)
        self.before = initial
        self.audit.append(edits)
        spent = {"D": DELETE, "I": INSERT, "R": REROLE, "K": 0}
        self.cost += sum(spent[e] * edits.count(e) for e in spent)
        if fault == TRUNCATED and ("K" in edits or "R" in edits):
            self.cost += CUT_OFF
        for r, t in _lines(role, text, state, edits):
            self.hash.update(f"{'' if self.empty else chr(10)}{r}:{t}".encode())
            self.empty = False

    def row(self) -> dict:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        values = (gaps, *self.faults[1:], self.illegal, self.cost)
        return {**dict(zip(self.NAMES, values)), "audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest()}


TALLY = pa.struct([(n, pa.int64()) for n in _Tally.NAMES] + [("audit", pa.string()), ("repaired_sha256", pa.string())])
SUMMARY = ", ".join(f"{n} long" for n in _Tally.NAMES) + ", audit string, repaired_sha256 string"


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation, from sorted rows; only what is summed up is held."""
    names = ("turn", "role", "text", "times", "initial", "fault", "state", "edits")
    held, tally = None, None

    def put(ids: list[pa.Array], rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *pa.array(rows, TALLY).flatten()], ["conv_id", *(f.name for f in TALLY)])

    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("conv_id")
        starts = _starts(ids).tolist()
        done_ids, done = [], []
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            if tally is None or ids[a].as_py() != held[0].as_py():
                if tally is not None:
                    done_ids.append(held)
                    done.append(tally.row())
                held, tally = ids.slice(a, 1), _Tally()
            part = batch.slice(a, b - a)
            for row in zip(*(part.column(c).to_pylist() for c in names)):
                tally.add(*row)
        if done:
            yield put(done_ids, done)
    if tally is not None:
        yield put([held], [tally.row()])


def summaries(edited: DataFrame) -> DataFrame:
    """Per conversation: gaps, faults, illegal neighbours, cost, audit (its edits) and the hash of its repaired lines.

    A hash over all lines needs them in order, so a conversation's edited rows stream through one task,
    which holds no row, only sums and the edits' letters.
    """
    kind = edited.schema["conv_id"].dataType.simpleString()
    rows = edited.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "block", "place")
    return rows.mapInArrow(_tallied, f"conv_id {kind}, {SUMMARY}")


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with planted faults, by the checksum of conversation and turn: dropped, emptied, cut, repeated, wrong role."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20

    def either(k: int, changed: Column, same: Column) -> Column:
        return F.when(kind == k, changed).otherwise(same)

    text = either(1, F.lit(""), either(2, F.translate(filled("text"), "".join(CLOSING), ""), filled("text")))
    return rows.where(kind != 0).select(
        "conv_id",
        "turn",
        either(4, F.lit("user"), filled("role")).alias("role"),
        text.alias("text"),
        either(3, F.lit(2), F.lit(1)).cast("long").alias("times"),
    )


def audited(rows: DataFrame) -> DataFrame:
    """``summaries`` of the repair of ``rows`` after planted faults, for each conv_id of ``rows``; zeros where no row is left."""
    found = summaries(repair(damaged(rows)))
    every = rows.select("conv_id").distinct()
    found = found.withColumnRenamed("conv_id", "own_id")
    met = every.join(found, F.col("conv_id").eqNullSafe(F.col("own_id")), "left")
    zeros = [F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in _Tally.NAMES]
    empty = hashlib.sha256(b"").hexdigest()
    return met.select(
        "conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256")
    )
