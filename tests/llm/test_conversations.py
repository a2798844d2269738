"""Conversation repair against a search over all edits, and against a plain DP over whole tables."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tallywork.llm import conversations, queries

SPACES = " \t\n\x0b\x0c\r"


@pytest.fixture(scope="module", autouse=True)
def folder(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


def plain_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(SPACES)
        if not bare:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_repair(rows):
    """Best first over (cost, audit): whole lists of edits, checked against the pattern itself."""
    faults = plain_faults(rows)
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, k, shape = heapq.heappop(heap)
        # What was said before can be told from the last letter and whether anything was said.
        if (k, shape[-1:]) in done:
            continue
        done.add((k, shape[-1:]))
        if k == len(rows) and re.fullmatch("(s?(ua)+)?", shape):
            return cost, audit
        nexts = []
        for new in "ua":
            nexts.append((5, "I", k, new))
        if k < len(rows):
            nexts.append((2, "D", k + 1, ""))
            if faults[k] not in ("blank", "duplicate"):
                extra = 5 if faults[k] == "truncated" else 0
                nexts.append((extra, "K", k + 1, rows[k][1][:1] or "?"))
                nexts += [(1 + extra, "R", k + 1, new) for new in "ua"]
        for more, edit, then, new in nexts:
            grown = shape + new
            if re.fullmatch("(s?(ua)*u?)?", grown):
                heapq.heappush(heap, (cost + more, audit + edit, then, grown))
    raise AssertionError


def plain_summary(rows):
    cost, audit = plain_repair(rows)
    faults = plain_faults(rows)
    out, k, last = [], 0, ""
    for edit in audit:
        wanted = "assistant" if last == "u" else "user"
        if edit == "I":
            out.append((wanted, ""))
        elif edit == "D":
            k += 1
            continue
        else:
            out.append((rows[k][1] if edit == "K" else wanted, rows[k][2]))
            k += 1
        last = out[-1][0][0]
    turns = [t for t, _, _ in rows if t is not None]
    pairs = zip(rows, rows[1:])
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairs)
    text = "\n".join(f"{r}:{t}" for r, t in out)
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        illegal,
        cost,
        audit,
        hashlib.sha256(text.encode()).hexdigest(),
    )


def plain_query(rows):
    convs = {c: [] for c, *_ in rows}
    for conv, turn, role, text in rows:
        name = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text = name(role), name(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        convs[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    return {c: plain_summary(sorted(own, key=order)) for c, own in convs.items()}


def table():
    rng = random.Random(6)
    rows = []
    for conv in range(150):
        n = rng.randint(1, 9)
        for turn in range(n):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            if rng.random() < 0.7:
                role = "user" if turn % 2 == 0 else "assistant"
            text = rng.choice(["Hi.", "Yes!", "cut", "cut \n", " ", None, "So?", f"Text {conv} {turn}."])
            rows.append((conv, rng.choice([turn, turn, turn, None, turn + 3]), role, text))
    rows += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Yo."), *[(500, 0, "user", "Same.")] * 30]
    return rows


def test_query_against_a_search_over_edits(spark, tmp_path):
    rows = table()
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    docs.withColumn("block", F.lit("clash")).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in queries.op13_conversation_repair(spark, str(tmp_path)).collect()}
    want = plain_query(rows)
    assert got == want
    assert len({w[6] for w in want.values()}) > 40


@pytest.mark.parametrize("block", [1, 3, 64])
def test_long_conversations_in_blocks(spark, block):
    rng = random.Random(block)
    rows = []
    for conv in (1, 2):
        for turn in range(120):
            role = rng.choice(["user", "assistant", "assistant", "system"])
            rows.append((conv, turn, role, rng.choice(["Hi.", f"{turn}.", f"cut {turn}", ""])))
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    edited = conversations.repair(docs, block)
    got = {r.conv_id: tuple(r)[1:] for r in conversations.summaries(edited).collect()}
    assert edited.select("block").distinct().count() > 3
    for conv in (1, 2):
        assert got[conv] == plain_summary([r[1:] for r in rows if r[0] == conv])
        repaired = conversations.repaired_rows(edited).where(f"conv_id = {conv}").orderBy("block", "place", "part").collect()
        text = "\n".join(f"{r.role}:{r.text}" for r in repaired)
        assert hashlib.sha256(text.encode()).hexdigest() == got[conv][-1]


def test_only_every_root_vector_is_kept(monkeypatch):
    calls = []
    before = conversations.before
    monkeypatch.setattr(conversations, "before", lambda *a: calls.append(1) or before(*a))
    rows = [(1, "ua"[k % 2], 0) for k in range(10_000)]
    states, edits, last = conversations.walk(rows, conversations.END, 0)
    assert "".join(edits) == "K" * 10_000 and last == 3 and states[:3] == [0, 2, 3]
    assert len(calls) == 20_000  # once to store, once more on the way


def test_empty_table(spark):
    docs = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.audited(docs).collect() == []
