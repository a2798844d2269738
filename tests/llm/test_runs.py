"""Periodic runs against every period of every text."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tallywork.llm import queries, runs
from tallywork.llm.text import flat


@pytest.fixture(scope="module", autouse=True)
def folder(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


def plain(words, least=12):
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            first = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - first >= q and i + q - first >= least:
                found.setdefault((first, i + q), q)
            i += i == first
    return sorted((s, e - s, q) for (s, e), q in found.items())


def kept(words, found):
    drop = {i for s, length, q in found for i in range(s + q, s + length)}
    return [w for i, w in enumerate(words) if i not in drop]


def texts():
    rng = random.Random(3)
    out = [[], ["a"], ["a"] * 11, ["a"] * 12, ["a", "b"] * 6, list("abc" * 4) + ["a"]]
    for _ in range(150):
        n, letters = rng.choice([5, 30, 80, 200, 400]), rng.choice([1, 2, 2, 3, 20])
        words = [rng.choice("abcdefghijklmnopqrst"[:letters]) for _ in range(n)]
        for _ in range(rng.randint(0, 3)):
            a = rng.randrange(n)
            p = rng.randint(1, max(1, (n - a) // 2))
            for i in range(a, min(n, a + rng.randint(p, 5 * p))):
                words[i] = words[a + (i - a) % p]
        out.append(words)
    x, y = ["a"], ["a", "b"]
    while len(y) < 600:
        x, y = y, y + x
    out.append(y)
    # Periods that are highly periodic themselves.
    for j in range(2, 25):
        u = ["a", "b"] * j + ["a"]
        out += [u + u, u * 3, ["x"] + u + u + ["x"] + u + u]
        z = [rng.choice("ab") for _ in range(rng.randint(2, 4))] * rng.randint(5, 30) + ["b"] * rng.randint(0, 2)
        out += [z * rng.randint(2, 4) + z[: rng.randint(0, len(z))], (z * 2 + ["a"]) * 3]
    return out


def test_all_runs_of_every_text():
    listed = texts()
    data, offsets, buffer = flat(pa.array([" \n".join(t) for t in listed]))
    got = runs.runs_of_block(data, buffer, offsets, 12).to_pylist()
    for words, found in zip(listed, got, strict=True):
        want = plain(words)
        assert [(r["start"], r["length"], r["period"]) for r in found["runs"]] == want
        assert found["n_words"] == len(words)
        assert found["collapsed"] == " ".join(kept(words, want))


def test_synchronising_positions_are_locally_consistent_and_dense():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 4, 4000)
    codes[1000:1400] = codes[2000:2400]
    codes[3000:3200] = codes[3000:3002].tolist() * 100
    known = runs.smallest(runs.joined([runs.direct(codes, q) for q in range(1, 12)]))
    scale, names, width = 16, runs.mix(codes.astype(np.uint64)), 1
    while width < scale:
        names, width = runs.mix(names[:-width] * runs.ODD + names[width:]), 2 * width
    chosen = runs.synchronising(names, scale, known)
    inside = lambda a: set((chosen[(chosen >= a) & (chosen <= a + 400 - 2 * scale)] - a).tolist())
    assert inside(1000) == inside(2000)
    gaps = np.diff(chosen)
    wide = chosen[:-1][gaps > scale]
    assert len(wide) == 1 and abs(int(wide[0]) - 3000) < 3 * scale
    assert len(chosen) < 4000 * 4 / scale


def test_hash_errors_are_mended():
    codes = np.array([1, 2, 3] * 8 + [9] + list(range(20, 60)))
    wrong = (np.array([5]), np.array([60]), np.array([20]))
    assert all(len(x) == 0 for x in runs.confirmed(codes, wrong))


def test_rows_with_nulls_copies_and_clashing_names(spark):
    rows = [(1, None, 5), (None, "a b " * 9, 6), (2, "a b " * 9, 7), (2, "a b " * 9, 7), (3, "x" * 100_000, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found int")
    got = runs.periodic_runs(docs).collect()
    by_id = {r.row.doc_id: r for r in got}
    assert len(got) == 5 and by_id[1].found.runs == [] and by_id[1].found.n_words == 0 and by_id[1].row.found == 5
    assert [tuple(x) for x in by_id[None].found.runs] == [(0, 18, 2)] and by_id[2].found.collapsed == "a b"
    assert runs.periodic_runs(docs.limit(0)).collect() == []


def test_query(spark, tmp_path):
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice("abcdefgh") for _ in range(rng.choice([1, 9, 60, 300])))) for k in range(120)]
    rows += [(200, None), (201, ""), (202, " \x0b ")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()}
    hit = 0
    for doc_id, text in rows:
        words = re.findall("[^\x20\x09-\x0d]+", text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = plain(words)
        best = min(((-length, s, q) for s, length, q in found), default=None)
        longest = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, " ".join(kept(words, found)))]
        assert got[doc_id] == (len(found), *longest, *digests)
        hit += bool(found)
    assert hit > 3
