"""Every operator against a plain version, on rows with nulls, ties, copies and clashing columns."""

import base64
import hashlib
import io
import random
import re
import struct
import zipfile
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from tallywork.llm import (
    contamination,
    exactdedup,
    jaccard,
    licences,
    packing,
    quality,
    queries,
    slotfilter,
    tokenfile,
    tokens,
    urlmodel,
    warczip,
)

ROOT = Path(__file__).resolve().parents[2]
SCHEMA = "doc_id long, text string, lang string, row string, score double, found int, fp long, region long, n long, bin long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module", autouse=True)
def folder(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


def cases():
    rng = random.Random(5)
    vocabulary = [rng.choice("abcdeéüxyz") * rng.randint(1, 4) + str(k % 7) for k in range(150)]
    base = [[rng.choice(vocabulary) for _ in range(60)] for _ in range(3)]
    texts = [None, "", " \t\n", "One", "one  ONE", "a b c d", "a b c d e", "<|endoftext|> x<|endoftext|>.", "é\u0301 \u00a0 \u2003 y  z\n\n w"]
    for k in range(60):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 8)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(" ".join(words).capitalize() + rng.choice(["", ".", "!\n"]))
    texts += texts[9:14] + [texts[20].replace(" ", "  ")]
    texts.append(" ".join(rng.choice(vocabulary) for _ in range(9000)))
    texts.append("x" * 50_000)
    texts.append("Released under the MIT License.\nSome text. Licensed under CC BY-NC 4.0.")
    return {k: t for k, t in enumerate(texts)}


DOCS = cases()


def frame(spark, docs=DOCS):
    return spark.createDataFrame([(k, t, "en", "r", 1.0, 2, 3, 4, 5, 6) for k, t in docs.items()], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ids_of(name):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.vocabulary(name))
    return {k: tokenizer.encode(t or "", add_special_tokens=False).ids for k, t in DOCS.items()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_counts(docs, empty):
    path = queries.vocabulary("word_bpe_49k.json")
    want = {(k, len((DOCS[k] or "").encode()), len(i), len(i) > 2048) for k, i in ids_of("word_bpe_49k.json").items()}
    assert {tuple(r) for r in tokens.token_counts(docs, path).collect()} == want
    assert tokens.token_counts(empty, path).count() == 0
    assert tokens.token_counts(docs.unionAll(docs), path).count() == 2 * len(DOCS)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_of_random_text_encode_alike(name):
    own = tokens.Encoder(queries.vocabulary(name))
    rng = random.Random(1)
    parts = ["a", "B", " ", " ", "\n", "é", "\u00a0", "\u2003", "\u3000", "'s", ".", "!", "12", "\u0301", "<|endoftext|>", "漢", "\t", "\x85", "\x1f"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    want = [len(e.ids) for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert own.counts(pa.array(texts)).tolist() == want


@pytest.mark.parametrize("node_pieces,size", [(2048, 4096), (5, 4096), (3, 64)])
def test_packing(docs, empty, node_pieces, size):
    path = queries.vocabulary("word_bpe_49k.json")
    rows = packing.pack(packing.pieces(docs, path, size=size), size, node_pieces=node_pieces, fan_in=2).collect()
    by_doc, by_sequence = defaultdict(dict), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id][r.piece] = r
        by_sequence[r.sequence_id].append((r.offset, r.length))
    total = 0
    for k, ids in ids_of("word_bpe_49k.json").items():
        ids = [*ids, 1]
        total += len(ids)
        assert sorted(by_doc[k]) == list(range(-(-len(ids) // size)))
        for p, r in by_doc[k].items():
            assert (r.start, r.ids_crc32) == (p * size, crc(ids[p * size : (p + 1) * size]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    assert len(by_sequence) <= -(-total // size) * 1.1 + 1
    assert packing.packed_documents(empty, path).count() == 0


def test_best_fit_leaves_one_small_bin():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 100, 500)
    bins, offsets, loads = packing.best_fit(lengths, 100)
    assert loads.max() <= 100 and (loads * 2 <= 100).sum() <= 1
    assert np.bincount(bins, lengths).astype(int).tolist() == loads.tolist()


def test_token_files(spark, docs, empty, tmp_path):
    rows = tokenfile.token_files(docs, queries.vocabulary("byte_bpe_50k.json"), folder=str(tmp_path / "f")).collect()
    got, at = {r.doc_id: r for r in rows}, 0
    for k, ids in sorted(ids_of("byte_bpe_50k.json").items()):
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (at, len(ids) + 1, crc([*ids, 0]))
        at += len(ids) + 1
    stored = tokenfile.read(spark, str(tmp_path / "f"))
    assert stored.where("doc_id = 3").count() == 1
    assert tokenfile.token_files(empty, queries.vocabulary("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("limit", [1 << 20, 1])
def test_exact_dedup(docs, empty, limit):
    groups = defaultdict(list)
    for k, t in DOCS.items():
        groups[re.sub("[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), k))
    want = {
        (k, min(g)[1], len(g), min(g)[1] == k, hashlib.sha256(n.encode()).hexdigest()) for n, g in groups.items() for _, k in g
    }
    assert {tuple(r) for r in exactdedup.exact_groups(docs, limit).collect()} == want
    assert exactdedup.exact_groups(empty).count() == 0


@pytest.mark.parametrize("rows,partitions,segment_rows", [(3000, 3, 1 << 22), (3000, 1, 500), (3000, 60, 1000), (10, 10, 1)])
def test_slot_filters_count_and_merge_without_loss(rows, partitions, segment_rows):
    rng = np.random.default_rng(rows + partitions)
    shape = slotfilter.geometry(rows, partitions, segment_rows)
    want, filters = defaultdict(int), defaultdict(list)
    for part in range(3):
        # Full and skewed slots: dense stretches, both ends of the space, copies up to many digits.
        own = rng.integers(0, 2**64, 900, np.uint64)
        own[:200] = np.uint64(2**63) + rng.integers(0, 5000, 200, np.uint64)
        own[200:210] = np.uint64(2**64 - 1) - rng.integers(0, 3, 10, np.uint64)
        own[210:220] = rng.integers(0, 3, 10, np.uint64)
        prints, counts = np.unique(own, return_counts=True)
        counts = counts * rng.choice([1, 1, 1, 2, 300, 2**40], len(counts))
        segment = (prints // np.uint64(shape.width)).astype(np.int64) // shape.slots
        for s in np.unique(segment).tolist():
            f = slotfilter.SlotFilter.build(shape, s, prints[segment == s], counts[segment == s])
            filters[s].append(slotfilter.SlotFilter(shape, *f.row()))
        for p, c in zip(prints.tolist(), counts.tolist()):
            want[p] += c
    got = [(p, c) for s in sorted(filters) for ps, cs in slotfilter.merged(filters[s], 7) for p, c in zip(ps.tolist(), cs.tolist())]
    assert got == sorted(want.items())
    for f in filters[min(filters)]:
        some = [p for h, r, _ in f.windows() for p in ((h + f.segment * shape.slots).astype(np.uint64) * np.uint64(shape.width) + r).tolist()]
        assert all(f.count(p) for p in some[:20]) and f.count(some[0] ^ 1) == (1 if some[0] ^ 1 in some else 0) * f.count(some[0] ^ 1)


def test_slot_filters_take_less_than_eight_bytes_a_fingerprint():
    rng = np.random.default_rng(1)
    prints = np.unique(rng.integers(0, 2**64, 50_000, np.uint64))
    shape = slotfilter.geometry(len(prints) * 32, 32)
    f = slotfilter.SlotFilter.build(shape, 0, prints, np.ones(len(prints), np.int64))
    assert shape.segments == 1 and f.nbytes() < 8 * len(prints)


def linked(docs):
    sets = {}
    for k, t in docs.items():
        w = [x for x in re.split("[\x20\x09-\x0d]+", (t or "").translate(LOWER)) if x]
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {(k, len(sets[k]), root(k)) for k in sets}


@pytest.mark.parametrize("options", [{}, {"region_shingles": 500, "pivots": 2}])
def test_jaccard_join(spark, options):
    rng = random.Random(11)
    words = [f"w{k}" for k in range(300)]
    base = [[rng.choice(words) for _ in range(70)] for _ in range(3)]
    docs = dict(list(DOCS.items())[:30])
    for k in range(100, 190):
        text = list(rng.choice(base))
        for _ in range(rng.randint(0, 6)):
            text[rng.randrange(len(text))] = f"x{rng.randrange(40)}"
        docs[k] = " ".join(text)
    got = jaccard.near_duplicates(frame(spark, docs), **options).collect()
    assert {tuple(r) for r in got} == linked(docs)


def test_jaccard_edges(spark, empty):
    assert jaccard.near_duplicates(empty).count() == 0
    rows = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (2, "A  b")], "doc_id long, text string")
    got = sorted(map(tuple, jaccard.near_duplicates(rows).collect()), key=str)
    assert got == sorted([(1, 1, 1), (1, 1, 1), (None, 1, None), (2, 1, 1)], key=str)


def test_jaccard_repeated_rows(spark):
    rows = [(r, d, 9) for r, d in [(1, 1), (1, 2), (2, 3), (2, 4)]] * 2 + [(3, 5, 8), (3, 6, 9), (4, 5, 9), (4, 6, 8)]
    members = spark.createDataFrame(rows, "region long, doc_id long, n long")
    comps = members.select("doc_id", F.col("doc_id").alias("comp")).distinct()
    assert sorted({r.region for r in jaccard._open(members, comps).collect()}) == [1, 2, 3, 4]


def test_jaccard_null_text_of_linked_ids(spark):
    words = [f"w{k}" for k in range(60)]
    texts = {1: " ".join(words), 2: " ".join(words[:-1]), 3: " ".join(words[::-1])}
    rows = [*texts.items(), *texts.items(), (1, None), (2, None), (2, " "), (4, None)]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 3, 4: 4} and len(got) == len(rows)


def test_region_join_is_exact():
    rng = np.random.default_rng(4)
    base = [rng.integers(0, 2**62, 80).astype(np.uint64) for _ in range(3)]
    sets = []
    for _ in range(150):
        own = base[rng.integers(3)].copy()
        own[rng.integers(0, 80, rng.integers(0, 14))] = rng.integers(0, 2**62)
        sets.append(np.unique(own))
    region = jaccard.Region(sets, np.arange(len(sets)))
    region.join(np.arange(len(sets)))
    plain = jaccard.Region(sets, np.arange(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                plain.link(i, j)
    assert [region.root(k) for k in range(150)] == [plain.root(k) for k in range(150)]


def test_profiles_never_exclude_a_link():
    rng = np.random.default_rng(6)
    for _ in range(300):
        x = np.unique(rng.integers(0, 2**62, rng.integers(1, 400)).astype(np.uint64))
        y = np.unique(np.append(x[: -max(1, len(x) // 9)], rng.integers(0, 2**62, len(x) // 12).astype(np.uint64)))
        both = len(np.intersect1d(x, y))
        if len(y) and 100 * both >= 80 * (len(x) + len(y) - both):
            a, b = (np.frombuffer(jaccard.profile(s), np.uint8).astype(np.int64)[None] for s in (x, y))
            size = min(a.shape[1], b.shape[1])
            assert jaccard.may_link(jaccard.folded(a, size), len(x), jaccard.folded(b, size), len(y)).all()


def word_list(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def test_contamination(spark, docs, empty):
    items = {1: DOCS[12], 2: " ".join(word_list(DOCS[15])[5:30]), 10: "one one", 11: None, 12: "...", 13: "not there at all"}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    windows = defaultdict(set)
    for k, t in items.items():
        w = word_list(t)
        n = min(13, len(w))
        for i in range(len(w) - n + 1) if n else ():
            windows[tuple(w[i : i + n])].add(str(k))
    for r in contamination.find_contamination(docs, bench).collect():
        words = word_list(DOCS[r.row.doc_id])
        hit, found = set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                if named := windows.get(tuple(words[i : i + n])):
                    found |= named
                    hit |= set(range(i, i + n))
        assert (r.found.n_words, r.found.n_hit, r.found["items"]) == (len(words), len(hit), sorted(found))
        assert {p for s in r.found.spans for p in range(s["first"], s["last"] + 1)} == hit
    assert contamination.find_contamination(docs, bench.limit(0)).agg(F.max("found.n_hit")).first()[0] == 0
    assert contamination.find_contamination(empty, bench).count() == 0


def test_fm_index():
    rng = np.random.default_rng(8)
    text = np.append(rng.integers(1, 4, 400), 0)
    index = contamination.FMIndex(text, 3, rate=5)
    plain = sorted(range(len(text)), key=lambda i: text[i:].tolist())
    assert contamination.suffix_array(text, 3).tolist() == plain
    patterns = rng.integers(1, 4, (40, 4))
    which, low, high = index.search(patterns)
    found = {int(w): sorted(index.locate(np.arange(a, b)).tolist()) for w, a, b in zip(which, low, high)}
    for k, p in enumerate(patterns.tolist()):
        want = [i for i in range(len(text) - 3) if text[i : i + 4].tolist() == p]
        assert found.get(k, []) == want


def test_quality(spark, docs, empty):
    rng = random.Random(9)
    good = lambda: " ".join(rng.choice(["and", "the", "onea", "stion"]) for _ in range(30))
    bad = lambda: " ".join(rng.choice(["AND!!", "the###", "onea|"]) for _ in range(30))
    rows = [(k, good() if k % 2 else bad(), k % 2) for k in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.fit(table.select("doc_id", "text"), table.select("doc_id", "quality"))
    scored = {r.row.doc_id: r.score for r in quality.classify(table.drop("quality"), model).collect()}
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert sum((scored[k] >= 0.3) == bool(k % 2) for k in held) >= 0.95 * len(held)
    kept = quality.classify(docs, model).select("row.*")
    assert kept.columns == docs.columns and kept.count() == len(DOCS)
    assert quality.classify(empty, model).count() == 0
    assert quality.classify(docs, quality.fit(docs, table.select("doc_id", "quality").limit(0))).agg(F.max("score")).first()[0] == 0.5


def test_url_filter(spark):
    urls = [None, "", "nohost", "http://A.example.NET/en/x?q", "http://example.net", "ftp://example.com/de/1", "x://notnet/", "http://a.org/fr/#t"]
    urls += [f"http://shop{k}.net/buy{k}" for k in range(40)] + [f"http://lib{k}.org/fr/lire{k}" for k in range(40)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("score", F.lit("x"))
    got = {r.page_id: r for r in urlmodel.judge(pages).collect()}
    assert [(got[k].host, got[k].path, got[k].rule) for k in range(8)] == [
        ("", "", None), ("", "", None), ("", "", None), ("a.example.net", "/en/x", "example.net/en/"),
        ("example.net", "", None), ("example.com", "/de/1", "example.com/de/"), ("notnet", "/", None), ("a.org", "/fr/", "org/fr/"),
    ]
    assert got[3].verdict == "allow" and got[5].verdict == "block" and all(r.verdict in ("allow", "block") for r in got.values())
    known = [r for r in got.values() if r.rule]
    assert sum((r.score >= r.cut) == (r.verdict == "allow") for r in known) >= 0.9 * len(known)
    assert urlmodel.judge(pages.limit(0)).count() == 0


def plain_url_scores(rows, order):
    """Mean log-ratios of (text, accepted) rows by a plain model; texts with a label of None are only scored."""
    counts = {True: defaultdict(int), False: defaultdict(int)}
    spelled = [b"\x02" * order + t.encode() + b"\x03" for t, _ in rows]
    for text, (_, label) in zip(spelled, rows):
        for i in range(order, len(text)) if label is not None else ():
            for k in range(order + 1):
                counts[label][text[i - k : i + 1]] += 1
                counts[label][text[i - k : i], k] += 1

    def chance(label, text, i):
        p = 1 / 257
        for k in range(order + 1):
            p = (counts[label][text[i - k : i + 1]] + 4 * p) / (counts[label][text[i - k : i], k] + 4)
        return p

    out = []
    for text in spelled:
        at = range(order, len(text))
        out.append(sum(np.log(chance(True, text, i) / chance(False, text, i)) for i in at) / len(at))
    return out


@pytest.mark.parametrize("order", [0, 2, 5])
def test_url_scores_are_those_of_a_plain_model(spark, order):
    rng = random.Random(order)
    texts = ["".join(rng.choice("abé/?=1") for _ in range(rng.randint(0, 14))) for _ in range(80)] + ["", "aaaa", "aaaa"]
    rows = [(t, rng.choice([True, False, None])) for t in texts]
    table = spark.createDataFrame([(k, t, a) for k, (t, a) in enumerate(rows)], "row_no long, text string, accepted boolean")
    got = {r.row_no: r.score for r in urlmodel.scores(table, order).collect()}
    assert np.allclose([got[k] for k in range(len(rows))], plain_url_scores(rows, order))


def test_url_model_is_not_sent_through_the_driver(spark):
    rows = [(i, f"a.example.org/{i}", i % 2 == 0) for i in range(40)]
    table = spark.createDataFrame(rows, "row_no long, text string, accepted boolean")
    grams = table.select("accepted", F.explode(urlmodel.grams(F.col("text"))).alias("gram"))
    counts = grams.groupBy("gram").agg(F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("r"))
    for found, n in ((urlmodel.log_ratios(counts), counts.count()), (urlmodel.scores(table), len(rows))):
        assert len(found.collect()) == n
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_urls_differ_by_long_contexts_digits_and_queries(spark):
    good = [f"http://a{k}.org/fr/x?id={k % 7}&kind=good77" for k in range(60)]
    bad = [f"http://a{k}.net/fr/x?id={k % 7}&kind=good78" for k in range(60)]
    asked = ["http://b.info/fr/x?id=3&kind=good77", "http://b.info/fr/x?id=3&kind=good78"]
    pages = spark.createDataFrame(list(enumerate(good + bad + asked)), "page_id long, url string")
    rules = (urlmodel.Rule("allow", "org"), urlmodel.Rule("block", "net"))
    got = {r.page_id: r for r in urlmodel.judge(pages, rules).collect()}
    assert got[120].score > got[121].score
    assert got[120].rule is None and got[120].verdict == ("allow" if got[120].score >= got[120].cut else "block")


def test_licences(spark, docs, empty):
    got = {r.doc_id: r for r in licences.recognise(docs).collect()}
    last = max(DOCS)
    assert got[last].licences == ["CC-BY-NC-4.0", "MIT"] and got[last].n_matches == 2 and got[last].n_sentences == 3
    assert got[0].licences == [] and got[0].n_sentences == 0
    text = "# Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    text += 'documentation files (the "Software"), to deal in the Software without restriction.\nX y.\n'
    text += 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED.'
    one = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert licences.recognise(one).first().n_matches == 0
    assert licences.recognise(one, gap=1).first().licences == ["MIT"]
    assert licences.recognise(empty).count() == 0


MIT_TEXT = """MIT License

Copyright (c) 2020 A. N. Other

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM.
"""
GPL_TEXT = """
This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
APACHE_TEXT = """
Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
"""
BSD_TEXT = """
Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
"""


def test_verbatim_licences(spark):
    texts = {"MIT": MIT_TEXT, "GPL-3.0-or-later": GPL_TEXT, "Apache-2.0": APACHE_TEXT, "BSD": BSD_TEXT}
    forms = [lambda t: t, lambda t: t.replace("\n", "\r\n"), lambda t: re.sub("(?m)^", "# ", t), lambda t: re.sub("(?m)^", " * ", t),
             lambda t: re.sub("(?<=[^\n])\n(?=[^\n])", " ", t)]
    rows = [(100 * k + f, form("Some words first.\n" + t)) for k, t in enumerate(texts.values()) for f, form in enumerate(forms)]
    got = {r.doc_id: r for r in licences.recognise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, name in enumerate(texts):
        assert [got[100 * k + f].licences for f in range(len(forms))] == [[name]] * len(forms)
    # A known sentence inside another is not found again; a blank line ends one.
    edges = [(1, "This work is\nlicensed under the GNU General Public License, version 3."), (2, "Released under\n\nthe MIT License."),
             (3, "Permission is hereby granted, x. Released under\nthe MIT License")]
    got = {r.doc_id: r for r in licences.recognise(spark.createDataFrame(edges, "doc_id long, text string")).collect()}
    assert [(got[k].n_sentences, got[k].n_matches) for k in (1, 2, 3)] == [(2, 1), (2, 0), (3, 1)]
    assert [tuple(x) for x in got[3].found] == [(2, "mit-notice")]
    assert all(licences.unbroken(w) for ws in licences.SENTENCES.values() for w in ws)


def test_padded_licences(spark):
    rows = [(1, "Released under" + " \t" * 3000 + "the MIT License."), (2, "#" * 5000 + " Licensed under CC BY-NC 4.0."), (3, "*" * 5000 + " x")]
    got = {r.doc_id: r.licences for r in licences.recognise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ["MIT"], 2: ["CC-BY-NC-4.0"], 3: []}


def test_warc_archives(spark, tmp_path):
    rows = [(1, "http://a/ b", "same"), (2, "u", "same"), (3, None, None), (4, "u", ""), (5, "u", "é\r\n\r\nx"), (None, "u", "same"), (2, "u", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    folder = warczip.archive_pages(pages, str(tmp_path / "w"))
    got = {r.record_id: r for r in warczip.read(spark, folder).collect()}
    assert got["1"].record_type == "revisit" and got["1"].refers_to == "2" and got["1"].payload_bytes == 4
    assert got["2"].record_type == "response" and bytes(got["2"].payload) == b"same" and got["3"].refers_to == "4"
    assert bytes(got["5"].payload) == "é\r\n\r\nx".encode()
    assert got["1"].payload_digest == base64.b32encode(hashlib.sha1(b"same").digest()).decode()
    for path in Path(folder).glob("part-*"):
        with zipfile.ZipFile(path) as z:
            assert z.testzip() is None
    assert warczip.read(spark, warczip.archive_pages(pages.limit(0), str(tmp_path / "e"))).count() == 0


def test_zip64_and_missing_index():
    raw = warczip.record("1", "u", b"abc", None) + warczip.record("2", "u", b"abc", "1")
    plain = io.BytesIO()
    with zipfile.ZipFile(plain, "w") as z:
        z.writestr("packed", "x" * 100, zipfile.ZIP_DEFLATED)
        with z.open(warczip.RECORDS, "w", force_zip64=True) as f:
            f.write(raw)
    ranges = warczip.Ranges("", plain.getvalue())
    members = warczip.directory(ranges)
    assert set(members) == {warczip.RECORDS}
    got = [warczip.parse(ranges.read(*p)) for p in warczip.places(ranges, members)]
    assert [r["record_type"] for r in got] == ["response", "revisit"]
    # The same directory, named by ZIP64 end records.
    data = plain.getvalue()
    at = data.rfind(b"PK\x05\x06")
    count, size, start = struct.unpack_from("<H2L", data, at + 10)
    wide = struct.pack("<4sQ2H2L4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, count, count, size, start)
    wide += struct.pack("<4sLQL", b"PK\x06\x07", 0, at, 1)
    wide += struct.pack("<4s4H2LH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    assert warczip.directory(warczip.Ranges("", data[:at] + wide)) == members
    with pytest.raises(warczip.Broken):
        warczip.directory(warczip.Ranges("", b"no archive"))


def test_pipeline(spark):
    small = "/root/testdata/sf0.001"
    if not Path(small).exists():
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = corpus_pipeline.quality_stage(spark, docs, small)
    assert kept.columns == docs.columns
    rows = {r.doc_id: r.text for r in kept.collect()}
    groups = defaultdict(list)
    for k, t in rows.items():
        groups[re.sub("[\x20\x09-\x0d]", "", t)].append((-len(t), k))
    rows = {min(g)[1]: rows[min(g)[1]] for g in groups.values()}
    rows = {k: rows[k] for k, _, first in linked(rows) if k == first}
    bench = [word_list(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 13]) for w in bench for i in range(len(w) - 12)}
    want = set()
    for k, t in rows.items():
        words = word_list(t)
        hit = {p for i in range(len(words) - 12) if tuple(words[i : i + 13]) in windows for p in range(i, i + 13)}
        if not (hit and 20 * len(hit) >= len(words)):
            want.add(k)
    got = corpus_pipeline.run(spark, small).collect()
    assert {r.doc_id for r in got} == want and [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "benchmark", "packing"]


def test_exact_stage_by_row(spark):
    rows = [(5, "a b", "x"), (5, "a b", "y"), (3, "c d", "x"), (5, "cd", "x"), (5, "alone", "x"), (None, "e\x0bf", "x"), (None, "e f", "x"),
            (7, "g", "x"), (7, "g", "x"), (8, "h i", "x"), (8, "h  i", "x"), (2, "h i", "x"), (9, None, "x"), (10, " ", "x"), (11, "é", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = corpus_pipeline.exact_stage(spark, docs, "")
    want = [(5, "a b", "x"), (3, "c d", "x"), (5, "alone", "x"), (None, "e\x0bf", "x"), (7, "g", "x"), (8, "h  i", "x"), (10, " ", "x"), (11, "é", "x")]
    assert got.columns == docs.columns and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("path", [*sorted((ROOT / "tallywork" / "llm").glob("*.py")), ROOT / "corpus_pipeline.py"], ids=lambda p: p.name)
def test_no_unbounded_steps(path):
    text = path.read_text()
    assert not re.search(r"crossJoin|localCheckpoint|F\.udf|toPandas|\.rdd\b", text)
    assert path.name != "urlmodel.py" or not re.search(r"pandas|pyarrow|mapIn|applyIn", text)
    assert isinstance(T.LongType(), T.DataType)
