"""A supervised quality classifier on subword embeddings.

A word's vector is the sum of hashed vectors of the word and of its character n-grams; a
document is the average over all its words, a softmax gives the classes. Vectors are learned
by stochastic gradient descent in numpy on a bounded sample of labelled documents.
Scoring needs one number a feature, and an unseen word is computed once a block of text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywork.llm.text import SPACE, blocks, flat, released, with_result, words

# Documented bounds of the training sample; nothing else is sampled.
SAMPLE_DOCS = 3000
BUCKETS = 1 << 18
DIMENSION = 16
EPOCHS = 6
RATE = 0.25
GRAMS = (1, 2, 3)
THRESHOLD = 0.3

SCORED_BYTES = 1 << 20  # text scored at once; bounds a worker's arrays

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
REPEAT = 0  # the feature of a word that equals the one before it


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def features(vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bucket ids, ends per word)``: of each word, itself and the n-grams of ``<word>`` in bytes."""
    data, at, _ = flat(vocabulary)
    n = len(at) - 1
    if not n:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    lengths = np.diff(at)
    ends = np.cumsum(lengths + 2)
    starts = ends - lengths - 2
    text = np.full(int(ends[-1]), ord("<"), np.uint64)
    text[ends - 1] = ord(">")
    inner = np.ones(len(text), bool)
    inner[starts] = inner[ends - 1] = False
    text[inner] = data[at[0] : at[-1]]
    owner = np.repeat(np.arange(n), lengths + 2)
    found, owners = [], []
    rolled = np.zeros(len(text), np.uint64)
    for k in range(1, max(GRAMS) + 1):
        # rolled[i] hashes the k bytes from i on.
        longer = rolled * MULTIPLIER
        longer[: len(text) - k + 1] += text[k - 1 :] + np.uint64(1)
        rolled = longer
        if k in GRAMS:
            fits = np.arange(len(text)) + k <= ends[owner]
            found.append(_mix(rolled[fits] + np.uint64(k)))
            owners.append(owner[fits])
    powers = np.arange(len(text)) - starts[owner]
    term = _mix(text + (powers.astype(np.uint64) << np.uint64(9)))
    found.append(_mix(np.add.reduceat(term, starts) + np.uint64(77)))
    owners.append(np.arange(n))
    ids = (np.concatenate(found) % np.uint64(BUCKETS - 1)).astype(np.int64) + 1
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return ids[order], np.append(0, np.cumsum(np.bincount(owner, minlength=n)))


def repeats(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which words equal the one before them in the same text."""
    same = np.zeros(len(codes), bool)
    same[1:] = codes[1:] == codes[:-1]
    return same & ~first


def document_features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(feature ids, weights that add up to 1)`` of each text; of a text without words, nothing."""
    inside = ~SPACE
    data, offsets, buffer = flat(column)
    for i, j in blocks(offsets, SCORED_BYTES):
        ends, coded, first = words(data, buffer, inside, offsets[i : j + 1])
        codes = coded.indices.to_numpy(zero_copy_only=False)
        ids, at = features(coded.dictionary)
        again = repeats(codes, first)
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            own, counts = np.unique(codes[a:b], return_counts=True)
            sizes = at[own + 1] - at[own]
            place = np.repeat(at[own] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            weights = np.bincount(ids[place], np.repeat(counts, sizes)) if len(own) else np.zeros(0)
            named = np.flatnonzero(weights)
            weights = weights[named]
            if extra := int(again[a:b].sum()):
                # A repeated word weighs as much as a word's own features on average.
                named = np.append(named, REPEAT)
                weights = np.append(weights, extra * weights.sum() / max(1, b - a))
            total = weights.sum()
            yield named.astype(np.int32), (weights / total if total else weights).astype(np.float32)


@dataclass
class Model:
    """What scoring needs: the log-odds of each feature, and of a text without features."""

    odds: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        inside = ~SPACE
        data, offsets, buffer = flat(column)
        out = np.empty(len(column), np.float64)
        for i, j in blocks(offsets, SCORED_BYTES):
            ends, coded, first = words(data, buffer, inside, offsets[i : j + 1])
            codes = coded.indices.to_numpy(zero_copy_only=False)
            ids, at = features(coded.dictionary)
            total = np.append(0.0, np.cumsum(self.odds[ids].astype(np.float64)))
            odds, sizes = total[at[1:]] - total[at[:-1]], np.diff(at)
            again = np.append(0, np.cumsum(repeats(codes, first)))
            odds = np.append(0.0, np.cumsum(odds[codes]))
            sizes = np.append(0, np.cumsum(sizes[codes]))
            a, b = ends[:-1], ends[1:]
            n_words, weight = b - a, (sizes[b] - sizes[a]).astype(np.float64)
            extra = (again[b] - again[a]) * weight / np.maximum(1, n_words)
            summed = odds[b] - odds[a] + extra * float(self.odds[REPEAT])
            mean = summed / np.maximum(1.0, weight + extra)
            out[i:j] = 1 / (1 + np.exp(-np.clip(mean + self.bias, -40, 40)))
        return out


def train(texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> Model:
    """Stochastic gradient descent with one step a document and rates that shrink per feature."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSION, 1 / DIMENSION, (BUCKETS, DIMENSION)).astype(np.float32)
    output = np.zeros((2, DIMENSION), np.float32)
    bias = np.zeros(2, np.float32)
    seen = np.full(BUCKETS, 1e-8, np.float32)
    seen_out = np.float32(1e-8)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for k in rng.permutation(len(labels)):
            ids, weights = texts[k]
            hidden = weights @ vectors[ids] if len(ids) else np.zeros(DIMENSION, np.float32)
            logits = output @ hidden + bias
            odds = np.exp(logits - logits.max())
            error = odds / odds.sum()
            error[labels[k]] -= 1
            back = error @ output
            seen_out += np.float32((error**2).sum())
            step = np.float32(rate / np.sqrt(1 + seen_out / 10))
            output -= step * np.outer(error, hidden)
            bias -= step * error
            if len(ids):
                scale = weights * np.sqrt((back**2).mean())
                seen[ids] += scale**2
                vectors[ids] -= (rate * weights / np.sqrt(seen[ids]))[:, None] * back
    return Model((vectors @ (output[1] - output[0])).astype(np.float32), float(bias[1] - bias[0]))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, weights = [], []
        for own, weight in document_features(batch.column("text")):
            ids.append(own.tobytes())
            weights.append(weight.tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("quality"), pa.array(ids, pa.binary()), pa.array(weights, pa.binary())],
            ["quality", "ids", "weights"],
        )


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS) -> Model:
    """Learn from at most ``sample`` labelled documents that aren't held out, chosen by a hash of their id.

    Labels other than 0 and 1 and null ids are ignored; of an id labelled twice the smaller counts.
    Without usable rows every text scores one half.
    """
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").cast("int").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    joined = rows.join(F.broadcast(chosen), "id").select("id", "text", "quality")
    got = joined.select("quality", "text").mapInArrow(_gather, "quality int, ids binary, weights binary").toArrow()
    if not len(got):
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    rows = got.to_pylist()
    rows.sort(key=lambda r: (r["quality"], r["ids"], r["weights"]))
    texts = [(np.frombuffer(r["ids"], np.int32), np.frombuffer(r["weights"], np.float32)) for r in rows]
    return train(texts, np.array([r["quality"] for r in rows]))


def classify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``row`` (all columns of ``docs``) and ``score``, the probability of label 1, of every whole text.

    Narrow. A null text counts as empty, and scores what the class sizes say. Rows are scored one
    by one, so ties, repeated rows and null ids change nothing; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one number a bucket: 1 MB

    def score(text: pa.Array) -> pa.Array:
        scored = pa.array(shared.value.scores(text), pa.float64())
        released()
        return scored

    return with_result(docs, F.arrow_udf(score, T.DoubleType()), "score", text_col)
