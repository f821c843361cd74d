"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct words and the first 3 to 7 letters of each, which stand for a stem in
all its forms; they are hashed into ``2**BITS`` buckets. From the labelled training rows
a bounded sample (at most ``SAMPLE`` labels, those with the smallest hash of doc_id, and as many rows, those with the
smallest hash of doc_id and text; every row below the bounds is used) is taken to fit the model, and stored. Spark counts in how many of its rows, and of those with label 1, each
bucket is. Two kinds of buckets are kept: ``KEPT`` whose presence alone says most about the label, and
``COMMON`` others of the rest whose presence differs most between rows, whatever they say alone, as a pair of
them may say what neither does. Only kept buckets of the sample reach the driver. There the machine
``w0 + sum(w_i x_i) + sum(<v_i, v_j> x_i x_j)`` over their presence is trained by Adam on the
logistic loss. Pairs, such as an insult with a group, so weigh more or less than their terms alone.
Every document is then scored over its whole text.

Null and empty texts have no terms and get the score of the bias. Without training rows of both
labels every score is the share of label 1, or 0.5 with none. Null labels don't count. Repeated rows
are scored once each, and of rows equal in doc_id, text and label one is learnt from; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stored, only, ship, tidy

BITS = 20
#: Most labelled rows that the model is fitted on.
SAMPLE = 16_000
#: Buckets with a weight and a vector: those that tell the label best alone, and the most variable others.
KEPT, COMMON = 4096, 512
#: How strongly the vectors of the latter are held back.
COMMON_DECAY = 1e-3
FACTORS = 8
EPOCHS = 30
BATCH = 512
#: Distinct words whose bucket a Python worker remembers.
CACHE = 400_000
#: Letters of a word's beginnings that are terms of their own.
STEMS = range(3, 8)

_BREAK = bytes(c if c >= 0x80 or chr(c).isalnum() or c == 0x27 else 0x20 for c in range(256))


def terms(text: str | None) -> set[bytes]:
    """Distinct words in lower case; all but letters, digits and apostrophes stands between words."""
    return set((text or "").lower().encode("utf-8", "surrogatepass").translate(_BREAK).split())


def buckets(word: bytes) -> list[int]:
    """Where a word and its beginnings fall."""
    found = [zlib.crc32(word) & ((1 << BITS) - 1)]
    text = word.decode("utf-8", "surrogatepass")
    return found + [zlib.crc32(text[:n].encode("utf-8", "surrogatepass"), 1) & ((1 << BITS) - 1) for n in STEMS if n <= len(text)]


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*rows, np.zeros(0, np.int32)]).astype(np.int32)))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket of a task's rows: in how many it is, and in how many with label 1."""
    seen, toxic = np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int32)
    for b in batches:
        for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            own = list({k for w in terms(t) for k in buckets(w)})
            seen[own] += 1
            toxic[own] += y
    some = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(seen[some].astype(np.int64)), pa.array(toxic[some].astype(np.int64))], names=["k", "seen", "toxic"])


def _kept(columns: np.ndarray):
    """Which of the kept buckets each row has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {int(c): i for i, c in enumerate(columns)}
        for b in batches:
            x = [np.array(sorted({place[k] for w in terms(t) for k in buckets(w) if k in place}), np.int32) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([_lists(x), b.column(1)], names=["x", "y"])

    return run


@dataclass
class Machine:
    """``columns`` are the kept buckets in ascending order."""

    columns: np.ndarray
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def odds(self, flat: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """Log odds of n rows; ``flat`` holds the column numbers and ``row`` whose they are."""
        linear = np.bincount(row, self.weight[flat], n)
        sums, squares = np.zeros((n, self.factor.shape[1])), np.zeros(n)
        for f in range(self.factor.shape[1]):
            v = self.factor[flat, f]
            sums[:, f] = np.bincount(row, v, n)
            squares += np.bincount(row, v * v, n)
        return self.bias + linear + 0.5 * ((sums**2).sum(axis=1) - squares)


def _flatten(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = [len(r) for r in rows]
    return np.concatenate(rows) if rows else np.zeros(0, int), np.repeat(np.arange(len(rows)), sizes)


def choose(seen: np.ndarray, toxic: np.ndarray, n: int, n1: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the buckets to keep: those whose presence says most, then those whose presence varies most.

    ``n`` rows, ``n1`` of them with label 1; buckets in fewer than 4 rows say too little.
    """
    n0 = n - n1
    # Log-likelihood ratio of presence and label.
    p1, p0, p = (toxic + 0.5) / (n1 + 1), (seen - toxic + 0.5) / (n0 + 1), (seen + 0.5) / (n + 1)
    kl = lambda a, b: a * np.log(a / b) + (1 - a) * np.log(np.maximum(1 - a, 1e-12) / np.maximum(1 - b, 1e-12))
    gain = np.where(seen >= 4, n1 * kl(p1, p) + n0 * kl(p0, p), 0)
    telling = np.argsort(-gain, kind="stable")[:KEPT]
    telling = telling[gain[telling] > 3]
    varied = np.where(seen >= 4, seen * (n - seen), 0).astype(float)
    varied[telling] = 0
    common = np.argsort(-varied, kind="stable")[:COMMON]
    return np.sort(telling), np.sort(common[varied[common] > 0])


def fit(columns: np.ndarray, common: np.ndarray, rows: list[np.ndarray], y: np.ndarray, seed: int = 7) -> Machine:
    """Trains on rows of distinct places in ``columns``, the kept buckets. Those marked in ``common`` say nothing alone:
    they have no weight of their own, and their vectors have to earn more."""
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or not 0 < share < 1:
        bias = 0.0 if not len(y) else float(np.log(max(share, 1e-4) / max(1 - share, 1e-4)))
        return Machine(np.zeros(0, int), bias, np.zeros(0), np.zeros((0, FACTORS)))
    own, ends = np.concatenate(rows), np.cumsum([0, *map(len, rows)])

    random = np.random.default_rng(seed)
    m = Machine(columns, float(np.log(share / (1 - share))), np.zeros(len(columns)), random.normal(0, 0.02, (len(columns), FACTORS)))
    state = [np.zeros_like(m.weight), np.zeros_like(m.weight), np.zeros_like(m.factor), np.zeros_like(m.factor), 0.0, 0.0]
    step, rate, decay = 0, 0.03, 1e-4
    pairs_decay = np.where(common, COMMON_DECAY, decay)[:, None]
    for epoch in range(EPOCHS):
        order = random.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            cols = np.concatenate([own[ends[i] : ends[i + 1]] for i in batch])
            whose = np.repeat(np.arange(len(batch)), ends[batch + 1] - ends[batch])
            sums = np.stack([np.bincount(whose, m.factor[cols, f], len(batch)) for f in range(FACTORS)], axis=1)
            odds = m.odds(cols, whose, len(batch))
            error = (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - y[batch]) / len(batch)
            e = error[whose]
            gw = np.where(common, 0, np.bincount(cols, e, len(columns)) + decay * m.weight)
            gv = np.stack([np.bincount(cols, e * (sums[whose, f] - m.factor[cols, f]), len(columns)) for f in range(FACTORS)], axis=1) + pairs_decay * m.factor
            gb = float(error.sum())
            step += 1
            for k, g in ((0, gw), (2, gv), (4, gb)):
                state[k] = 0.9 * state[k] + 0.1 * g
                state[k + 1] = 0.999 * state[k + 1] + 0.001 * g * g
            lr = rate * (1 - epoch / EPOCHS) + 1e-4
            up = [(state[k] / (1 - 0.9**step)) / (np.sqrt(state[k + 1] / (1 - 0.999**step)) + 1e-8) for k in (0, 2, 4)]
            m.weight -= lr * up[0]
            m.factor -= lr * 0.3 * up[1]
            m.bias -= lr * float(up[2])
    return m


def _score(m: Machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {int(c): i for i, c in enumerate(m.columns)}
        known: dict[bytes, tuple[int, ...]] = {}
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                words = terms(t)
                new = words.difference(known)
                if len(known) + len(new) > CACHE:
                    known = {}
                    new = words
                for w in new:
                    known[w] = tuple(place[k] for k in buckets(w) if k in place)
                rows.append(np.array(sorted({k for own in map(known.__getitem__, words) if own for k in own}), int))
            flat, row = _flatten(rows)
            odds = m.odds(flat, row, len(rows)) if len(m.columns) else np.full(len(rows), m.bias)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(1 / (1 + np.exp(-np.clip(odds, -500, 500))))], names=["doc_id", "score"])

    return run


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: Column | None = None, sample: int = SAMPLE) -> Machine:
    known = only(labels, "doc_id", label).where(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("y"))
    if rows is not None:
        known = known.where(rows)
    if known.count() > sample:
        # The smallest hashes: the same rows each time, at any size and layout of the table.
        known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    # The labels are bounded by their number, so they may be sent to the tasks that read the texts, once. Rows of any
    # number may share a doc_id: of equal ones one is learnt from, and of all again those with the smallest hashes.
    store = Stored(docs.sparkSession, "toxicity")
    found = only(docs, "doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "y", F.xxhash64("doc_id", "text").alias("h"))
    own = store.keep(found.dropDuplicates(["h", "y"]), "sample")
    if own.count() > sample:
        least = own.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
        own = own.where(F.col("h") <= least)  # a text with both labels may be one too many
    own = own.select("text", "y")
    # At most a row for each bucket, however many texts there are.
    counts = own.mapInArrow(tidy(_counts), "k int, seen long, toxic long").groupBy("k").agg(F.sum("seen").alias("seen"), F.sum("toxic").alias("toxic")).where("seen >= 4").toPandas().sort_values("k")
    by_label = dict(own.groupBy("y").count().collect())
    n, n1 = sum(by_label.values()), by_label.get(1, 0)
    if 0 < n1 < n:
        telling, others = (counts["k"].to_numpy()[c] for c in choose(counts["seen"].to_numpy(), counts["toxic"].to_numpy(), n, n1))
    else:
        telling = others = np.zeros(0, int)
    columns = np.sort(np.concatenate((telling, others)))
    found = own.mapInArrow(tidy(_kept(columns)), "x array<int>, y int").toArrow()
    lists = found.column("x").combine_chunks()
    flat, ends = lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))).astype(int)
    y = found.column("y").to_numpy().astype(float)
    # The same order whichever task was first.
    order = sorted(range(len(y)), key=lambda i: (zlib.crc32(flat[ends[i] : ends[i + 1]].tobytes()), ends[i + 1] - ends[i], y[i]))
    return fit(columns, np.isin(columns, others), [flat[ends[i] : ends[i + 1]] for i in order], y[order] if order else y)


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: Column | None = None) -> DataFrame:
    """doc_id and score of every document, by a machine of the labelled rows for which ``rows`` holds."""
    ship(docs.sparkSession)
    m = train(docs, labels, label, rows)
    return only(docs, "doc_id", "text").mapInArrow(tidy(_score(m)), "doc_id long, score double")
