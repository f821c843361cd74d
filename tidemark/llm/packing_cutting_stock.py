"""Packing by cutting-stock column generation.

Every document becomes its token ids and an end id. Whole sequences are cut off its front; the rest
is shorter than a sequence. A histogram of the rests over length classes (at most ``CLASSES``
numbers, whatever the corpus) is the demand of a cutting-stock problem. Its linear program is solved
over *patterns* (how many rests of each class share a sequence): a knapsack dynamic program prices
new patterns with the dual values until none improves the program. The patterns are used as often
as the program says, rounded down; what rounding leaves over is placed by best fit, which adds at
most one sequence for each basic pattern or so. Documents are then ranked within their class, and
rank decides pattern, sequence and slot, so no document but its rank and length is ever compared.

Only counts reach the driver. Ranks come from counts per task and class, so a class that holds a
third of all rests is ranked in parallel.

Nulls and empty texts are documents of the end id alone. An empty table gives an empty table.
Repeated rows are packed once each. Extra columns are ignored. Very long texts give many whole
sequences and one rest. Rests of one class are ranked by task and then in the order that the task read them,
so ties are settled by place; within a sequence the longest piece comes first, then the smaller doc_id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, only, ship, tidy
from .wordcache import forget, word_cache

#: Length classes of rests; a class is as wide as sequence_length / CLASSES tokens.
CLASSES = 256
END_ID = 1

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, kind int, part int, place long"


def _pieces(path: str, size: int, width: int, remember: bool):
    """Tokenises and cuts. ``kind`` is the class (CLASSES + 1: a whole sequence), ``place`` the rank
    within this task and class, ``part`` the task's number; a task that runs again gives the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, cache = TaskContext.get().partitionId(), word_cache(path)
        rank = np.zeros(CLASSES + 2, np.int64)
        for b in batches:
            ids, ends = cache.encode_ended(b.column(1), END_ID)
            total = np.diff(ends)
            many = -(-total // size)
            if not len(many):
                continue
            doc = np.repeat(np.arange(len(total)), many)
            start = size * (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many))
            n = np.minimum(size, total[doc] - start)
            kind = np.where(n == size, CLASSES + 1, -(-n // width))
            # The rank of each piece among those of its kind.
            order = np.argsort(kind, kind="stable")
            counts = np.bincount(kind, minlength=len(rank))
            place = np.zeros(len(kind), np.int64)
            place[order] = np.arange(len(kind)) - np.repeat(np.cumsum(counts) - counts, counts)
            place += rank[kind]
            rank += counts
            raw, at = memoryview(ids.astype("<u4").view(np.uint8)), 4 * (ends[doc] + start)
            crc = np.fromiter((zlib.crc32(raw[x:y]) for x, y in zip(at.tolist(), (at + 4 * n).tolist(), strict=True)), np.int64, len(doc))
            own = [b.column(0).take(pa.array(doc)), *map(pa.array, (start, n, crc, total[doc], kind.astype(np.int32), np.full(len(doc), part, np.int32), place))]
            yield pa.RecordBatch.from_arrays(own, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "kind", "part", "place"])
        if not remember:
            forget(path)

    return run


def price(value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the pattern of classes 1..capacity with the largest sum of values."""
    best = np.zeros(capacity + 1)
    took = np.zeros(capacity + 1, int)
    sizes = np.arange(1, capacity + 1)
    for room in range(1, capacity + 1):
        gain = best[room - sizes[:room]] + value[:room]
        k = int(gain.argmax())
        best[room], took[room] = (gain[k], k + 1) if gain[k] > best[room - 1] + 1e-12 else (best[room - 1], 0)
    pattern, room = np.zeros(capacity, int), capacity
    while room > 0:
        if took[room]:
            pattern[took[room] - 1] += 1
            room -= took[room]
        else:
            room -= 1
    return float(best[capacity]), pattern


def solve(demand: np.ndarray, rounds: int = 20_000, tolerance: float = 1e-3) -> list[tuple[np.ndarray, float]]:
    """The linear program by column generation: patterns and how often each is used.

    Starts from one pattern for each class and pivots on the inverse of the basis. Stops when the
    best price is at most 1 + ``tolerance``, which puts the program within that share of its optimum;
    an early stop (``rounds``) is still a feasible packing.
    """
    capacity = len(demand)
    asked = np.flatnonzero(demand > 0)
    if not len(asked):
        return []
    m = len(asked)
    basis = [np.zeros(capacity, int) for _ in range(m)]
    inverse = np.zeros((m, m))
    for i, c in enumerate(asked):
        basis[i][c] = capacity // (c + 1)
        inverse[i, i] = 1 / basis[i][c]
    amount = inverse @ demand[asked]
    for _ in range(rounds):
        value = np.full(capacity, -1.0)
        value[asked] = np.maximum(inverse.sum(axis=0), 0)
        worth, pattern = price(value, capacity)
        if worth <= 1 + tolerance:
            break
        column = inverse @ pattern[asked]
        can = column > 1e-9
        if not can.any():
            break
        ratio = np.where(can, np.maximum(amount, 0) / np.where(can, column, 1), np.inf)
        out = int(ratio.argmin())
        inverse[out] /= column[out]
        amount[out] = ratio[out]
        others = np.arange(m) != out
        inverse[others] -= np.outer(column[others], inverse[out])
        amount[others] -= column[others] * ratio[out]
        basis[out] = pattern
    return [(p, float(x)) for p, x in zip(basis, amount, strict=True) if x > 1e-9]


def plan(demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Whole numbers of each pattern that hold the demand exactly: the program's amounts rounded
    down and cut to what is asked, and best fit, longest first, for the rest."""
    left = demand.astype(int).copy()
    used: list[tuple[np.ndarray, int]] = []
    for pattern, amount in sorted(solve(demand.astype(float)), key=lambda x: -x[1]):
        has = pattern > 0
        times = min(int(amount + 1e-6), int((left[has] // pattern[has]).min()))
        if times > 0:
            used.append((pattern, times))
            left -= times * pattern
    open_room: dict[int, list[np.ndarray]] = {}
    for c in range(capacity, 0, -1):
        for _ in range(int(left[c - 1])):
            fit = next((r for r in range(c, capacity + 1) if open_room.get(r)), None)
            pattern = open_room[fit].pop() if fit else np.zeros(capacity, int)
            pattern[c - 1] += 1
            open_room.setdefault((fit or capacity) - c, []).append(pattern)
    used += [(p, 1) for ps in open_room.values() for p in ps]
    return used


def slots(used: list[tuple[np.ndarray, int]]) -> list[tuple[int, int, int, int, int]]:
    """For each class, ranges of ranks: (class, first rank, first sequence, a sequence's share, end)."""
    rank: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, times in used:
        for c in np.flatnonzero(pattern):
            kind, share = int(c) + 1, int(pattern[c])
            first = rank.get(kind, 0)
            out.append((kind, first, sequence, share, first + share * times))
            rank[kind] = first + share * times
        sequence += times
    return out


def pack(docs: DataFrame, tokenizer_path: str, sequence_length: int = 2048, remember: bool = True) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A worker remembers the words that it has met for its next task, some 100 MB at most, unless told otherwise: where
    other stages share its machine.
    """
    spark = docs.sparkSession
    ship(spark)
    width = -(-sequence_length // CLASSES)
    capacity = sequence_length // width
    store = Stored(spark, "cutting-stock")
    pieces = store.keep(only(docs, "doc_id", "text").mapInArrow(tidy(_pieces(tokenizer_path, sequence_length, width, remember)), PIECES), "pieces")

    # Counts per task and class turn the rank within a task into the rank within the class.
    counts = pieces.groupBy("part", "kind").agg((F.max("place") + 1).alias("n"))
    demand, whole = np.zeros(capacity, int), 0
    for kind, n in counts.groupBy("kind").agg(F.sum("n")).collect():
        if kind > CLASSES:
            whole = n
        else:
            demand[kind - 1] = n
    used = plan(demand, capacity)
    ranges = [(k, a, b + whole, s, e) for k, a, b, s, e in slots(used)] + [(CLASSES + 1, 0, 0, 1, whole)]
    # At most a pattern for each class and as many again after rounding, with some classes each.
    table = spark.createDataFrame(ranges, "kind int, first long, sequence long, share long, last long")

    from pyspark.sql import Window

    before = Window.partitionBy("kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", "kind", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(starts, ["part", "kind"]).withColumn("rank", F.col("base") + F.col("place"))
    placed = (
        ranked.join(F.broadcast(table), "kind")
        .where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
        .withColumn("sequence_id", F.col("sequence") + F.floor((F.col("rank") - F.col("first")) / F.col("share")).cast("long"))
    )
    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "part", "place").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
        F.coalesce(F.sum("length").over(order), F.lit(0)).cast("long").alias("offset"),
    )
