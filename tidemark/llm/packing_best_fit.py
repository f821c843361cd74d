"""Token ids packed into matrices of fixed width by best-fit decreasing.

Each document becomes its ids and an end id; one longer than a sequence is split into pieces, none
lost. Pieces are gathered into windows of about ``WINDOW_TOKENS`` tokens within a task, sorted by
length, and each goes to the open sequence with the least room that still holds it. A segment tree
over room sizes finds that sequence in log2(sequence length) steps. A window is closed before the
next one starts, so memory is bounded and a lost executor repeats one task.

Output, one row a sequence: ``shard`` and ``row`` (task and number within it), ``ids`` (padded to the
sequence length), ``used`` (ids before the padding), ``cu_seqlens`` (cumulative segment lengths from
0), ``position_ids`` (counting from 0 again in every segment, 0 in padding), and ``doc_ids`` and
``starts``, which say where each segment comes from, so texts' ids can be put together again.

Of pieces of one length the earlier one goes first, and of sequences with the same room the last that came
to it is filled. Nulls and empty texts are documents of the end id alone; an empty table gives no rows;
repeated rows are packed once each; extra columns are ignored. A very long text is many pieces of one window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import only, ship, tidy
from .wordcache import spread, word_cache

END_ID = 1
PAD_ID = 0
WINDOW_TOKENS = 2_000_000
#: Sequences in one Arrow batch.
FLUSH_ROWS = 256

SCHEMA = "shard int, row long, used int, ids array<int>, cu_seqlens array<int>, position_ids array<int>, doc_ids array<long>, starts array<long>"


class RoomTree:
    """How many open sequences have each amount of room, as a segment tree."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, by: int) -> None:
        at = self.leaves + room
        while at:
            self.count[at] += by
            at >>= 1

    def least(self, need: int) -> int:
        """The smallest room of at least ``need`` that is open, or -1."""
        at = self.leaves + need
        if self.count[at]:
            return need
        while at > 1:
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return -1


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices into ``sizes``; longest first, each to the fullest bin that holds it."""
    tree = RoomTree(capacity)
    by_room: dict[int, list[int]] = {}
    bins: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        room = tree.least(sizes[i])
        if room < 0:
            k, room = len(bins), capacity
            bins.append([])
        else:
            k = by_room[room].pop()
            tree.add(room, -1)
        bins[k].append(i)
        left = room - sizes[i]
        if left:
            tree.add(left, 1)
            by_room.setdefault(left, []).append(k)
    return bins


def _lists(values: np.ndarray | pa.Array, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))


def _packer(path: str, size: int):
    def rows(part: int, first: int, bins: list[list[int]], docs: np.ndarray, starts: np.ndarray, begins: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        n = len(bins)
        order = np.array([i for own in bins for i in own], np.int64)
        many = np.fromiter(map(len, bins), np.int64, n)
        ends = np.append(0, np.cumsum(many))
        # Where segments end, in a run of all rows' ids and within their row; each row's cuts begin with 0.
        whole = np.append(0, np.cumsum(sizes[order]))
        used = np.diff(whole[ends])
        cuts = np.insert(whole[1:] - np.repeat(whole[ends[:-1]], many), ends[:-1], 0)
        position = spread(np.zeros(len(order), np.int64), sizes[order])
        at = spread(np.arange(n) * size, used)
        matrix, places = np.full(n * size, PAD_ID, np.int32), np.zeros(n * size, np.int32)
        matrix[at], places[at] = ids[spread(begins[order], sizes[order])], position
        full = np.arange(n + 1) * size
        columns = [
            pa.array(np.full(n, part, np.int32)), pa.array(np.arange(first, first + n)), pa.array(used.astype(np.int32)), _lists(matrix, full), _lists(cuts.astype(np.int32), ends + np.arange(n + 1)),
            _lists(places, full), _lists(docs.take(pa.array(order)), ends), _lists(starts[order], ends),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["shard", "row", "used", "ids", "cu_seqlens", "position_ids", "doc_ids", "starts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, cache = TaskContext.get().partitionId(), word_cache(path)
        waiting: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]] = []
        held = done = 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal waiting, held, done
            docs, (starts, sizes, ids) = pa.concat_arrays([w[0] for w in waiting]), (np.concatenate(x) for x in list(zip(*waiting, strict=True))[1:])
            bins, begins = best_fit(sizes.tolist(), size), np.cumsum(sizes) - sizes
            for at in range(0, len(bins), FLUSH_ROWS):
                yield rows(part, done, bins[at : at + FLUSH_ROWS], docs, starts, begins, sizes, ids)
                done += len(bins[at : at + FLUSH_ROWS])
            waiting, held = [], 0

        for b in batches:
            ids, ends = cache.encode_ended(b.column(1), END_ID)
            total = np.diff(ends)
            many = -(-total // size)
            doc = np.repeat(np.arange(len(total)), many)
            starts = size * spread(np.zeros(len(many), np.int64), many)
            waiting.append((b.column(0).take(pa.array(doc)), starts, np.minimum(size, total[doc] - starts), ids))
            held += len(ids)
            if held >= WINDOW_TOKENS:
                yield from close()
        if held:
            yield from close()

    return run


def pack(docs: DataFrame, tokenizer_path: str, sequence_length: int = 2048) -> DataFrame:
    """Packed id matrices of all documents; see the module for the columns."""
    ship(docs.sparkSession)
    return only(docs, "doc_id", "text").mapInArrow(tidy(_packer(tokenizer_path, sequence_length)), SCHEMA)


def write_matrices(packed: DataFrame, path: str) -> None:
    """Writes packed sequences as Parquet, one file a task, in the order they were packed."""
    packed.write.mode("overwrite").parquet(path)
