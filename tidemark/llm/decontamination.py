"""Benchmark decontamination by suffix arrays of the training text.

Words of documents and benchmark items are 64-bit hashes, numbered by the benchmark's vocabulary; a word that
no item has can be part of no match and gets 0. Each task cuts its documents into shards and builds, for
every shard, an array of its suffixes sorted by their first ``window`` words. Suffixes whose first few
words begin no window are left out beforehand, since they can match none; the array so holds every suffix
that a search can return. Then the benchmark suffixes that begin like any of these are looked up by binary
search: their lower and upper bound in the array delimit all places where their window occurs. Places that
follow each other in document and item join to maximal verbatim matches, which give the longest match and
location.

A benchmark item of fewer words than a window, but not none, is one window of its own length. A word
of a document is hit if it lies in an occurrence of any window; a document is contaminated if at
least a twentieth of its words, and one word, are hit.

The benchmark goes to the tasks in blocks of at most ``BLOCK_WORDS`` words (or one longer item), as arrays of
some forty bytes a word. The driver makes one block after the other, and a task that has several holds one at a
time and looks it up in a whole shard; documents are read once, however many blocks there are.

Null texts have no words, as have empty ones: nothing hit, not contaminated. Items with null, empty
or word-less text have no windows; of items with the same text each counts. Items with a null item_id are
searched like others; in n_items all that a document holds count as one, items_sha256 leaves them out, and
their matches have a null item_id. Repeated documents are
judged alike. Very long documents make a shard of their own. Extra columns are ignored. Two words of one hash
would be taken for the same; of a billion different words one pair in forty is expected to share one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Columns, only, ship, tidy
from .textbytes import byte_values, mix, words

WINDOW = 13
#: Bytes of documents in one suffix array (or one longer document).
SHARD_BYTES = 4 << 20
#: Words of benchmark items sent to tasks at once.
BLOCK_WORDS = 2_000_000
#: Words at the front of a suffix that are looked at before it enters the array.
FRONT = 4

#: Digits, letters and all non-ASCII bytes belong to words.
_VALUE = byte_values(bytes(c for c in range(256) if 0x30 <= c <= 0x39 or 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A or c >= 0x80))

MATCHES = "array<struct<item_id:string,start:long,item_start:long,words:long>>"
_FIELDS = {"n_words": pa.int64(), "n_hit": pa.int64(), "items": pa.list_(pa.string()), "matches": pa.list_(pa.struct([("item_id", pa.string()), ("start", pa.int64()), ("item_start", pa.int64()), ("words", pa.int64())]))}
SCHEMA = f"doc_id long, n_words long, n_hit long, items array<string>, matches {MATCHES}"


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of all texts, one text after the other, and how many each has."""
    return words(texts, _VALUE)


def _front(columns: list[np.ndarray]) -> np.ndarray:
    """One number for the first few words of each suffix; equal words give equal numbers."""
    out = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        out = mix(out ^ c.astype(np.uint64), 7)
    return out


def _ranges(low: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The numbers low, low + 1, ... of each range, one after the other."""
    ends = np.cumsum(many)
    return np.repeat(low - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)


def _rows(text: np.ndarray, at: np.ndarray, w: int) -> np.ndarray:
    """``w`` words from each place on, as byte strings that sort and compare like the rows of numbers."""
    return np.ascontiguousarray(text[at[:, None] + np.arange(w)].astype(">u4")).view(f"S{4 * w}").ravel()


@dataclass(frozen=True)
class Group:
    """The different windows of one length, sorted by front: where each is in the block's text, and (from
    ``first`` to the next one's) the items and places that it comes from."""

    length: int
    fronts: np.ndarray
    at: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray


class Windows:
    """The windows of a block of items, by length, with the items and places they come from."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        h, counts = words_of(pa.array([t for _, t in items], pa.string()))
        self.names = [n for n, _ in items]
        self.vocabulary = np.unique(h)
        self.marked = np.zeros(1 << 20, bool)
        self.marked[(self.vocabulary & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.text = (np.searchsorted(self.vocabulary, h) + 1).astype(np.uint32)
        begins = np.cumsum(counts) - counts
        lengths = np.minimum(window, counts)
        self.groups = [self._group(int(w), np.flatnonzero(lengths == w), begins, counts) for w in np.unique(lengths[lengths > 0])]

    def _group(self, w: int, items: np.ndarray, begins: np.ndarray, counts: np.ndarray) -> Group:
        many = counts[items] - w + 1
        item = np.repeat(items, many).astype(np.int32)
        at = _ranges(begins[items], many)
        rows = _rows(self.text, at, w)
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        del rows
        at, item = at[order], item[order]
        place = (at - begins[item]).astype(np.int64)
        fronts = _front([self.text[at[first] + k] for k in range(min(w, FRONT))])
        by_front = np.argsort(fronts, kind="stable")
        # Sources stay in the order of windows; a window says where its own are.
        ends = np.append(first[1:], len(at))
        sizes = (ends - first)[by_front]
        moved = _ranges(first[by_front], sizes)
        return Group(w, fronts[by_front], at[first[by_front]], np.append(0, np.cumsum(sizes)), item[moved], place[moved])

    def number(self, h: np.ndarray) -> np.ndarray:
        """The numbers of words by hash; 0 where no item has the word."""
        out = np.zeros(len(h), np.uint32)
        may = np.flatnonzero(self.marked[(h & np.uint64((1 << 20) - 1)).astype(np.int64)]) if len(self.vocabulary) else np.zeros(0, np.int64)
        near = np.searchsorted(self.vocabulary, h[may])
        near = np.minimum(near, len(self.vocabulary) - 1)
        out[may] = np.where(self.vocabulary[near] == h[may], near + 1, 0) if len(may) else 0
        return out


def search(text: np.ndarray, windows: Windows) -> Iterator[tuple[Group, np.ndarray, np.ndarray]]:
    """For each window length: places in ``text`` and the number of the window that occurs there.

    ``text`` has a 0 between documents, so no match crosses from one to the next.
    """
    for g in windows.groups:
        w, q = g.length, min(g.length, FRONT)
        if len(text) < w:
            continue
        n = len(text) - w + 1
        may = text[:n] > 0
        for k in range(1, q):
            may &= text[k : n + k] > 0
        at = np.flatnonzero(may)
        own = _front([text[at + k] for k in range(q)])
        low = np.searchsorted(g.fronts, own)
        found = np.flatnonzero(g.fronts[np.minimum(low, len(g.fronts) - 1)] == own)
        at, own = at[found], np.unique(own[found])
        if not len(at):
            continue
        suffixes = _rows(text, at, w)
        order = np.argsort(suffixes, kind="stable")
        array = suffixes[order]
        low = np.searchsorted(g.fronts, own)
        asked = _ranges(low, np.searchsorted(g.fronts, own, "right") - low)
        wanted = _rows(windows.text, g.at[asked], w)
        low, high = np.searchsorted(array, wanted, "left"), np.searchsorted(array, wanted, "right")
        many = high - low
        yield g, at[order[_ranges(low, many)]], np.repeat(asked, many)


def _by_name(name: str | None) -> tuple[bool, str]:
    """Null last."""
    return name is None, name or ""


def _maximal(places: list[tuple[str | None, int, int, int]]) -> list[dict]:
    """Occurrences (item, start, item_start, words) that follow each other, joined."""
    out: list[dict] = []
    last: tuple | None = None
    for name, start, item_start, w in sorted(places, key=lambda p: (_by_name(p[0]), p[1] - p[2], p[1])):
        if last == (name, start - item_start) and start == before + 1:
            out[-1]["words"] += 1
        else:
            out.append({"item_id": name, "start": start, "item_start": item_start, "words": w})
        last, before = (name, start - item_start), start
    return sorted(out, key=lambda m: (m["start"], _by_name(m["item_id"]), m["item_start"]))


def _judged(shard: list[pa.Array], blocks: list, window: int, matches: bool) -> dict[str, list | np.ndarray]:
    """Of each text of a shard, whose arrays follow each other: n_words, n_hit, items and maximal matches."""
    parts = [words_of(t) for t in shard]
    counts = np.concatenate([n for _, n in parts])
    # A word that is none stands between texts.
    begins = np.cumsum(counts + 1) - counts - 1
    h = np.concatenate([x for x, _ in parts])
    at = _ranges(begins, counts)
    hit = np.zeros(int((counts + 1).sum()), bool)
    text = np.zeros(len(hit), np.uint32)
    names: dict[int, set[str | None]] = {}
    places: dict[int, list[tuple[str | None, int, int, int]]] = {}
    for block in blocks:
        windows = block.value
        text[at] = windows.number(h)
        marks = np.zeros(len(text) + 1, np.int32)
        for g, place, which in search(text, windows):
            np.add.at(marks, place, 1)
            np.add.at(marks, place + g.length, -1)
            whose = np.searchsorted(begins, place, "right") - 1
            sizes = np.diff(g.first)[which]
            sources = _ranges(g.first[which], sizes)
            of, item = np.repeat(whose, sizes), g.item[sources]
            for k, i in np.unique(np.stack((of, item)), axis=1).T.tolist():
                names.setdefault(k, set()).add(windows.names[i])
            if matches:
                for k, i, p, s in zip(of.tolist(), item.tolist(), np.repeat(place - begins[whose], sizes).tolist(), g.place[sources].tolist(), strict=True):
                    places.setdefault(k, []).append((windows.names[i], p, s, g.length))
        hit |= np.cumsum(marks[:-1]) > 0
        if len(blocks) > 1:
            # One block at a time: what a broadcast has read stays in the worker otherwise.
            block.__dict__.pop("_value", None)
    total = np.append(0, np.cumsum(hit))
    return {
        "n_words": counts, "n_hit": total[begins + counts] - total[begins],
        "items": [sorted(names.get(k, ()), key=_by_name) for k in range(len(counts))], "matches": [_maximal(places.get(k, [])) for k in range(len(counts))],
    }


def _shards(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[list[pa.RecordBatch]]:
    shard, held = [], 0
    for b in batches:
        shard.append(b)
        held += b.column(at).nbytes
        if held >= SHARD_BYTES:
            yield shard
            shard, held = [], 0
    if shard:
        yield shard


def blocks(benchmark: DataFrame, most: int = BLOCK_WORDS) -> Iterator[list[tuple[str | None, str | None]]]:
    """The benchmark's items, at most so many words at a time (one item at least)."""
    block: list[tuple[str | None, str | None]] = []
    held = 0
    for r in only(benchmark, "item_id", "text").select(F.col("item_id").cast("string").alias("item_id"), "text").toLocalIterator():
        n = len(r["text"] or "") // 2  # a word and what ends it are two characters at least
        if block and held + n > most:
            yield block
            block, held = [], 0
        block.append((r["item_id"], r["text"]))
        held += n
    yield block


def _sent(spark: SparkSession, benchmark: DataFrame, window: int) -> list:
    """Broadcast blocks; the driver has one at a time, besides what Spark keeps of them on disk or in memory."""
    ship(spark)
    return [spark.sparkContext.broadcast(Windows(b, window)) for b in blocks(benchmark)]


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated and
    matches (all maximal verbatim matches: item, place in either, words)."""
    sent = _sent(docs.sparkSession, benchmark, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, 1):
            found = _judged([b.column(1) for b in shard], sent, window, True)
            ids = pa.concat_arrays([b.column(0) for b in shard])
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(found[c], t) for c, t in _FIELDS.items())], names=["doc_id", *_FIELDS])

    found = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), SCHEMA)
    n_hit, n_words = F.col("n_hit"), F.col("n_words")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= n_words)).alias("contaminated"), "matches",
    )


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated, with all their columns. A task knows all that decides about its
    documents, so nothing is shuffled."""
    own = Columns(docs)
    sent, at = _sent(docs.sparkSession, benchmark, window), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, at):
            found = _judged([b.column(at) for b in shard], sent, window, False)
            clean, first = ~((found["n_hit"] > 0) & (20 * found["n_hit"] >= found["n_words"])), 0
            for b in shard:
                yield b.filter(pa.array(clean[first : first + b.num_rows]))
                first += b.num_rows

    return own.back(own.df.mapInArrow(tidy(run), own.df.schema))
