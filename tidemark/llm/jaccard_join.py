"""N-gram Jaccard join by vertical partitioning.

Every text becomes the set of its distinct word shingles, as 64-bit hashes. The hashes' own order is
the global order of n-grams. It is cut into fragments, so that a set falls into segments that can be
compared apart from each other:

1. *Candidates.* Two sets that link differ in at most ``D`` n-grams, a number that follows from their
   sizes. Cut into more than ``D`` fragments, they must agree on a whole segment. So each set sends
   one signature for each segment, and sets meet only where a whole segment agrees; a phrase that
   unrelated documents share brings none together. The number of fragments depends on the size, so
   sizes are dealt into classes such that links lie within a class or between neighbours, and a set
   sends its signatures for its own class and for the next. Empty segments send nothing: there are
   ``slack`` fragments more than needed, and a set with more empty segments than that is cut a
   second and third time by other hashes and at last meets all such sets of its class.
   Signatures travel packed: a task sorts what it made and sends a few bytes for each to the slot of
   its range, which keeps those that several sets sent. Of signatures that the very same sets sent,
   one is kept. There are as many slots as the texts' length asks for, so that one holds some millions of
   signatures at any size; a signature that very many sets send is settled in passes of bounded memory.
2. *Bound.* A sketch of parity bits differs in at most as many bits as the sets differ in n-grams; pairs
   that differ in more than they may are dropped where sets meet, before they are rows of their own. Sets too
   large for it have a wide sketch too, of two bits for each n-gram, by which pairs left are tested again.
3. *Overlaps.* Texts of the pairs left (a filter keeps most others out of the shuffle)
   are brought together, and overlaps are counted fragment by fragment and summed for each pair.

Equal sets form one class with one representative, whatever their number. Among sets that meet,
each is first compared with two hubs of its buckets; the links found give components; then sets are
compared with the least member of another component in their buckets; after that only
sets of a bucket that are still in different components are compared, all of them. So no link
between components is lost, and a large group of near copies gives as many pairs as it has members,
not the square of that.

Words are hashed from the bytes of an Arrow batch, about a megabyte at a time, so that a long text costs a
task a few times its length and not an object for each word.

Nulls and texts without words have an empty set and link with nothing. Texts with fewer words than a
shingle are one shingle. Rows that share a doc_id are one component, though each text is compared
as itself, and each row reports its own set size; a null doc_id has a null component. An empty table gives an empty
result; extra columns are ignored. Hashes of n-grams and sets have 64 bits: of ten billion different
sets two or three pairs would be taken for equal by chance.
"""

from __future__ import annotations

import math
import operator
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Columns, Filter, Stored, only, release, ship, tidy, without
from .components import components
from .textbytes import byte_values, mix, words

#: Bytes of documents handled at once in a task; a longer one is handled alone.
GROUP_BYTES = 1 << 20
#: Sets that a task remembers, to send the signatures of equal sets once.
REMEMBERED = 50_000
#: Signatures that a task sorts and sends at a time, and that the task of a slot holds before it settles them.
FLUSH_KEYS, HELD_KEYS = 600_000, 4_000_000
#: Slots of signatures in a task that settles them, at least; as many that a slot gets SLOT_KEYS signatures or so, with
#: this many characters for a word; and the most.
SLOTS, SLOT_KEYS, WORD_LENGTH, MOST_SLOTS = 4, 2_000_000, 5, 1 << 20
#: 64-bit numbers of the sketch that every set has, and the most bits of the wide one of larger sets: the power
#: of two from twice the set's size on.
SKETCH_LONGS, MOST_BITS = 16, 1 << 16
#: Fragments in which the overlap of a pair is counted.
COUNT_FRAGMENTS = 4
#: Pairs with one hub that a task compares before the hub's text is sent to another one too.
PAIRS_A_HUB = 128
#: Hubs that a set is first held against, of those that it meets.
HUBS = 8
#: Times that a set is cut anew when too many of its segments are empty.
CUTS = 3

_NEXT = np.uint64(0xBF58476D1CE4E5B9)


#: Blanks are no part of words; A-Z count as a-z.
_VALUE = byte_values(bytes(c for c in range(256) if c not in b" \t\n\x0b\f\r"))


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of all texts, one text after the other, and how many each has."""
    return words(texts, _VALUE)


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one after the other, and where each text's begin."""
    own_words, counts = words_of(texts)
    ends = np.cumsum(counts)
    total = len(own_words)
    h = mix(own_words, 1)
    with np.errstate(over="ignore"):
        for j in range(1, min(k, total)):
            h[: total - j] = mix(h[: total - j] * _NEXT + own_words[j:], j + 1)
    parts, sizes = [], np.zeros(len(counts) + 1, np.int64)
    for i, (m, e) in enumerate(zip(counts.tolist(), ends.tolist(), strict=True)):
        if m >= k:
            own = h[e - m : e - k + 1]
            own.sort()
            new = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=new[1:])
            own = own[new]
        elif m:
            one = mix(own_words[e - m : e - m + 1], 1)
            with np.errstate(over="ignore"):
                for j in range(1, m):
                    one = mix(one * _NEXT + own_words[e - m + j], j + 1)
            own = mix(one, 1000 + m)
        else:
            continue
        parts.append(own)
        sizes[i + 1] = len(own)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.cumsum(sizes)


class Sizes:
    """Classes of set sizes for the threshold p / q, with the fragments that each pair of neighbours needs."""

    def __init__(self, p: int, q: int):
        self.p, self.q = p, q
        self.low, self.high = [1], [q // p]

    def _reach(self, n: int) -> None:
        while self.high[-1] < n:
            self.low.append(self.high[-1] + 1)
            self.high.append(self.low[-1] * self.q // self.p)

    def of(self, n: np.ndarray) -> np.ndarray:
        """The class of each size."""
        self._reach(int(n.max(initial=1)))
        return np.searchsorted(np.array(self.high), n)

    def most(self, n: int) -> int:
        """In how many n-grams a set can differ from one as large as it or larger, and still link."""
        return n * (self.q - self.p) // self.p

    def fragments(self, group: int) -> tuple[int, int]:
        """Number of fragments and slack of the group in which classes ``group - 1`` and ``group`` meet."""
        self._reach(self.high[-1] + 1)
        need = self.most(self.high[group - 1]) + 1
        slack = math.ceil(2 * need * math.exp(-self.low[group - 1] / need)) + 1
        return need + slack, slack


@lru_cache
def sizes_of(p: int, q: int) -> Sizes:
    return Sizes(p, q)


def _cut(h: np.ndarray, doc: np.ndarray, F_of: np.ndarray, group: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of the segments that are not empty: whose, signature; and how many each text has."""
    n_docs = len(F_of)
    fragment = ((h >> np.uint64(32)) * F_of[doc].astype(np.uint64)) >> np.uint64(32)
    new = np.ones(len(h), bool)
    new[1:] = (fragment[1:] != fragment[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(n_docs, np.int64)
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(mix(h, 77), at)
        whose = doc[at]
        place = group[whose].astype(np.uint64) * np.uint64(1 << 32) + fragment[at] + np.uint64(salt << 60)
        keys = mix(sums ^ mix(place, 5), 6)
    return whose, keys, np.bincount(whose, minlength=n_docs)


def signatures(h: np.ndarray, begins: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """(whose, key) of all texts' segments in the groups of their own class and of the next."""
    sizes = sizes_of(p, q)
    n = np.diff(begins)
    classes = np.where(n > 0, sizes.of(n), -2)
    whose, keys = [], []
    doc = np.repeat(np.arange(len(n)), n)
    for step in (0, 1):
        group = classes + step
        live = group >= 1
        if not live.any():
            continue
        shape = {g: sizes.fragments(g) for g in np.unique(group[live]).tolist()}
        count = np.array([shape[g][0] if ok else 1 for g, ok in zip(group.tolist(), live.tolist(), strict=True)], np.int64)
        slack = np.array([shape[g][1] if ok else 0 for g, ok in zip(group.tolist(), live.tolist(), strict=True)], np.int64)
        todo = live
        for cut in range(CUTS):
            own = todo[doc]
            d, hh = doc[own], h[own]
            if cut:
                hh = mix(hh, 900 + cut)
                order = np.lexsort((hh, d))
                d, hh = d[order], hh[order]
            w, k, full = _cut(hh, d, count, group, cut)
            whose.append(w)
            keys.append(k)
            todo = todo & (count - full > slack)
            if not todo.any():
                break
        rest = np.flatnonzero(todo)
        whose.append(rest)
        keys.append(mix(group[rest].astype(np.uint64), 4242))
    if not whose:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(whose), np.concatenate(keys)


def sketches(h: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Parity bits of each set, as SKETCH_LONGS 64-bit numbers."""
    n = len(begins) - 1
    bits = 64 * SKETCH_LONGS
    doc = np.repeat(np.arange(n), np.diff(begins))
    odd = np.bincount(doc * bits + (h & np.uint64(bits - 1)).astype(np.int64), minlength=n * bits) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n, bits), axis=1).view(np.int64)


def wide_sketches(h: np.ndarray, begins: np.ndarray) -> list[bytes | None]:
    """Parity bits in proportion to the set where a sketch has fewer than two for each n-gram, else None."""
    out: list[bytes | None] = []
    for a, n in zip(begins[:-1].tolist(), np.diff(begins).tolist(), strict=True):
        bits = min(MOST_BITS, 1 << max(0, 2 * n - 1).bit_length())
        odd = np.bincount((h[a : a + n] & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1 if bits > 64 * SKETCH_LONGS else None
        out.append(None if odd is None else np.packbits(odd.astype(np.uint8)).tobytes())
    return out


def differing_bits(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """In how many bits the wide sketches of each pair differ, the longer one folded to the shorter one's size."""
    sizes = np.array([list(map(len, a)), list(map(len, b))], np.int64).reshape(2, -1)
    out = np.zeros(len(a), np.int64)
    for x, y in np.unique(sizes, axis=1).T.tolist():
        rows = np.flatnonzero((sizes[0] == x) & (sizes[1] == y)).tolist()
        both = []
        for side, size in ((a, x), (b, y)):
            m = np.frombuffer(b"".join(side[i] for i in rows), np.uint64).reshape(len(rows), size // 8)
            while m.shape[1] > min(x, y) // 8:
                half = m.shape[1] // 2
                m = m[:, :half] ^ m[:, half:]
            both.append(m)
        out[rows] = np.bitwise_count(both[0] ^ both[1]).sum(axis=1)
    return out


def _packed(keys: np.ndarray, sets: np.ndarray, slots: int) -> pa.RecordBatch:
    """Rows (slot, blob): of each signature its place in the slot (32 bits, sorted) and 40 bits of its set's
    hash, byte by byte apart, so that they compress."""
    order = np.argsort(keys)
    with np.errstate(over="ignore"):
        at = (keys[order] >> np.uint64(20)) * np.uint64(slots)
    slot = (at >> np.uint64(44)).astype(np.int32)
    place, whose = (at >> np.uint64(12)).astype(np.uint32), sets[order].view(np.uint8).reshape(-1, 8)[:, :5]
    cuts = np.flatnonzero(np.diff(slot, prepend=-1, append=slots))
    blobs = [place[a:b].view(np.uint8).reshape(-1, 4).T.tobytes() + whose[a:b].T.tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    return _send(pa.array(slot[cuts[:-1]]), pa.array(blobs, pa.binary()), {}, len(blobs))


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    rows = np.frombuffer(blob, np.uint8).reshape(9, -1)
    whose = np.zeros((rows.shape[1], 8), np.uint8)
    whose[:, :5] = rows[4:].T
    return np.ascontiguousarray(rows[:4].T).view(np.uint32).ravel(), whose.view(np.uint64).ravel()


#: What describes a row's set; and what a signature that several sets sent leaves for each of them.
_SET = {"doc_id": pa.int64(), "t": pa.int64(), "n": pa.int64(), "s1": pa.int64(), "sketch": pa.list_(pa.int64()), "wide": pa.binary()}
_MET = {"mark": pa.int64(), "part": pa.int64(), "hub": pa.int64()}
_SENT = "slot int, blob binary, doc_id long, t long, n long, s1 long, sketch array<long>, wide binary"
_DESCRIBED = "doc_id long, t long, n long, s1 long, sketch array<long>, wide binary, mark long, part long, hub long"


def _send(slot: pa.Array, blob: pa.Array, own: dict[str, pa.Array], n: int) -> pa.RecordBatch:
    columns = {"slot": slot, "blob": blob, **{c: own.get(c, pa.nulls(n, t)) for c, t in _SET.items()}}
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _part(s1: np.ndarray) -> np.ndarray:
    """The part of a set's hash that travels with its signatures; sets that share it meet together."""
    return s1 & np.uint64((1 << 40) - 1)


def _groups(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of about GROUP_BYTES of text together, or a single one."""
    held = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False))
    a = 0
    while a < b.num_rows:
        e = max(a + 1, int(np.searchsorted(held, (held[a - 1] if a else 0) + GROUP_BYTES, "right")))
        yield b.slice(a, e - a)
        a = e


def _describe(k: int, p: int, q: int, slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: OrderedDict[tuple[int, int], None] = OrderedDict()
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        held = turn = 0
        for rows in (g for b in batches for g in _groups(b)):
            ids = rows.column(0).to_pylist()
            h, begins = shingle_sets(rows.column(1), k)
            n = np.diff(begins)
            s1, s2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            some = np.flatnonzero(n)
            if len(some):
                s1[some] = mix(np.add.reduceat(mix(h, 11), begins[some]), 12)
                s2[some] = np.add.reduceat(mix(h, 13), begins[some])
            # Of equal sets in a task one stands for all: they link through their common hash. Rows with
            # a null doc_id link with nothing and stand for none.
            first = np.zeros(len(n), bool)
            for i in some.tolist():
                if ids[i] is None:
                    continue
                mark = (int(s1[i]), int(s2[i]))
                if mark not in seen:
                    seen[mark] = None
                    first[i] = True
                    if len(seen) > REMEMBERED:
                        seen.popitem(last=False)
            sketch = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * SKETCH_LONGS), pa.array(sketches(h, begins).ravel()))
            own = {"doc_id": rows.column(0), "t": rows.column(2), "n": pa.array(n), "s1": pa.array(s1.view(np.int64)), "sketch": sketch, "wide": pa.array(wide_sketches(h, begins), pa.binary())}
            yield _send(pa.array(((turn + np.arange(len(n))) % slots).astype(np.int32)), pa.nulls(len(n), pa.binary()), own, len(n))
            turn += len(n)
            whose, keys = signatures(h[np.repeat(first, n)], np.concatenate(([0], np.cumsum(n * first))), p, q)
            waiting.append((keys, _part(s1)[whose]))
            held += len(keys)
            if held >= FLUSH_KEYS:
                yield _packed(*map(np.concatenate, zip(*waiting, strict=True)), slots)
                waiting, held = [], 0
        if held:
            yield _packed(*map(np.concatenate, zip(*waiting, strict=True)), slots)

    return run


def settle(place: np.ndarray, part: np.ndarray, salt: int | None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Of signatures by place and the sets that sent them: for those of several sets a row (mark, part, hub) for
    each set, and one (place, part) of every signature.

    The mark stands for the sets that meet, so that signatures of the same sets have one. Where a
    signature's sets come in several passes it stands for the signature instead (``salt`` is the slot).
    """
    order = np.argsort(place, kind="stable")
    place, part = place[order], part[order]
    twin = np.zeros(len(place) + 1, bool)
    np.equal(place[1:], place[:-1], out=twin[1:-1])
    first = ~twin[:-1]
    several = twin[:-1] | twin[1:]
    x, y = place[several], part[several]
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    x, y = x[new], y[new]
    begins = np.flatnonzero(np.diff(x.astype(np.int64), prepend=-1))
    if not len(begins):
        return [np.zeros(0, np.uint64)] * 3, place[first], part[first]
    sizes = np.diff(begins, append=len(x))
    with np.errstate(over="ignore"):
        mark = np.add.reduceat(mix(y, 31), begins) if salt is None else mix(x[begins].astype(np.uint64) + np.uint64(salt << 32), 32)
    keep = np.repeat(sizes > 1, sizes)
    return [np.repeat(mark, sizes)[keep], y[keep], np.repeat(y[begins], sizes)[keep]], place[first], part[first]


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by slot: sets pass through, and signatures that several sets sent leave their sets."""
    now, passes, held = None, 0, 0
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def rows(own: dict[str, pa.Array], n: int) -> pa.RecordBatch:
        columns = {c: own.get(c, pa.nulls(n, t)) for c, t in (_SET | _MET).items()}
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    def close(more: bool) -> Iterator[pa.RecordBatch]:
        nonlocal waiting, passes, held
        if waiting:
            passes += more
            met, place, part = settle(*map(np.concatenate, zip(*waiting, strict=True)), now if passes else None)
            waiting = [(place, part)] if more else []
            for a in range(0, len(met[0]), 100_000):
                own = {c: pa.array(x[a : a + 100_000].view(np.int64)) for c, x in zip(_MET, met, strict=True)}
                yield rows(own, len(own["mark"]))
        held = 0
        passes = passes if more else 0

    for b in batches:
        sets = b.filter(b.column("blob").is_null())
        if sets.num_rows:
            yield rows({c: sets.column(c) for c in _SET}, sets.num_rows)
        keys = b.filter(b.column("blob").is_valid())
        for slot, blob in zip(keys.column("slot").to_pylist(), keys.column("blob").to_pylist(), strict=True):
            if slot != now:
                yield from close(False)
                now = slot
            waiting.append(_unpacked(blob))
            held += len(blob) // 9
            if held >= HELD_KEYS:
                yield from close(True)
    yield from close(False)


def _overlaps(k: int):
    """Rows come sorted by hub and salt, the hub's own text first; counts go out fragment by fragment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, np.zeros(0, np.uint64)
        cuts = (np.arange(1, COUNT_FRAGMENTS, dtype=np.uint64)) * np.uint64(2**64 // COUNT_FRAGMENTS)
        for b in (g for b in batches for g in _groups(b)):
            hubs, nodes = b.column(0).to_pylist(), b.column(2).to_pylist()
            h, begins = shingle_sets(b.column(1), k)
            out: list[tuple] = []
            for i, (a, node) in enumerate(zip(hubs, nodes, strict=True)):
                mine = h[begins[i] : begins[i + 1]]
                if node is None:
                    hub, own = a, mine.copy()
                    continue
                assert a == hub, "a pair without its hub"
                at = np.minimum(np.searchsorted(own, mine), max(0, len(own) - 1))
                common = mine[own[at] == mine] if len(own) else mine[:0]
                shared = np.diff(np.concatenate(([0], np.searchsorted(common, cuts), [len(common)])))
                out += [(a, node, f, int(c)) for f, c in enumerate(shared)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=["a", "b", "fragment", "shared"])

    return run


def _text_key(doc_id: str, text: str) -> Column:
    """Stands for a text together with its doc_id, where doc_ids repeat."""
    return F.xxhash64(doc_id, text)


class Join:
    """One run of the join over ``docs``; ``k`` words a shingle, linked at similarity ``p / q``."""

    def __init__(self, docs: DataFrame, k: int, p: int, q: int):
        ship(docs.sparkSession)
        self.docs, self.k, self.p, self.q = only(docs, "doc_id", "text").withColumn("t", _text_key("doc_id", "text")), k, p, q
        self.store = Stored(docs.sparkSession, "jaccard")

    def _may_link(self, a: str, b: str) -> Column:
        """Sizes fit, and the sketches differ in no more bits than the sets may differ in."""
        na, nb = F.col(f"{a}n"), F.col(f"{b}n")
        return (self.q * F.least(na, nb) >= self.p * F.greatest(na, nb)) & (self._bits(a, b) * (self.q + self.p) <= (self.q - self.p) * (na + nb))

    def _bits(self, a: str, b: str) -> Column:
        return reduce(operator.add, (F.bit_count(F.col(f"{a}sketch")[i].bitwiseXOR(F.col(f"{b}sketch")[i])) for i in range(SKETCH_LONGS)))

    def _still_may(self, pairs: DataFrame) -> DataFrame:
        """The same by the wide sketches of larger sets: (hub, node, hub_t, node_t) and other columns."""
        import pandas as pd

        def differ(a: pd.Series, b: pd.Series) -> pd.Series:
            both = (a.notna() & b.notna()).to_numpy()
            out = np.zeros(len(a), np.int64)
            out[both] = differing_bits(a[both].tolist(), b[both].tolist())
            return pd.Series(out)

        differ.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
        bits = F.pandas_udf(differ, "long")("hub_wide", "node_wide")
        return pairs.where(bits * (self.q + self.p) <= (self.q - self.p) * (F.col("hub_n") + F.col("node_n")))

    def _verify(self, pairs: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
        """Of pairs of sets, as _PAIR, those that link, as (u, v), the sets' ids in the graph."""
        per_hub = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / PAIRS_A_HUB).alias("salts"))
        salted = pairs.join(per_hub, "hub").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")))
        wanted = salted.select("hub", "salt", F.col("node_t").alias("t"), F.col("node"))
        wanted = wanted.unionByName(salted.select("hub", "salt", F.col("hub_t").alias("t")).distinct().withColumn("node", F.lit(None).cast("long")))
        # A set's text is the one that its node was made of, whatever others have its doc_id.
        texts = self.docs.where(Filter(wanted, "t").may_hold("t"))
        if not self.unique:
            texts = texts.dropDuplicates(["t"])
        sent = texts.join(wanted, "t").select("hub", "node", "text", "salt")
        n = max(8, int(self.docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        laid = sent.repartition(n, "hub", "salt").sortWithinPartitions("hub", "salt", F.col("node").asc_nulls_first())
        counted = laid.select("hub", "text", "node").mapInArrow(tidy(_overlaps(self.k)), "a long, b long, fragment int, shared long")
        shared = counted.groupBy("a", "b").agg(F.sum("shared").alias("shared"))
        size = lambda c: nodes.select(F.col("s1").alias(c), F.col("n").alias(f"{c}n"), F.col("id").alias(f"{c}_id"))
        full = shared.join(size("a"), "a").join(size("b"), "b")
        linked = full.where((self.p + self.q) * F.col("shared") >= self.p * (F.col("an") + F.col("bn")))
        return self.store.keep(linked.select(F.col("a_id").alias("u"), F.col("b_id").alias("v")), name)

    def run(self) -> DataFrame:
        """doc_id, n_shingles, component_id of each row, and set_id, equal for equal sets."""
        rows, named = self.sets()
        named = named.select("s1", self._doc("component").alias("component"))
        if not self.unique:
            named = self._same_ids(rows, named)
        return rows.join(named, "s1", "left").select(
            "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component"))).otherwise(F.col("doc_id")).alias("component_id"), F.col("s1").alias("set_id")
        )

    def _signatures(self) -> int:
        """About how many signatures all sets send: of each class and the next, one for each n-gram they may differ in."""
        length = self.docs.agg(F.sum(F.length("text"))).first()[0] or 0
        return math.ceil(length / WORD_LENGTH * 4 * (self.q - self.p) / (self.q + self.p))

    def _doc(self, id_: str) -> Column:
        return F.col(id_) if self.unique else F.col(f"{id_}.doc_id")

    def sets(self) -> tuple[DataFrame, DataFrame]:
        """Rows (doc_id, t, n, s1) and, for each set that has a doc_id, the least id of a set that links lead to.

        A set's id is its smallest doc_id, with the set's own hash beside it where doc_ids repeat.
        """
        store, spark = self.store, self.docs.sparkSession
        n = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
        slots = min(MOST_SLOTS, max(SLOTS * n, -(-self._signatures() // SLOT_KEYS)))
        sent = self.docs.mapInArrow(tidy(_describe(self.k, self.p, self.q, slots)), _SENT)
        described = store.keep(sent.repartitionById(n, F.col("slot")).sortWithinPartitions("slot").mapInArrow(tidy(_settled), _DESCRIBED), "described")
        release(spark)
        rows = described.where("mark is null").select("doc_id", "t", "n", "s1")
        counted = rows.agg(F.count("doc_id"), F.count_distinct("doc_id")).first()
        self.unique = counted[0] == counted[1]
        # One node for each set: its smallest doc_id, combined before the shuffle.
        least = described.where("mark is null and n > 0 and doc_id is not null").groupBy("s1").agg(F.min(F.struct("doc_id", "t", "n", "sketch", "wide")).alias("x"))
        node_id = F.col("x.doc_id") if self.unique else F.struct("x.doc_id", "s1")
        nodes = store.keep(least.select("s1", F.col("s1").bitwiseAND(F.lit((1 << 40) - 1)).alias("part"), node_id.alias("id"), "x.t", "x.n", "x.sketch", "x.wide"), "nodes")
        buckets = store.keep(described.where("mark is not null").select("mark", "part").distinct(), "buckets")

        # First each set with two of the hubs that it shares the most segments with.
        hubs = described.where("mark is not null and part <> hub").groupBy(F.col("part").alias("node")).agg(F.expr(f"approx_top_k(hub, {HUBS}, 256)").alias("h"))
        first = store.keep(self._nearest(hubs.select("node", F.explode("h.item").alias("hub")), nodes, "part"), "pairs-1")
        links = self._verify(first, nodes, "links-1")
        parts = components(links, store, "parts-1")
        release(spark)

        # Then sets with the least member, in their buckets, of another component.
        split = self._unsettled(buckets, nodes, parts, "open-1")
        others = split.where("component <> low.component").select(F.col("low.s1").alias("hub"), F.col("s1").alias("node")).distinct()
        second = store.keep(self._nearest(others.join(first.select("hub", "node"), ["hub", "node"], "left_anti"), nodes, "s1"), "pairs-2")
        links2 = self._verify(second, nodes, "links-2")
        parts = self._joined(parts, links2, "parts-2")

        # At last all that met and are in different components still. Sketches only join what is left.
        open_ = self._unsettled(buckets, nodes, parts, "open-2").join(nodes.select("s1", "n", "sketch"), "s1")
        open_ = store.keep(open_, "open-3")
        l = open_.where("component <> low.component").select("mark", *(F.col(c).alias(f"l_{c}") for c in ("s1", "n", "sketch", "component")))  # noqa: E741
        r = open_.select("mark", *(F.col(c).alias(f"r_{c}") for c in ("s1", "n", "sketch", "component")))
        # Both sides outside the least component would come twice.
        once = F.col("r_component") < F.col("l_component")
        more = l.join(r, (l["mark"] == r["mark"]) & once & self._may_link("l_", "r_"))
        more = more.select(F.least("l_s1", "r_s1").alias("hub"), F.greatest("l_s1", "r_s1").alias("node")).distinct()
        done = first.unionByName(second).select(F.least("hub", "node").alias("hub"), F.greatest("hub", "node").alias("node"))
        more = more.join(done, ["hub", "node"], "left_anti")
        third = store.keep(self._still_may(self._with_sides(more, nodes, "s1")).select(F.col("hub_s1").alias("hub"), F.col("node_s1").alias("node"), "hub_t", "node_t"), "pairs-3")
        links3 = self._verify(third, nodes, "links-3")
        parts = self._joined(parts, links3, "parts-3")
        self.links = links.unionByName(links2).unionByName(links3)
        store.drop("open-1", "open-2", "open-3", "buckets", "pairs-1", "pairs-2", "pairs-3")

        return rows, nodes.select("s1", F.col("id").alias("node")).join(parts, "node", "left").select("s1", F.coalesce("component", "node").alias("component"))

    def _with_sides(self, pairs: DataFrame, nodes: DataFrame, by: str) -> DataFrame:
        """Pairs of hub and node, given as this column of ``nodes``, with what is known of both."""
        side = lambda c: nodes.select(F.col(by).alias(c), *(F.col(x).alias(f"{c}_{x}") for x in ("s1", "t", "n", "sketch", "wide")))
        return pairs.join(side("hub"), "hub").join(side("node"), "node")

    def _nearest(self, pairs: DataFrame, nodes: DataFrame, by: str) -> DataFrame:
        """For each node the two hubs, of those it may link with, whose sketches differ least."""
        near = self._still_may(self._with_sides(pairs, nodes, by).where((F.col("hub_s1") != F.col("node_s1")) & self._may_link("hub_", "node_")))
        best = Window.partitionBy("node_s1").orderBy(self._bits("hub_", "node_"), "hub_s1")
        return near.withColumn("r", F.row_number().over(best)).where("r <= 2").select(F.col("hub_s1").alias("hub"), F.col("node_s1").alias("node"), "hub_t", "node_t").distinct()

    def _unsettled(self, buckets: DataFrame, nodes: DataFrame, parts: DataFrame, name: str) -> DataFrame:
        """Sets (mark, s1, component) of buckets that hold several components, and ``low``, the least component with
        its least set there."""
        placed = nodes.select("part", "s1", "id").join(parts.withColumnRenamed("node", "id"), "id", "left").select("part", "s1", F.coalesce("component", "id").alias("component"))
        own = self.store.keep(buckets.join(placed, "part").drop("part"), f"{name}-met")
        split = own.groupBy("mark").agg(F.min(F.struct("component", "s1")).alias("low"), F.max("component").alias("high")).where("low.component < high").select("mark", "low")
        found = self.store.keep(own.join(split, "mark"), name)
        self.store.drop(f"{name}-met")
        return found

    def _joined(self, parts: DataFrame, links: DataFrame, name: str) -> DataFrame:
        """Components, which are stars so far, with new links."""
        if not links.head(1):
            return parts
        return components(parts.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(links), self.store, name)

    def _same_ids(self, rows: DataFrame, named: DataFrame) -> DataFrame:
        """Components of sets that share a doc_id are one."""
        of = rows.where("n > 0 and doc_id is not null").select("doc_id", "s1").distinct().join(named, "s1")
        least = of.groupBy("doc_id").agg(F.min("component").alias("least"))
        joined = components(of.join(least, "doc_id").select(F.col("component").alias("u"), F.col("least").alias("v")), self.store, "same")
        return named.join(joined.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left").select("s1", F.coalesce("top", "component").alias("component"))


def link_components(docs: DataFrame, k: int = 5, p: int = 8, q: int = 10) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links lead to) of each row."""
    return Join(docs, k, p, q).run()


def one_of_each(docs: DataFrame, k: int = 5, p: int = 8, q: int = 10) -> DataFrame:
    """One document of each group of texts that links lead to, that with the smallest doc_id, with all its columns.

    Rows with a null doc_id stay. Texts that share nothing but their doc_id all stay; of rows with one
    doc_id and one set of shingles (or none) one stays.
    """
    own = Columns(docs)
    docs, key, text = own.df, own.of("doc_id"), own.of("text")
    join = Join(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), k, p, q)
    rows, named = join.sets()
    placed = rows.where("doc_id is not null").join(named, "s1", "left")
    if join.unique:
        gone = join.store.keep(placed.where("n > 0 and doc_id <> component").select("doc_id"), "gone")
        return own.back(without(docs, gone, key, join.store))
    stays = (F.col("n") == 0) | ((F.col("component.doc_id") == F.col("doc_id")) & (F.col("component.s1") == F.col("s1")))
    one = placed.where(stays).groupBy("doc_id", "s1").agg(F.min("t").alias("t"))
    gone = join.store.keep(placed.select("t").join(one.select("t"), "t", "left_anti").distinct(), "gone")
    left = without(docs.withColumn("t", _text_key(key, text)), gone, "t", join.store)
    ranked = left.where(f"{key} is not null").withColumn("r", F.row_number().over(Window.partitionBy("t").orderBy(text))).where("r = 1").drop("r")
    return own.back(ranked.unionByName(left.where(f"{key} is null")))
