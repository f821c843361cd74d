"""Token ids of whole texts by a `tokenizers` file, fast enough to run over a corpus.

The public word-level vocabulary lowers letters and cuts a text at blanks, between letters, digits and
marks, and after each digit; nothing is joined across a cut. So the ids of a text are those of its pieces, one
after the other. Texts are cut as bytes, a few megabytes at a time, wherever one text ends and the
next begins; pieces are told apart by a 64-bit hash and their ids kept in a bounded cache. Runs of
plain Latin letters that the cache lacks are merged many at a time with numpy (one lowest-ranked pair
of every word a round, the order the library itself uses). Everything else goes through the `tokenizers`
library: marks, digits, long words, and as a whole each space-separated chunk with other bytes, with an
apostrophe that may open a contraction, or with the begin of a special token. The result equals
``Tokenizer.encode(text, add_special_tokens=False)`` and the tests hold it against that.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable

import numpy as np
import pyarrow as pa

from .textbytes import flat, hashes

#: Pieces kept per Python worker; a full cache is emptied, so memory has a bound. Slots to find them by.
CACHE_PIECES, SLOT_BITS = 600_000, 21
#: Bytes of text that are cut and looked up together.
SLICE_BYTES = 1 << 20
#: Words with more bytes than this go through the library.
LONGEST = 48

_NEVER = np.int32(2**31 - 1)
_BLANK, _LETTER, _DIGIT, _MARK, _OTHER = range(5)


def _kinds() -> np.ndarray:
    """What each byte of lowered text is; both bytes of a plain letter beyond ASCII are looked at apart."""
    kind = np.full(256, _OTHER, np.uint8)
    kind[list(b" \t\n\r")] = _BLANK
    kind[0x21:0x7F] = _MARK
    kind[0x30:0x3A] = _DIGIT
    kind[0x61:0x7B] = _LETTER
    return kind


_KIND = _kinds()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The second byte of the letters U+00DF to U+00FF (without U+00F7), whose first is 0xC3; those above U+009F have
#: capitals 32 below.
_SECOND = np.zeros(256, bool)
_SECOND[0x9F:0xC0] = True
_SECOND[0xB7] = False
_CAPITAL = np.zeros(256, bool)
_CAPITAL[0x80:0x9F] = True
_CAPITAL[0x97] = False
_VALUE = np.arange(1, 257, dtype=np.uint64)
_VALUE[list(b" \t\n\r")] = 0
#: Letters that a contraction may begin with, after an apostrophe.
_CONTRACTS = np.zeros(256, bool)
_CONTRACTS[list(b"strvmld")] = True


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def spread(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of each run, one run after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(begins - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Merger:
    """Byte-pair merging of many words at once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        letters = _byte_letters()
        self.inner = np.array([vocab[x] for x in letters], np.int64)
        self.last = np.array([vocab[x + end] for x in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys, self.order = keys[order], order
        # A table of pairs by hash; pairs that share a slot are looked up in order instead.
        slot = self._slot(keys)
        self.slot_key = np.full(1 << 19, -1, np.int64)
        self.slot_rank = np.full(1 << 19, _NEVER, np.int32)
        self.slot_key[slot], self.slot_rank[slot] = keys, np.arange(len(keys), dtype=np.int32)
        self.shared = np.bincount(slot, minlength=1 << 19) > 1

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(45)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or the largest number where there is no such merge (as at -1, which is no id)."""
        key = left << 20 | right
        slot = self._slot(key)
        out = np.where((self.slot_key[slot] == key) & (key >= 0), self.slot_rank[slot], _NEVER)
        again = np.flatnonzero(self.shared[slot].ravel())
        if len(again):
            keys = key.ravel()[again]
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            out.ravel()[again] = np.where(self.keys[at] == keys, self.order[at], _NEVER)
        return out

    def merge(self, data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words of ``data`` at these places, one word after the other, and how many each has."""
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        low = 0
        for high in (4, 6, 8, 10, 14, 20, LONGEST):
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            if len(rows):
                self._merge_block(data, begins[rows], sizes[rows], rows, done)
            low = high
        counts = np.zeros(len(sizes), np.int64)
        for rows, n, _ in done:
            counts[rows] = n
        ends = np.cumsum(counts)
        out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint32)
        for rows, n, ids in done:
            out[spread(ends[rows] - n, n)] = ids
        return out, counts

    def _merge_block(self, data: np.ndarray, begins: np.ndarray, sizes: np.ndarray, rows: np.ndarray, out: list) -> None:
        wide = int(sizes.max())
        cols = np.arange(wide)
        inside = cols < sizes[:, None]
        sym = np.where(inside, self.inner[data[np.minimum(begins[:, None] + cols, len(data) - 1)]], -1)
        sym[np.arange(len(rows)), sizes - 1] = self.last[data[begins + sizes - 1]]
        rank = np.full((len(rows), wide), _NEVER, np.int32)
        if wide > 1:
            rank[:, :-1] = self.ranks(sym[:, :-1], sym[:, 1:])
        while len(rows):
            best = rank.argmin(axis=1)
            lowest = rank[np.arange(len(rows)), best]
            going = lowest != _NEVER
            if not going.all():
                ready = sym[~going]
                is_id = ready >= 0
                out.append((rows[~going], is_id.sum(axis=1), ready[is_id].astype(np.uint32)))
                rows, sym, rank, best, lowest = rows[going], sym[going], rank[going], best[going], lowest[going]
                if not len(rows):
                    return
            n = np.arange(len(rows))
            source = np.minimum(cols + (cols > best[:, None]), wide - 1)
            sym = np.take_along_axis(sym, source, 1)
            rank = np.take_along_axis(rank, source, 1)
            sym[:, -1] = -1
            rank[:, -1] = _NEVER
            sym[n, best] = self.made[lowest]
            after = np.where(best + 1 < wide, sym[n, np.minimum(best + 1, wide - 1)], -1)
            rank[n, best] = self.ranks(sym[n, best], after)
            before = np.maximum(best - 1, 0)
            rank[n, before] = np.where(best > 0, self.ranks(sym[n, before], sym[n, best]), rank[n, before])


class WordCache:
    """Ids as unsigned 32-bit numbers."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merger = Merger(path)
        self._empty()

    def _empty(self) -> None:
        self.slot_hash = np.zeros(1 << SLOT_BITS, np.uint64)
        self.slot_piece = np.zeros(1 << SLOT_BITS, np.int32)
        self.ids = np.zeros(1 << 20, np.uint32)
        self.begin, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.pieces = self.used = 0

    def _keep(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Adds pieces with these ids, one after the other, and returns their numbers."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while self.pieces + len(sizes) > len(self.begin):
            self.begin, self.size = (np.concatenate((x, np.zeros_like(x))) for x in (self.begin, self.size))
        new = slice(self.pieces, self.pieces + len(sizes))
        self.ids[self.used : self.used + len(ids)] = ids
        self.begin[new] = self.used + np.cumsum(sizes) - sizes
        self.size[new] = sizes
        self.used += len(ids)
        self.pieces += len(sizes)
        return np.arange(new.start, new.stop)

    def _learn(self, x: np.ndarray, begins: np.ndarray, sizes: np.ndarray, plain: np.ndarray) -> np.ndarray:
        """Numbers of new pieces at these places of ``x``: plain words are merged here, the rest is the library's."""
        out = np.zeros(len(begins), np.int64)
        out[plain] = self._keep(*self.merger.merge(x, begins[plain], sizes[plain]))
        rest = np.flatnonzero(~plain)
        if len(rest):
            found = [self.tokenizer.encode(x[a : a + n].tobytes().decode("utf-8", "replace"), add_special_tokens=False).ids for a, n in zip(begins[rest].tolist(), sizes[rest].tolist(), strict=True)]
            out[rest] = self._keep(np.array([i for ids in found for i in ids], np.uint32), np.array(list(map(len, found)), np.int64))
        return out

    def _cut(self, raw: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lowered bytes, where pieces begin, and the kind of each; ``heads``: where texts begin."""
        x = _LOWER[raw]
        pair = np.flatnonzero(x[:-1] == 0xC3)
        kind = None
        if len(pair):
            # No text ends within a letter.
            x[pair[_CAPITAL[x[pair + 1]]] + 1] += 0x20
            kind = _KIND[x]
            pair = pair[_SECOND[x[pair + 1]]]
            kind[pair] = kind[pair + 1] = _LETTER
        else:
            kind = _KIND[x]
        inner = kind != _BLANK
        head = np.zeros(len(x), bool)
        head[heads] = True
        starts = inner & ((kind == _DIGIT) | head)
        starts[:1] |= inner[:1]
        starts[1:] |= inner[1:] & (kind[1:] != kind[:-1])
        # Chunks that go to the library whole, as they were written.
        odd = kind == _OTHER
        pairs = np.flatnonzero((x[:-1] == 0x27) & _CONTRACTS[x[1:]] | (x[:-1] == 0x3C) & (x[1:] == 0x7C))
        odd[pairs] = True
        odd = np.flatnonzero(odd)
        if len(odd):
            opens = inner & head
            opens[:1] |= inner[:1]
            opens[1:] |= inner[1:] & ~inner[:-1]
            opens = np.flatnonzero(opens)
            closes = inner.copy()
            closes[:-1] &= ~inner[1:] | head[1:]
            closes = np.flatnonzero(closes) + 1
            chunk = np.unique(np.searchsorted(opens, odd, "right") - 1)
            a, b = opens[chunk], closes[chunk]
            at = spread(a, b - a)
            starts[at] = False
            starts[a] = True
            x[at] = raw[at]
            kind[a] = _OTHER
        starts = np.flatnonzero(starts)
        return x, starts, kind[starts]

    def _slice(self, raw: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a run of bytes, how many each piece has, and where pieces begin."""
        if self.pieces > CACHE_PIECES:
            self._empty()
        x, starts, kind = self._cut(raw, heads)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64), starts
        h = hashes(x, starts, _VALUE) | np.uint64(1)
        slot = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        piece = self.slot_piece[slot].astype(np.int64)
        missing = np.flatnonzero(self.slot_hash[slot] != h)
        if len(missing):
            new, first, which = np.unique(h[missing], return_index=True, return_inverse=True)
            at = missing[first]
            begins = starts[at]
            ends = np.append(starts, len(x))[at + 1]
            # Blanks after a piece are not its own.
            blanks = np.append(0, np.cumsum(_VALUE[x] == 0, dtype=np.int32))
            sizes = ends - begins - (blanks[ends] - blanks[begins])
            number = self._learn(x, begins, sizes, (kind[at] == _LETTER) & (sizes <= LONGEST))
            piece[missing] = number[which]
            own = (new >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
            self.slot_hash[own], self.slot_piece[own] = new, number
        sizes = self.size[piece].astype(np.int64)
        return self.ids[spread(self.begin[piece], sizes)], sizes, starts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all whole texts, one after the other, and where each text's begin and the last one's end."""
        data, places = flat(texts)
        parts, many = [np.zeros(0, np.uint32)], np.zeros(len(places), np.int64)
        a = 0
        while a < len(data):
            b = min(a + SLICE_BYTES, len(data))
            # A slice ends at a blank or the end of a text.
            if b < len(data):
                cut = max(int(places[np.searchsorted(places, b, "right") - 1]), 0)
                near = max(a, b - 4096)
                blank = np.flatnonzero(_VALUE[data[near:b]] == 0)
                cut = max(cut, near + int(blank[-1]) + 1 if len(blank) else 0)
                while cut <= a:
                    more = np.flatnonzero(_VALUE[data[b : b + SLICE_BYTES]] == 0)
                    end = int(places[np.searchsorted(places, b, "left")])
                    b, cut = min(b + SLICE_BYTES, len(data)), min(end, b + int(more[0]) + 1 if len(more) else len(data) + 1)
                    cut = a if cut > b else cut
                b = cut
            ids, sizes, starts = self._slice(data[a:b], places[(places >= a) & (places < b)] - a)
            parts.append(ids)
            whose = np.searchsorted(places, starts + a, "right")
            many += np.bincount(whose, weights=sizes, minlength=len(places)).astype(np.int64)[: len(places)]
            a = b
        return np.concatenate(parts), np.cumsum(many)

    def encode_ended(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """As encode(), with the id ``end`` after each text's own."""
        ids, ends = self.encode(texts)
        return np.insert(ids, ends[1:], np.uint32(end)), ends + np.arange(len(ends))

    def encode_all(self, texts: Iterable[str | None]) -> list[bytes]:
        """The ids of each whole text as little-endian bytes; null and empty texts have none."""
        ids, ends = self.encode(pa.array(list(texts), pa.string()))
        return [ids[a:b].astype("<u4").tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


_CACHES: dict[str, WordCache] = {}


def forget(path: str) -> None:
    """Gives up a worker's cache for a file; the next task that needs it makes a new one."""
    _CACHES.pop(path, None)


def word_cache(path: str) -> WordCache:
    """One cache for each file and Python worker."""
    if path not in _CACHES:
        _CACHES[path] = WordCache(path)
    return _CACHES[path]
