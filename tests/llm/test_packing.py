import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidemark.llm import packing_best_fit, packing_cutting_stock, wordcache
from tidemark.llm.wordcache import WordCache

from .conftest import ODD

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def cache():
    return WordCache(PATH)


def ids_of(cache, text):
    return [*cache.tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def test_cached_words_equal_the_library(cache):
    texts = [t for _, t in ODD] + ["Thlyoun, éeaux. WHEND!! a-b c_d 12.5 x’s don’t", "ñ ŉ Ÿ ſs ﬁ e\u0301 ..", "Aß, (b) [c] {d} $e$ e'll"]
    for t, got in zip(texts, cache.encode_all(texts), strict=True):
        assert got == np.array(cache.tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()


def check_pieces(rows, texts, cache, size):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    copies = defaultdict(list)
    for i, t in texts:
        copies[i].append(t)
    assert set(by_doc) == set(copies)
    for i, own in by_doc.items():
        ids = ids_of(cache, copies[i][0])
        seen = sorted((r.start, r.length) for r in own)
        want = [(s, min(size, len(ids) - s)) for s in range(0, len(ids), size) for _ in copies[i]]
        assert seen == sorted(want)
        for r in own:
            assert r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    return len(by_seq)


def test_cutting_stock_places_every_id_once(spark, odd, cache):
    check_pieces(packing_cutting_stock.pack(odd, PATH, 2048).collect(), ODD, cache, 2048)


def test_cutting_stock_of_documents_pads_little(spark, sf_small, cache):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    rows = packing_cutting_stock.pack(docs, PATH).collect()
    n = check_pieces(rows, [(r.doc_id, r.text) for r in docs.collect()], cache, 2048)
    assert sum(r.length for r in rows) / (2048 * n) > 0.98


def test_cutting_stock_program():
    demand = np.zeros(10, int)
    demand[[2, 3, 6]] = 40, 40, 40  # 3, 4 and 7 of 10: 7 + 3 fill a sequence, 4 + 4 don't
    used = packing_cutting_stock.plan(demand, 10)
    made = sum(p * n for p, n in used)
    assert (made == demand).all()
    assert all((p * np.arange(1, 11)).sum() <= 10 for p, _ in used)
    assert sum(n for _, n in used) == 60
    assert packing_cutting_stock.plan(np.zeros(10, int), 10) == []


def test_empty_tables(empty):
    assert packing_cutting_stock.pack(empty, PATH).collect() == []
    assert packing_best_fit.pack(empty, PATH).collect() == []


def test_best_fit_round_trip(odd, cache):
    got = defaultdict(dict)
    for r in packing_best_fit.pack(odd, PATH, 256).collect():
        assert len(r.ids) == len(r.position_ids) == 256 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.used
        for k, (doc, start) in enumerate(zip(r.doc_ids, r.starts, strict=True)):
            a, b = r.cu_seqlens[k], r.cu_seqlens[k + 1]
            assert r.position_ids[a:b] == list(range(b - a))
            got[doc].setdefault(start, []).append(r.ids[a:b])
        assert not any(r.ids[r.used :])
    for i, t in ODD:
        ids = ids_of(cache, t)
        parts = got[i]
        copies = sum(x == i for x, _ in ODD)
        assert all(len(v) == copies for v in parts.values())
        assert [x for s in sorted(parts) for x in parts[s][0]] == ids


def test_best_fit_matches_a_plain_search():
    r = np.random.default_rng(3)
    sizes = r.integers(1, 101, 500).tolist()
    bins = packing_best_fit.best_fit(sizes, 100)
    rooms: list[int] = []
    for s in sorted(sizes, reverse=True):
        fit = [x for x in rooms if x >= s]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - s)
        else:
            rooms.append(100 - s)
    assert sorted(100 - sum(sizes[i] for i in b) for b in bins) == sorted(rooms)
    assert sorted(i for b in bins for i in b) == list(range(500))


def test_texts_are_cut_anywhere_alike(cache, monkeypatch):
    """Slices of a few bytes: they end at blanks and texts' ends, and where there is neither go on."""
    texts = [t for _, t in ODD] + ["<|ENDOFTEXT|> <|endoftext|>x", "it's IT'S 'tis x''s ''s don't'", "ÉÈ×é÷ÿŸ É.É1É", "a" * 300 + "é" * 90 + " b", "…x 漢字 12½3 tab\there\r\n", "", None, "end", "Ünder", "x y z w"]
    array = pa.array(["left out", *texts], pa.string()).slice(1)
    want = [ids_of(cache, t) for t in texts]
    for size in (7, 64, 1000, 1 << 21):
        monkeypatch.setattr(wordcache, "SLICE_BYTES", size)
        ids, ends = cache.encode_ended(array, 1)
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == want


def test_a_full_cache_starts_anew(cache, sf_small, monkeypatch):
    texts = pq.read_table(f"{sf_small}/documents.parquet", columns=["text"]).column(0).combine_chunks()[:100]
    want = cache.encode(texts)[0].tolist()
    monkeypatch.setattr(wordcache, "CACHE_PIECES", 50)
    monkeypatch.setattr(wordcache, "SLICE_BYTES", 4096)
    assert cache.encode(texts)[0].tolist() == want == [i for t in texts.to_pylist() for i in ids_of(cache, t)[:-1]]
