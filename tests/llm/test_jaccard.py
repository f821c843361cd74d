import re
import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import jaccard_join
from tidemark.llm.components import components
from tidemark.llm.common import Stored, without

from .conftest import ODD, frame


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(pairs, k, p, q):
    sets = {i: shingles(t, k) for i, t in pairs}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and q * len(sets[i] & sets[j]) >= p * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("k, p, q", [(3, 90, 100), (5, 8, 10), (1, 8, 10)])
def test_components_equal_brute_force(spark, prose, k, p, q):
    pairs = prose + [(i + 2000, t) for i, t in ODD if i != 7] + [(2007, "Three LITTLE words"), (2107, "three little words")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link_components(frame(spark, pairs), k, p, q).collect()}
    assert got == brute(pairs, k, p, q)


def test_repeated_and_null_ids(spark, empty):
    same = frame(spark, [(5, "a b c d e f"), (5, "g h i j k l"), (9, "g h i j k l"), (None, "a b c d e f"), (7, "a b c d e f")])
    got = sorted((r.doc_id or -1, r.component_id) for r in jaccard_join.link_components(same, 3, 9, 10).collect())
    assert got == [(-1, None), (5, 5), (5, 5), (7, 5), (9, 5)]
    assert jaccard_join.link_components(empty).collect() == []
    assert jaccard_join.one_of_each(empty).collect() == []


def test_one_of_each_keeps_one_of_a_component(spark, prose):
    docs = frame(spark, prose)
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in brute(prose, 5, 8, 10).values()})


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "u long, v long")
    got = dict((r.node, r.component) for r in components(links, Stored(spark, "t"), "c").collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_a_single_short_text(spark):
    """Two or three words are all that a group of texts has, at shingles of five."""
    for t, n in (("two words", 1), ("now three words", 1), ("one", 1), ("", 0)):
        (row,) = jaccard_join.link_components(frame(spark, [(3, t)]).coalesce(1)).collect()
        assert (row.doc_id, row.n_shingles, row.component_id) == (3, n, 3)


def test_a_row_without_id_stands_for_no_other(spark):
    base = [f"w{i}" for i in range(60)]
    near = [*base[:-1], "other"]
    docs = frame(spark, [(None, " ".join(base)), (4, " ".join(base)), (None, " ".join(near)), (9, " ".join(near))]).coalesce(1)
    got = {r.doc_id: r.component_id for r in jaccard_join.link_components(docs).collect()}
    assert got == {None: None, 4: 4, 9: 4}
    assert sorted(r.doc_id or 0 for r in jaccard_join.one_of_each(docs).collect()) == [0, 0, 4]


def test_texts_that_share_an_id_are_compared_as_themselves(spark):
    text = lambda c: [f"{c}{i}" for i in range(60)]
    near = lambda c: " ".join([*text(c)[:-1], "other"])
    pairs = [(5, " ".join(text(c))) for c in "abcd"] + [(10 + i, near(c)) for i, c in enumerate("abcd")] + [(10, " ".join(text("e"))), (5, " ".join(text("a"))), (None, near("a")), (5, None), (5, "")]
    docs = frame(spark, pairs)
    assert {r.component_id for r in jaccard_join.link_components(docs).where("doc_id is not null").collect()} == {5}
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    want = [(5, " ".join(text(c))) for c in "abcd"] + [(10, " ".join(text("e"))), (0, near("a")), (5, "")]
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted(want)


def test_words_are_hashed_alike_wherever_they_stand():
    word = "Ab" * 900_000  # longer than what is hashed at once
    texts = ["one Two\nTHREE", None, "", " two\x0bone ", "é\x1cİ ab", word, f"x {word.lower()} y", "three" + " " * 2_000_000 + "one"]
    got, counts = jaccard_join.words_of(pa.array(["skipped", *texts]).slice(1))
    want = [w for t in texts for w in (t or "").encode().lower().split()]
    assert counts.tolist() == [len((t or "").encode().split()) for t in texts]
    by_word = {}
    for h, w in zip(got.tolist(), want, strict=True):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)
    assert jaccard_join.words_of(pa.array([], pa.string()))[0].tolist() == []


def test_a_long_text_takes_a_few_times_its_length():
    text = pa.array([" ".join(f"w{i * 7919 % 1_000_003}" for i in range(7_000_000))])  # about 50 MB
    tracemalloc.start()
    h, begins = jaccard_join.shingle_sets(text, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(h) == begins[-1] > 900_000
    assert peak < 10 * text.nbytes


def test_signatures_of_a_slot_settle_alike_in_several_passes():
    r = np.random.default_rng(2)
    keys = r.integers(0, 2**63, 3000).astype(np.uint64)
    keys, sets = keys[r.integers(0, 3000, 20_000)], r.integers(1, 500, 20_000).astype(np.uint64)
    batch = jaccard_join._packed(keys, sets, 1)
    ((blob,),) = [batch.column("blob").to_pylist()]
    place, part = jaccard_join._unpacked(blob)
    want = defaultdict(set)
    for k, s in zip((keys >> np.uint64(32)).tolist(), sets.tolist(), strict=True):
        want[k].add(s)
    want = sorted(sorted(v) for v in want.values() if len(v) > 1)
    for most in (10**9, 700):
        jaccard_join.HELD_KEYS, before = most, jaccard_join.HELD_KEYS
        try:
            cut = [jaccard_join._packed(keys[a : a + 1000], sets[a : a + 1000], 1) for a in range(0, 20_000, 1000)]
            got = defaultdict(set)
            for b in jaccard_join._settled(iter(cut)):
                for mark, p in zip(b.column("mark").to_pylist(), b.column("part").to_pylist(), strict=True):
                    got[mark].add(p)
        finally:
            jaccard_join.HELD_KEYS = before
        found = sorted(sorted(v) for v in got.values())
        assert found == want if most == 700 else sorted(set(map(tuple, found))) == sorted(set(map(tuple, want)))
    assert len(place) == len(part) == 20_000


def test_sketches_of_two_sizes_bound_the_difference():
    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, 1030).astype(np.uint64)
    a, b = np.sort(base[:1024]), np.sort(base)
    (x,), (y,) = jaccard_join.wide_sketches(a, np.array([0, 1024])), jaccard_join.wide_sketches(b, np.array([0, 1030]))
    assert len(y) == 2 * len(x) == 512
    assert jaccard_join.differing_bits([x, y, x], [y, x, x]).tolist() == [6, 6, 0]
    assert jaccard_join.wide_sketches(a[:100], np.array([0, 100])) == [None]
    u, v = jaccard_join.sketches(a, np.array([0, 1024])), jaccard_join.sketches(b, np.array([0, 1030]))
    assert u.shape == (1, 16) and 0 < np.bitwise_count(u ^ v).sum() <= 6


def test_a_filter_never_loses_a_key(spark):
    keys = spark.range(0, 5000).toDF("k")
    docs = spark.range(0, 20_000).toDF("c0").unionByName(spark.createDataFrame([(None,)], "c0 long"))
    left = without(docs, keys, "c0", Stored(spark, "t"))
    assert sorted(r.c0 or -1 for r in left.collect()) == [-1, *range(5000, 20_000)]
