import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from tidemark.llm import source_mixing

from .conftest import SCHEMA


def words(text):
    return len(re.findall("[^\x20\x09-\x0d]+", text or ""))


def level(sizes, weights, most):
    """Shares the excess again and again, in fractions."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, full, left = {}, set(), Fraction(sum(sizes.values()))
    while len(full) < len(names):
        rest = [s for s in names if s not in full]
        for s in rest:
            target[s] = left * weight[s] / sum(weight[x] for x in rest)
        over = [s for s in rest if target[s] > most * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = Fraction(most * sizes[s])
            left -= target[s]
        full.update(over)
    return target


def plain(rows, weights=(5, 2, 1), most=3, seed=0):
    """Documents of a source in the order of their hashes, as many times as the target needs."""
    sizes, of = defaultdict(int), defaultdict(list)
    for doc_id, text, source in rows:
        sizes[source] += words(text)
        key = ":".join(str(x) for x in (seed, doc_id, text) if x is not None)
        of[source].append((int(hashlib.md5(key.encode()).hexdigest()[:15], 16), repr((doc_id, text)), doc_id, words(text)))
    target, out = level(sizes, weights, most), []
    for source, docs in of.items():
        passes = target[source] // sizes[source] if sizes[source] else 0
        left = target[source] - passes * sizes[source]
        for *_, doc_id, n in sorted(docs, key=lambda t: t[:2]):
            more = left > 0 and 2 * left >= n
            out.append((doc_id, n, sizes[source], round(float(target[source]), 6), int(n * (passes + more))))
            left -= n
    return sorted(map(repr, out))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1, 1, "k", "s", 2, "r", "T", 3, "y", False, "c", "m") for i, t, s in rows], SCHEMA)


def found(df, **more):
    return sorted(repr((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken)) for r in source_mixing.mix(df, **more).collect())


@pytest.fixture(scope="module")
def rows():
    """One source with a third of all rows, one of a few words, one without any, a null one, one with a very long text."""
    r = random.Random(8)
    out = []
    for i in range(900):
        source = r.choice(["hot", "hot", "hot", "b", "c", "Zed", "é", "tiny", None, ""])
        if source == "tiny" and r.random() < 0.8:
            source = "b"
        out.append((i, " ".join("w" * r.randrange(1, 4) for _ in range(r.choice([0, 1, 20, 200]))) if r.random() < 0.97 else None, source))
    return [*out, (2000, "long " * 50_000, "c"), (2001, None, "void"), (2002, " \t\n", "void"), (None, "a null id", "b"), (None, "another null id", "b")]


def test_equals_documents_in_the_order_of_hashes(spark, rows):
    assert found(frame(spark, rows).repartition(7)) == plain(rows)
    assert found(frame(spark, rows), weights=(1, 30), seed=9) == plain(rows, (1, 30), seed=9)
    assert found(frame(spark, rows), weights=(1,)) == plain(rows, (1,))


def test_targets_are_met_and_reruns_agree(spark, rows):
    df = frame(spark, rows)
    got = found(df)
    assert got == found(df.repartition(3))
    near, largest = defaultdict(int), defaultdict(int)
    for r in source_mixing.mix(df).collect():
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        near[r.source, r.target] += r.taken
        largest[r.source, r.target] = max(largest[r.source, r.target], r.size)
    assert all(abs(n - target) <= largest[source, target] / 2 for (source, target), n in near.items())
    assert abs(sum(t for _, t in near) - sum(words(t) for _, t, _ in rows)) < 1e-6


def test_a_larger_budget_keeps_what_a_smaller_one_takes(spark, rows):
    taken = []
    for weights in ((6, 2, 1), (7, 2, 1), (9, 2, 1)):
        taken.append({r.doc_id: r.copies for r in source_mixing.mix(frame(spark, rows), weights).where("source is null or source <> 'hot'").where("source = ''").collect()})
    assert all(a[i] <= b[i] for a, b in zip(taken, taken[1:]) for i in a if len(taken) > 1) and len(taken[0]) > 10


def test_equal_rows_are_taken_in_part(spark):
    """A source of one row a thousand times meets its target within half a row, and always alike."""
    rows = [(1, "same words here", "a")] * 1000 + [(i, "x y z", "b") for i in range(2, 400)] + [(None, "q r", "c")] * 500
    one, two = found(frame(spark, rows), weights=(2, 5, 1)), found(frame(spark, rows).repartition(9), weights=(2, 5, 1))
    assert one == two
    by = Counter()
    for r in source_mixing.mix(frame(spark, rows), (2, 5, 1)).collect():
        by[r.source, r.target, r.size] += r.taken
    assert all(abs(n - target) <= size / 2 for (_, target, size), n in by.items())


def test_corpus_of_the_mix(spark, rows):
    df = frame(spark, rows)
    copies = Counter()
    for r in source_mixing.mix(df).collect():
        copies[r.doc_id] += r.copies
    out = source_mixing.mixed(df)
    assert out.columns == df.columns
    assert Counter(r[0] for r in out.select(out.columns[0]).collect()) == +copies


def test_few_rows(spark, empty, odd):
    assert found(empty) == [] and source_mixing.mixed(empty).collect() == []
    assert len(found(odd)) == odd.count()
    assert found(frame(spark, [(1, None, "a"), (2, "", None)])) == sorted(map(repr, [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]))
