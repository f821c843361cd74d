import hashlib
import pickle
import random
import re
import tracemalloc

import numpy as np

from tidemark.llm import decontamination

from .conftest import ODD, frame


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(text, items):
    w, hit, names = words(text), set(), set()
    for name, t in items:
        own = words(t)
        n = min(13, len(own))
        for j in range(len(own) - n + 1 if n else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == own[j : j + n]:
                    hit.update(range(i, i + n))
                    names.add(str(name))
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)


def cases():
    r = random.Random(2)
    vocabulary = [f"v{i}" for i in range(25)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(10, " ".join(text(40))), (2, " ".join(text(15))), (3, "tiny item"), (4, None), (5, " ,. "), (33, "solo"), (10, " ".join(text(14)))]
    docs = []
    for i in range(60):
        own = text(r.choice([0, 5, 60, 400]))
        if i % 3 == 0:
            source = words(items[i % 2][1])
            at = r.randrange(len(source) - 10)
            own[len(own) // 2 : len(own) // 2] = source[at : at + r.choice([8, 12, 13, 20])]
        if i % 7 == 0:
            own += ["Tiny,", "ITEM"]
        docs.append((100 + i, " ".join(own)))
    return docs + [(i, t) for i, t in ODD if i not in (7, 8, 9)], items


def test_hits_equal_brute_force(spark, monkeypatch):
    docs, items = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {i: brute(t, items) for i, t in docs}
    read = lambda df: {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()}
    assert read(decontamination.scan(frame(spark, docs), bench)) == want
    clean = sorted(i for i, x in want.items() if not x[4])
    assert sorted(r.doc_id for r in decontamination.remove(frame(spark, docs), bench).collect()) == clean
    # With several blocks of items the same words are hit.
    monkeypatch.setattr(decontamination, "blocks", lambda b: iter([[(str(i), t)] for i, t in items]))
    assert read(decontamination.scan(frame(spark, docs), bench)) == want
    assert sorted(r.doc_id for r in decontamination.remove(frame(spark, docs), bench).collect()) == clean


def test_maximal_matches_are_verbatim(spark):
    docs, items = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts, sources = dict(docs), {}
    for i, t in items:
        sources.setdefault(str(i), []).append(words(t))
    for r in decontamination.scan(frame(spark, docs), bench).collect():
        for m in r.matches:
            own = words(texts[r.doc_id])[m.start : m.start + m.words]
            assert any(s[m.item_start : m.item_start + m.words] == own for s in sources[m.item_id])


def test_empty_tables(spark, empty, odd):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.scan(empty, none).collect() == []
    assert {r.n_hit for r in decontamination.scan(odd, none).collect()} == {0}
    assert decontamination.remove(odd, none).count() == odd.count()


def test_several_blocks_judge_rows_not_ids(spark, monkeypatch):
    """A contaminated row takes no clean row along that shares its doc_id, or a null one."""
    items = [(1, " ".join(f"p{i}" for i in range(15))), (2, " ".join(f"q{i}" for i in range(15)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, [(None, items[0][1]), (None, "clean a"), (None, "clean b"), (5, items[1][1]), (5, "clean c"), (6, "clean d")])
    want = ["clean a", "clean b", "clean c", "clean d"]
    assert sorted(r.text for r in decontamination.remove(docs, bench).collect()) == want
    monkeypatch.setattr(decontamination, "blocks", lambda b: iter([[(str(i), t)] for i, t in items]))
    kept = decontamination.remove(docs, bench)
    assert kept.columns == docs.columns and sorted(r.text for r in kept.collect()) == want


def test_items_without_id_are_searched(spark, monkeypatch):
    """As in the oracle: their words are hit, they count as one item, and the hash leaves them out."""
    p, q, s = (" ".join(f"{c}{i}" for i in range(15)) for c in "pqs")
    items = [(None, p), (None, q), (7, s)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, [(1, p + " " + q), (2, s + " " + p), (3, "clean")])
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {1: (30, 1, sha(""), True), 2: (30, 2, sha("7"), True), 3: (0, 0, sha(""), False)}
    read = lambda: {r.doc_id: (r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontamination.scan(docs, bench).collect()}
    assert read() == want
    assert [r.doc_id for r in decontamination.remove(docs, bench).collect()] == [3]
    monkeypatch.setattr(decontamination, "blocks", lambda b: iter([[(i if i is None else str(i), t)] for i, t in items]))
    assert read() == want
    assert [r.doc_id for r in decontamination.remove(docs, bench).collect()] == [3]


def test_a_block_is_some_forty_bytes_a_word():
    r = np.random.default_rng(1)
    items = [(str(i), " ".join(f"w{x}" for x in r.integers(0, 50_000, 1000))) for i in range(400)]
    tracemalloc.start()
    block = decontamination.Windows(items, 13)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    (g,) = block.groups
    assert len(g.at) == 400 * 988 and held < 100 * 400_000 and len(pickle.dumps(block)) < 60 * 400_000
