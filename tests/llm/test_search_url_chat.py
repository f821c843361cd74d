import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann_hnsw, chat_preference, url_automaton


def test_nearest_neighbours_and_odd_vectors(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(900, 16)) * r.uniform(0.5, 3, (900, 1))
    x[300:500] = x[300]  # a vector that many rows share
    rows = [(i, [float(v) for v in x[i]]) for i in range(900)]
    rows += [(2000, None), (2020, []), (2040, [0.0] * 16), (2060, [float("nan")] + [1.0] * 15), (2080, [float("inf")] + [1.0] * 15), (2100, [None] + [1.0] * 15), (2120, [1.0] * 5)]
    df = spark.createDataFrame([(i, v, 7, "x") for i, v in rows], "vec_id long, embedding array<double>, shard int, v string")
    got = {}
    for q in ann_hnsw.nearest(df, F.col("vec_id") % 20 == 0, 20, shard_rows=300).collect():
        got.setdefault(q.query_id, []).append((q.rank, q.vec_id, q.score))
    assert set(got) == set(range(0, 900, 20))
    hits = 0
    for q, own in got.items():
        s = x @ x[q]
        want = [i for i in sorted(range(900), key=lambda i: (-s[i], i)) if i != q][:20]
        own.sort()
        assert [k for k, *_ in own] == list(range(1, 21)) and len({v for _, v, _ in own}) == 20 and q not in {v for _, v, _ in own}
        assert [(v, -w) for _, v, w in own] == sorted(((v, -w) for _, v, w in own), key=lambda t: (t[1], t[0]))
        assert all(abs(w - s[v]) < 1e-9 for _, v, w in own)
        hits += len({v for _, v, _ in own} & set(want))
    assert hits / (20 * len(got)) > 0.95


def test_recall_of_hard_vectors_in_a_whole_shard(spark):
    """Independent normal components have no clusters: a fixed beam finds two thirds of the nearest."""
    r = np.random.default_rng(5)
    x = r.normal(size=(ann_hnsw.SHARD_ROWS, 64))
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(len(x))], "vec_id long, embedding array<double>")
    got = {}
    for q in ann_hnsw.nearest(df, F.col("vec_id") % 20 == 0, 20).select("query_id", "vec_id").collect():
        got.setdefault(q.query_id, set()).add(q.vec_id)
    hits = 0
    for q in range(0, len(x), 20):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:20].tolist()) & got[q])
    assert hits / (20 * len(got)) >= 0.9


def test_beam_stays_narrow_where_vectors_tie(spark, monkeypatch):
    """A third of all rows are one vector, and others come in pairs: which of equal rows are found says nothing."""
    r = np.random.default_rng(3)
    x = r.normal(size=(6000, 16))
    x[::3] = x[0]
    x[1::6] = x[4::6]
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(len(x))], "vec_id long, embedding array<double>")
    widths, search = [], ann_hnsw._search
    monkeypatch.setattr(ann_hnsw, "_search", lambda dim, largest, k, width: widths.append(width) or search(dim, largest, k, width))
    found = ann_hnsw.nearest(df, F.col("vec_id") % 20 == 0, 20, shard_rows=3000).collect()
    assert set(widths) == {ann_hnsw.SEARCH_BEAM}
    least = {}
    for q in range(0, len(x), 20):
        s = (x * x[q]).sum(axis=1)
        s[q] = -np.inf
        least[q] = np.sort(s)[-20]
    assert sum(f.score >= least[f.query_id] for f in found) / (20 * len(least)) >= 0.9


def test_few_and_repeated_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [2.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann_hnsw.nearest(df, F.col("vec_id") % 20 == 0).collect()]
    assert sorted(got) == [(0, 1, 1, 0.5), (0, 2, 2, 0.5)]
    assert ann_hnsw.nearest(df.where("vec_id > 9"), F.lit(True)).collect() == []


def test_automaton_equals_regular_expressions():
    r = random.Random(3)
    globs = tuple("".join(r.choice(["a", "b", "/", ".", "*", "**", "?"]) for _ in range(r.randrange(1, 12))) for _ in range(60))
    as_re = [re.compile("".join({"*": "[^/]*", "**": "(?s:.*)", "?": "[^/]"}.get(p, re.escape(p)) for p in re.findall(r"\*\*|.", g))) for g in globs]
    texts = ["".join(r.choice("ab/.") for _ in range(r.randrange(0, 25))) for _ in range(300)]
    a = url_automaton.Automaton(globs)
    assert a.words > 1
    got = a.match([t.encode() for t in texts])
    assert got.tolist() == [[bool(p.fullmatch(t)) for p in as_re] for t in texts]


@pytest.mark.parametrize("url, host, path, rule, verdict", [
    (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("no scheme/x.org/", "", "", None, "allow"), ("http://x.org", "x.org", "", None, "allow"),
    ("http://A.Example.ORG/es/x?q#f", "a.example.org", "/es/x", "example.org/es/", "block"), ("http://example.org/en/1", "example.org", "/en/1", "example.org/en/1", "block"),
    ("http://example.org/EN/1", "example.org", "/EN/1", "org/", "allow"), ("s://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"), ("s://org/x", "org", "/x", "org/", "allow"),
    ("https://casino-win.com/fr/1", "casino-win.com", "/fr/1", "com/fr/", "allow"), ("https://casino-win.net/1", "casino-win.net", "/1", None, "block"),
    ("http://a.com/x.org/", "a.com", "/x.org/", None, "allow"), ("http://b.com?u=http://x.org/", "b.com", "", None, "allow"), ("http://a.com/de/" + "y" * 5000, "a.com", "/de/" + "y" * 5000, "com/de/", "block"),
])
def test_urls(spark, url, host, path, rule, verdict):
    df = spark.createDataFrame([(1, url, "h", "x")], "page_id long, url string, host string, path string")
    (r,) = url_automaton.judge(df).collect()
    assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)


def pairs_by_hand(turns):
    def render(t):
        return f"<|{t[0]}|>\n{t[1]}\n<|end|>\n"

    out = {}
    for pair in {c // 2 for c in turns}:
        a, b = turns.get(2 * pair), turns.get(2 * pair + 1)
        if a is None or b is None:
            continue
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        if n == len(a) == len(b):
            n -= 1
        prompt = "".join(map(render, a[:n]))
        out[pair] = (prompt, *("".join(map(render, x[n:])) for x in (a, b)))
    return out


def test_preference_pairs(spark):
    r = random.Random(6)
    turns = {}
    for c in range(60):
        if c % 11 == 5:
            continue
        n = r.randrange(1, 6)
        turns[c] = [(("user", "assistant")[k % 2], r.choice(["", "a", "bb", "ccc"]) if k else "hi") for k in range(n)]
        if c % 2 and c % 3 == 0 and c - 1 in turns:
            turns[c] = [*turns[c - 1][: r.randrange(1, len(turns[c - 1]) + 1)]]
    rows = [(c, k, role, text if text else None, 0, "p") for c, ts in turns.items() for k, (role, text) in enumerate(ts)]
    df = spark.createDataFrame([*rows, (None, 0, "user", "x", 0, "p")], "conv_id long, turn long, role string, text string, pos int, part string")
    got = {}
    for x in sorted(chat_preference.format_pairs(df, chat_preference.neighbours(df)).collect(), key=lambda x: (x.pair_id, x.pos)):
        parts = got.setdefault(x.pair_id, {"prompt": "", "chosen": "", "rejected": ""})
        before = len(parts["prompt"]) + (len(parts[x.part]) if x.part != "prompt" else 0)
        assert (x.begin, x.finish) == (before, before + len(x.rendered))
        assert x.train == (x.part != "prompt" and x.role == "assistant")
        parts[x.part] += x.rendered
    assert {k: tuple(v.values()) for k, v in got.items()} == pairs_by_hand(turns)
    assert chat_preference.format_pairs(df.limit(0), chat_preference.neighbours(df.limit(0))).collect() == []
    assert chat_preference.unpaired(chat_preference.neighbours(df)).count() > 0


def test_neighbours_of_large_numbers(spark):
    ids = [0, 1, 2**53 + 2, 2**53 + 3, 2**62, 2**62 + 1, -2, -1]
    df = spark.createDataFrame([(i, 0, "user", "x") for i in ids], "conv_id long, turn long, role string, text string")
    got = {(r.chosen_id, r.rejected_id) for r in chat_preference.neighbours(df).collect()}
    assert got == {(0, 1), (2**53 + 2, 2**53 + 3), (2**62, 2**62 + 1), (-2, -1)}


def test_swapped_answers_share_a_prompt(spark, sf_small):
    turns = spark.createDataFrame(
        [(0, 0, "user", "q"), (0, 1, "assistant", "a0"), (0, 2, "user", "thanks"), (1, 0, "system", "s"), (1, 1, "user", "p"), (1, 2, "assistant", "a1"), (2, 0, "user", "no answer"), (4, 5, "assistant", None), (5, 0, "assistant", "")],
        "conv_id long, turn long, role string, text string",
    )
    pairs, rejected = chat_preference.answers_swapped(turns)
    rows = chat_preference.format_pairs(turns, pairs, rejected).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r.pair_id, r.pos)):
        by.setdefault((r.pair_id, r.part), []).append((r.role, r.rendered.split("\n")[1], r.train))
    assert by == {
        (0, "prompt"): [("user", "q", False)], (0, "chosen"): [("assistant", "a0", True), ("user", "thanks", False)], (0, "rejected"): [("assistant", "a1", True)],
        (1, "prompt"): [("system", "s", False), ("user", "p", False)], (1, "chosen"): [("assistant", "a1", True)], (1, "rejected"): [("assistant", "a0", True)],
        (4, "chosen"): [("assistant", "", True)], (4, "rejected"): [("assistant", "", True)], (5, "chosen"): [("assistant", "", True)], (5, "rejected"): [("assistant", "", True)],
    }
    whole = spark.read.parquet(f"{sf_small}/conversations.parquet")
    pairs, rejected = chat_preference.answers_swapped(whole)
    assert chat_preference.format_pairs(whole, pairs, rejected).where("part = 'prompt'").count() > 20
