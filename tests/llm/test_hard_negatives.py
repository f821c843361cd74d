import math
import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import hard_negatives
from tidemark.llm.queries import queries

NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
SCHEMA = "vec_id long, embedding array<double>, label int, id string, v long, LABEL string"


def plain(rows, every, k=3):
    """The contract word by word, over all pairs."""
    good = {}
    for i, v, label in sorted((r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[0], str(r[2]), r[1])):
        good.setdefault(i, ([math.floor(256 * x) for x in v], label))
    out = []
    for a, (v, label) in good.items():
        if a % every:
            continue
        scores = sorted(((-sum(x * y for x, y in zip(v, w)), i, other) for i, (w, other) in good.items() if i != a), key=lambda t: t[:2])
        for p, positive, _ in [s for s in scores if s[2] == label][:5]:
            near = [(s, i) for s, i, other in scores if other != label and -50 * p <= -100 * s <= -95 * p][:k]
            out += [(a, positive, n + 1, i, -p, -s) for n, (s, i) in enumerate(near)]
    return sorted(out)


def found(df, every, **more):
    return sorted(tuple(r[c] for c in NAMES) for r in hard_negatives.mine(df, F.col("vec_id") % every == 0, **more).collect())


def test_blocks_of_rows_and_anchors_equal_all_pairs(spark, monkeypatch):
    r = np.random.default_rng(2)
    centre = r.normal(size=(6, 12))
    rows = []
    for i in range(700):
        label = 0 if r.random() < 0.4 else int(r.integers(6))
        v = centre[label] + r.normal(size=12) * 1.2
        rows.append((i - 20, [round(float(x), 2) for x in v], label))
    rows += [(1000 + i, [0.5] * 12, i % 6) for i in range(300)]  # one vector on very many rows: ties
    rows += [(2000, None, 1), (2050, [None] * 12, 1), (2100, [float("nan")] * 12, 1), (2150, [1.0] * 12, None), (None, [1.0] * 12, 1), (2200, [], 2), (2250, [0.0] * 12, 2), (2300, [1.0, -2.0], 3), (2301, [1e300] * 12, 3)]
    rows += [(5, [9.0] * 12, 0), (5, [9.0] * 12, 0)]
    df = spark.createDataFrame([(*x, "c", 1, "L") for x in rows], SCHEMA).repartition(4)
    huge = hard_negatives.MOST_SCORE
    want = [t for t in plain([x for x in rows if x[0] != 2301], 50)]
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 7)
    got = found(df.where("vec_id <> 2301 or vec_id is null"), 50, row_block=64)
    assert got == want and len(want) > 100
    assert all(abs(t[4]) <= huge and abs(t[5]) <= huge for t in found(df, 50, row_block=64))


def test_scores_are_exact_at_any_size():
    r = random.Random(1)
    for size in (1, 2**24, 2**30, 2**50):
        a, b = ([[r.randrange(-size, size) for _ in range(8)] for _ in range(5)] for _ in range(2))
        x, y = np.array(a, float), np.array(b, float)
        want = [[max(-hard_negatives.MOST_SCORE, min(hard_negatives.MOST_SCORE, sum(int(p) * int(q) for p, q in zip(u, w)))) for w in y.tolist()] for u in x.tolist()]
        assert hard_negatives._scores(x, y).tolist() == want


def test_limits_are_exact_for_every_sign():
    limits = hard_negatives.Limits(50, 95)
    for p in range(-60, 60):
        low, high = limits.of(p)
        assert [n for n in range(-100, 100) if 50 * p <= 100 * n <= 95 * p] == list(range(low, high + 1))


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0], 1), (50, [1.0], 2), (51, [0.9], 2), (52, [0.7], 3)], "vec_id long, embedding array<float>, label int")
    assert found(df, 50) == plain([(0, [1.0], 1), (50, [1.0], 2), (51, [float(np.float32(0.9))], 2), (52, [float(np.float32(0.7))], 3)], 50)
    assert found(df.where("vec_id > 99"), 50) == [] and found(df, 99999) == []


def test_query_on_the_table(spark, sf_small):
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{sf_small}/embeddings.parquet").collect()]
    assert sorted(tuple(r[c] for c in NAMES) for r in queries()["op12_hard_negatives"](spark, sf_small).collect()) == plain(rows, 50)
