"""Neighbour trees, components, spanning forests and the tree of clusters against plain Python."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.operators import density, graph, neighbours


def find(up, x):
    while up.setdefault(x, x) != x:
        up[x] = up[up[x]]
        x = up[x]
    return x


def kruskal(edges):
    up, out = {}, []
    for w, a, b in sorted(edges):
        if find(up, a) != find(up, b):
            up[max(find(up, a), find(up, b))] = min(find(up, a), find(up, b))
            out.append((w, a, b))
    return out


def test_components_of_chains_hubs_and_layers(spark):
    r = random.Random(3)
    edges = [(i, i + 1, 0) for i in range(60)] + [(500, i, 0) for i in range(501, 700)] + [(r.randrange(1000, 1300), r.randrange(1000, 1300), 0) for _ in range(200)]
    edges += [(i, i + 2, 1) for i in range(40)] + [(7, 7, 1)]
    df = spark.createDataFrame(edges, "a long, b long, layer int")
    got = {(x.layer, x.node): x.root for x in graph.components(df, "layer").collect()}
    for layer in (0, 1):
        up = {}
        for a, b, of in edges:
            if of == layer and a != b:
                a, b = find(up, a), find(up, b)
                up[max(a, b)] = min(a, b)
        assert {k[1]: v for k, v in got.items() if k[0] == layer} == {x: find(up, x) for x in list(up)}
    assert graph.components(df.where("a = b")).collect() == []


def test_spanning_forest_with_ties(spark):
    r = random.Random(5)
    edges = [(r.randrange(80), r.randrange(80), float(r.randrange(6))) for _ in range(300)] + [(200, 201, 1.0)]
    df = spark.createDataFrame(edges, "a long, b long, weight double")
    got = sorted((x.weight, x.a, x.b) for x in graph.spanning_forest(df).collect())
    assert got == sorted(kruskal({(w, min(a, b), max(a, b)) for a, b, w in edges if a != b}))
    assert graph.spanning_forest(df.where("a = b")).collect() == []


def test_neighbours_are_exact_in_a_leaf_and_near_in_a_forest(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(40, 12))[r.integers(0, 40, 1500)] + r.normal(size=(1500, 12)) * 0.3
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(1500)], "id long, v array<double>")
    away = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(away, np.inf)
    want = np.argsort(away, axis=1, kind="stable")[:, :8]
    for leaf, least in ((2000, 1.0), (200, 0.9)):
        got = defaultdict(set)
        for e in neighbours.nearest(df, 8, leaf=leaf).collect():
            got[e.id].add(e.other)
            assert abs(e.distance - away[e.id, e.other]) < 1e-9
        assert all(len(g) == 8 for g in got.values()) and len(got) == 1500
        assert sum(len(got[i] & set(want[i].tolist())) for i in range(1500)) / 12_000 >= least
    sizes = [r["count"] for r in neighbours._split(df.selectExpr("id", "v", "0L as grp"), 200, 0).groupBy("grp").count().collect()]
    assert max(sizes) <= 200 and sum(sizes) == 1500


def plain(rows, smallest, samples, k, levels=None):
    """The tree of clusters by recursion over all distances of the forest."""
    weight, point = Counter(v for _, v in rows), {}
    for i, v in sorted(rows):
        point.setdefault(v, i)
    x = {i: np.array(v) for v, i in point.items()}
    weight = {point[v]: n for v, n in weight.items()}
    near = {i: sorted((float(np.sqrt(((x[j] - x[i]) ** 2).sum())), j) for j in x if j != i)[:k] for i in x}
    core = {}
    for i in x:
        rows_in, core[i] = weight[i], 0.0
        for d, j in near[i]:
            if rows_in >= samples:
                break
            rows_in, core[i] = rows_in + weight[j], d
    forest = kruskal({(max(d, core[i], core[j]), min(i, j), max(i, j)) for i in x for d, j in near[i]})
    steps = sorted({w for w, *_ in forest if w > 0})

    def parts(level):
        up = {i: i for i in x}
        for w, a, b in forest:
            if w <= steps[level]:
                a, b = find(up, a), find(up, b)
                up[max(a, b)] = min(a, b)
        out = defaultdict(set)
        for i in x:
            out[find(up, i)].add(i)
        return [s for s in out.values() if sum(weight[i] for i in s) >= smallest]

    alive = [parts(level) for level in range(len(steps))]

    def gain(level):
        return 1 / steps[level] - 1 / steps[min(level + 1, len(steps) - 1)]

    def best(level, part, alone=False):
        """(stability of what is selected, the selected parts) of the cluster that begins at a level."""
        own, at = 0.0, part
        while True:
            own += sum(weight[i] for i in at) * gain(level)
            below = [s for s in alive[level - 1] if s <= at] if level else []
            if len(below) != 1:
                break
            level, at = level - 1, below[0]
        found = [best(level - 1, s) for s in below]
        if own >= sum(v for v, _ in found) and not (alone and found):
            return own, [part]
        return sum(v for v, _ in found), [s for _, chosen in found for s in chosen]

    topic = {}
    for part in alive[-1]:
        for chosen in best(len(steps) - 1, part, len(alive[-1]) == 1)[1]:
            topic |= dict.fromkeys(chosen, min(chosen))
    return {i: topic.get(point[v]) for i, v in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_equal_a_plain_tree(spark, seed):
    r = np.random.default_rng(seed)
    blobs = [r.normal(size=(n, 3)) * s + c for n, s, c in ((30, 0.2, 0), (25, 0.1, 2), (12, 0.05, [2, 2, 3]), (25, 3, 0))]
    rows = [(i, tuple(round(float(y), 3) for y in v)) for i, v in enumerate(np.concatenate(blobs))]
    rows += [(200 + i, (9.0, 9.0, 9.0)) for i in range(12)] + [(300 + i, (9.0, 9.0, 9.1)) for i in range(3)]
    df = spark.createDataFrame([(i, list(v), "x") for i, v in rows] + [(900, None, "x"), (901, [], "x"), (902, [float("nan")] * 3, "x"), (None, [1.0] * 3, "x")], "vec_id long, embedding array<double>, id string")
    got = {t.vec_id: t.topic for t in density.clusters(df, "vec_id", "embedding", smallest=8, samples=4, k=10, levels=500).collect()}
    want = plain(rows, 8, 4, 10)
    assert got == want and len(set(want.values()) - {None}) >= 3 and None in want.values()


def test_a_short_ladder_still_tells_blobs_apart(spark):
    r = np.random.default_rng(7)
    x = np.concatenate([r.normal(size=(60, 8)) * 0.1 + c * 3 for c in np.eye(8)[:4]])
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(len(x))], "vec_id long, embedding array<double>")
    topics = defaultdict(set)
    for t in density.clusters(df, "vec_id", "embedding", levels=12).collect():
        topics[t.topic].add(t.vec_id // 60)
    assert len([t for t in topics if t is not None]) == 4 and all(len(s) == 1 for t, s in topics.items() if t is not None)


def test_few_points(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert {t.topic for t in density.clusters(df, "vec_id", "embedding", smallest=2).collect()} == {1}
    assert density.clusters(df.where("vec_id > 9"), "vec_id", "embedding").collect() == []
