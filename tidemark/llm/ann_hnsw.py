"""Nearest neighbours by hierarchical navigable small-world graphs, one for each shard.

Rows are dealt into shards of about ``SHARD_ROWS`` rows by a hash of their id. A task builds the graph
of a shard: every vector gets a random top level (from its id), is linked on each level to diverse
near vectors found by beam search, and links are kept as flat arrays of row numbers. The graphs are
written to the shared folder as one row a shard, so a lost executor costs the shards it was building.
Queries, in blocks, meet every shard; each shard gives its best ``k``, and the best of all shards win. A task
reads a shard's index once for ``TASK_BLOCKS`` blocks, which follow it one by one, so what is moved is in
proportion to queries times shards, as it must be, and hardly more.

How wide a beam has to be depends on the vectors. So ``SAMPLE`` queries are compared with exact search, and the
beam is widened until ``RECALL`` of their neighbours are found; a beam as wide as a shard finds all.

Nearness is the inner product. Vectors get one more component, ``sqrt(M^2 - |x|^2)`` with M the largest
norm of the table, which makes the largest inner product the smallest distance, whatever the norms.
The graph works in single precision; what it finds is scored anew in double precision from the
vectors as stored.

Equal vectors are one vertex of a shard, with the ids in order, so a vector that a third of all rows
share neither tears the graph nor fills its beams; a vertex hands out its ``k + 1`` smallest ids, which
is all that can be among a query's nearest. Vectors that are null, empty, zero, of another length than
most, or hold null or non-finite components take no part, as rows or as queries. Of rows
that repeat a vec_id the one with the least vector counts. With fewer than k candidates a query gets all
that are found; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stored, only, ship

SHARD_ROWS = 8192
QUERY_BLOCK = 1024
#: Blocks of queries for which a task reads an index, and the most tasks of a search.
TASK_BLOCKS, MOST_TASKS = 16, 100_000
#: Queries by which the beam is set, and the share of their nearest rows that has to be found.
SAMPLE, RECALL = 64, 0.96
#: Links of a vertex on the upper levels; twice as many on the lowest.
LINKS = 12
BUILD_BEAM = 80
#: The first beam that is tried; each next one is twice as wide.
SEARCH_BEAM = 96


class Graph:
    """Flat neighbour arrays: ``near[level][row]`` holds row numbers, -1 where there are fewer."""

    def __init__(self, points: np.ndarray, levels: np.ndarray, near: list[np.ndarray], top: int):
        self.points, self.levels, self.near, self.top = points, levels, near, top
        self.seen = np.zeros(len(points), np.int32)
        self.turn = 0

    def _distance(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        d = self.points[rows] - q
        return np.einsum("ij,ij->i", d, d)

    def beam(self, q: np.ndarray, start: list[tuple[float, int]], width: int, level: int) -> list[tuple[float, int]]:
        """The nearest ``width`` rows that a best-first walk from ``start`` meets, nearest first."""
        self.turn += 1
        seen, turn, near, points = self.seen, self.turn, self.near[level], self.points
        todo = list(start)
        heapq.heapify(todo)
        best = [(-d, r) for d, r in start]
        heapq.heapify(best)
        for _, r in start:
            seen[r] = turn
        push, pop, replace = heapq.heappush, heapq.heappop, heapq.heapreplace
        while todo:
            d, r = pop(todo)
            worst = -best[0][0]
            if d > worst and len(best) >= width:
                break
            rows = near[r]
            rows = rows[rows >= 0]
            rows = rows[seen[rows] != turn]
            if not len(rows):
                continue
            seen[rows] = turn
            diff = points[rows] - q
            away = np.einsum("ij,ij->i", diff, diff)
            full = len(best) >= width
            if full:
                ok = away < worst
                rows, away = rows[ok], away[ok]
            for x, y in zip(away.tolist(), rows.tolist(), strict=True):
                if len(best) < width:
                    push(best, (-x, y))
                    push(todo, (x, y))
                elif x < -best[0][0]:
                    replace(best, (-x, y))
                    push(todo, (x, y))
        return sorted((-d, r) for d, r in best)

    def descend(self, q: np.ndarray, to: int) -> list[tuple[float, int]]:
        """The nearest row found on the levels above ``to``."""
        at = [(float(self._distance(np.array([self.top]), q)[0]), self.top)]
        for level in range(int(self.levels[self.top]), to, -1):
            at = self.beam(q, at, 1, level)
        return at

    def search(self, q: np.ndarray, width: int) -> np.ndarray:
        return np.array([r for _, r in self.beam(q, self.descend(q, 0), width, 0)], np.int64)


def _diverse(points: np.ndarray, found: list[tuple[float, int]], most: int) -> list[int]:
    """Near rows that are nearer to the vertex than to each other; the nearest others fill up."""
    if len(found) <= most:
        return [r for _, r in found]
    rows = np.array([r for _, r in found])
    d = np.array([x for x, _ in found])
    p = points[rows]
    squares = (p * p).sum(axis=1)
    between = squares[:, None] + squares[None, :] - 2 * (p @ p.T)
    kept: list[int] = []
    blocked = np.zeros(len(rows), bool)
    for i in range(len(rows)):
        if not blocked[i]:
            kept.append(i)
            if len(kept) == most:
                break
            blocked |= between[i] < d
    if len(kept) < most:
        used = set(kept)
        kept += [i for i in range(len(rows)) if i not in used][: most - len(kept)]
    return rows[kept].tolist()


def build(points: np.ndarray, seed: int) -> Graph:
    """Inserts all points, in an order and on levels that depend on the seed alone."""
    n = len(points)
    random = np.random.default_rng(seed)
    levels = np.minimum((-np.log(1 - random.random(n)) / np.log(LINKS)).astype(int), 12)
    most = [2 * LINKS if lv == 0 else LINKS for lv in range(int(levels.max()) + 1)]
    near = [np.full((n if lv == 0 else n, m), -1, np.int32) for lv, m in enumerate(most)]
    order = random.permutation(n)
    g = Graph(points, levels, near, int(order[0]))
    for r in order[1:].tolist():
        q, own = points[r], int(levels[r])
        at = g.descend(q, own) if own < levels[g.top] else [(float(g._distance(np.array([g.top]), q)[0]), g.top)]
        for level in range(min(own, int(levels[g.top])), -1, -1):
            at = g.beam(q, at, BUILD_BEAM, level)
            links = _diverse(points, at, LINKS)
            near[level][r, : len(links)] = links
            m = most[level]
            for x in links:
                other = near[level][x]
                free = int((other >= 0).sum())
                if free < m:
                    other[free] = r
                else:
                    rows = np.append(other, r)
                    d = g._distance(rows, points[x])
                    by = np.argsort(d, kind="stable")
                    near[level][x] = _diverse(points, list(zip(d[by].tolist(), rows[by].tolist(), strict=True)), m)
        if own > levels[g.top]:
            g.top = r
    return g


_INDEX = "shard int, size int, width int, top int, vectors binary, levels binary, links binary, ids binary, ends binary"


def _index(dim: int, largest: float):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        x = np.array(table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order] + 0.0
        distinct, first, of = np.unique(x, axis=0, return_index=True, return_inverse=True)
        by = np.argsort(of.ravel(), kind="stable")
        ends = np.cumsum(np.bincount(of.ravel(), minlength=len(distinct)))
        norm = np.maximum(largest**2 - (distinct**2).sum(axis=1), 0)
        points = np.hstack([distinct, np.sqrt(norm)[:, None]]).astype(np.float32)
        g = build(points, int(key[0].as_py()) + 17)
        upper = np.hstack([a for a in g.near]).astype(np.int32)
        return pa.table({
            "shard": pa.array([key[0].as_py()], pa.int32()), "size": pa.array([len(distinct)], pa.int32()), "width": pa.array([upper.shape[1]], pa.int32()), "top": pa.array([g.top], pa.int32()),
            "vectors": pa.array([distinct.tobytes()], pa.binary()), "levels": pa.array([g.levels.astype(np.int32).tobytes()], pa.binary()), "links": pa.array([upper.tobytes()], pa.binary()),
            "ids": pa.array([ids[by].tobytes()], pa.binary()), "ends": pa.array([ends.astype(np.int64).tobytes()], pa.binary()),
        })

    return run


def _load(row: dict, dim: int, largest: float) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, dim)
    points = np.hstack([vectors, np.sqrt(np.maximum(largest**2 - (vectors**2).sum(axis=1), 0))[:, None]]).astype(np.float32)
    links = np.frombuffer(row["links"], np.int32).reshape(row["size"], row["width"])
    levels = np.frombuffer(row["levels"], np.int32)
    near = [links[:, : 2 * LINKS]] + [links[:, at : at + LINKS] for at in range(2 * LINKS, row["width"], LINKS)]
    near = [np.ascontiguousarray(a) for a in near]
    return Graph(points, levels, near, row["top"]), vectors, np.frombuffer(row["ids"], np.int64), np.frombuffer(row["ends"], np.int64)


def _search(dim: int, largest: float, k: int, width: int):
    """Rows come sorted by task: a shard's index and then blocks of queries for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            for row in b.to_pylist():
                if row["q_ids"] is None:
                    held = _load(row, dim, largest)
                    continue
                g, vectors, ids, ends = held
                queries = np.array(row["q_vectors"], np.float64).reshape(-1, dim)
                out_q, out_v, out_s = [], [], []
                for own, q in zip(row["q_ids"], queries, strict=True):
                    rows = g.search(np.append(q, 0).astype(np.float32), width)
                    # Component by component, so that a pair has the same score in every block.
                    score = (vectors[rows] * q).sum(axis=1)
                    near: list[tuple[float, int]] = []
                    for r, s in zip(rows.tolist(), score.tolist(), strict=True):
                        first = int(ends[r - 1]) if r else 0
                        near += [(-s, int(i)) for i in ids[first : min(int(ends[r]), first + k + 1)] if i != own]
                    near = heapq.nsmallest(k, near)
                    out_q += [own] * len(near)
                    out_v += [i for _, i in near]
                    out_s += [-s for s, _ in near]
                yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(out_v, pa.int64()), pa.array(out_s, pa.float64())], names=["query_id", "vec_id", "score"])

    return run


def _exact(ids: np.ndarray, queries: np.ndarray, k: int):
    """The nearest rows of a task for each query, by looking at all of them; scores and ties as in ``_search``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.empty(0), np.empty(0, np.int64)) for _ in ids]
        for b in batches:
            if not b.num_rows:
                continue
            own = b.column(0).to_numpy()
            x = np.array(b.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(b.num_rows, -1)
            for i, (query, q) in enumerate(zip(ids, queries, strict=True)):
                score, other = (x * q).sum(axis=1), own != query
                score, whose = np.concatenate((best[i][0], score[other])), np.concatenate((best[i][1], own[other]))
                first = np.lexsort((whose, -score))[:k]
                best[i] = score[first], whose[first]
        many = [len(s) for s, _ in best]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, many)), pa.array(np.concatenate([w for _, w in best])), pa.array(np.concatenate([s for s, _ in best]))], names=["query_id", "vec_id", "score"])

    return run


_FOUND = "query_id long, vec_id long, score double"


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _blocks(asked: DataFrame, blocks: int) -> DataFrame:
    """Queries in blocks by a hash of their id, a row each: block, q_ids, q_vectors."""
    block = asked.groupBy(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list(F.struct("vec_id", "v")).alias("q"))
    return block.select("block", F.col("q.vec_id").alias("q_ids"), F.flatten("q.v").alias("q_vectors"))


def _found(index: DataFrame, shards: int, block: DataFrame, blocks: int, search) -> DataFrame:
    """What all shards find for all blocks of queries."""
    chunks = -(-blocks // TASK_BLOCKS)
    task = F.col("shard").cast("long") * chunks + F.col("chunk")
    sent = block.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.floor(F.col("block") / TASK_BLOCKS).cast("int").alias("chunk"), "*")
    read = index.select(F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "*")
    laid = read.unionByName(sent, allowMissingColumns=True).withColumn("task", task)
    tasks = min(shards * chunks, MOST_TASKS)
    laid = laid.repartitionById(tasks, F.pmod("task", F.lit(tasks)).cast("int")).sortWithinPartitions("task", F.col("block").asc_nulls_first())
    return laid.select("size", "width", "top", "vectors", "levels", "links", "ids", "ends", "q_ids", "q_vectors").mapInArrow(search, _FOUND)


def sound(vectors: DataFrame) -> tuple[DataFrame, int, float, int]:
    """Vectors that take part, their number of components, the largest norm and how many they are."""
    v = F.col("embedding").cast("array<double>")
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    good = only(vectors, "vec_id", "embedding").select("vec_id", v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0").where(whole)
    lengths = good.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if lengths is None:
        return good, 0, 0.0, 0
    dim = lengths["d"]
    good = good.where(F.size("v") == dim)
    rows = good.agg(F.count("vec_id"), F.count_distinct("vec_id")).first()
    if rows[0] != rows[1]:
        good = good.groupBy("vec_id").agg(F.min("v").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return good, dim, good.agg(F.max(norm)).first()[0], rows[1]


def nearest(vectors: DataFrame, queries: Column, k: int = 20, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows found for each row where ``queries`` holds."""
    spark = vectors.sparkSession
    ship(spark)
    good, dim, largest, n = sound(vectors)
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shards = -(-n // shard_rows)
    store = Stored(spark, "hnsw")
    dealt = good.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    # Range partitions by shard number: one shard a task, where a hash would double some up.
    index = store.keep(dealt.repartitionByRange(shards, "shard").groupBy("shard").applyInArrow(_index(dim, largest), _INDEX), "index")
    asked = good.where(queries)
    many = asked.count()
    width = beam_width(good, asked, index, shards, dim, largest, k, shard_rows)
    blocks = max(1, -(-many // QUERY_BLOCK))
    block = store.keep(_blocks(asked, blocks), "queries")
    return _best(_found(index, shards, block, blocks, _search(dim, largest, k, width)), k)


def beam_width(good: DataFrame, asked: DataFrame, index: DataFrame, shards: int, dim: int, largest: float, k: int, shard_rows: int) -> int:
    """The first width at which a sample of the queries gets ``RECALL`` of its nearest rows."""
    sample = asked.orderBy(F.xxhash64("vec_id", F.lit(9)), "vec_id").limit(SAMPLE).collect()
    width = max(SEARCH_BEAM, 3 * k)
    if not sample:
        return width
    ids, vectors = np.array([r["vec_id"] for r in sample], np.int64), np.array([r["v"] for r in sample], np.float64)
    exact = _best(good.mapInArrow(_exact(ids, vectors, k), _FOUND), k).groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).collect()
    # Rows that tie with the last of the nearest are as near, whichever of them are found.
    least, want = {r["query_id"]: r["least"] for r in exact}, sum(r["n"] for r in exact)
    block = _blocks(good.sparkSession.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, vectors, strict=True)], "vec_id long, v array<double>"), 1)
    while width < 2 * shard_rows:
        got = _best(_found(index, shards, block, 1, _search(dim, largest, k, width)), k).select("query_id", "score").collect()
        if sum(r["score"] >= least[r["query_id"]] for r in got) >= RECALL * want:
            break
        width *= 2
    return width
