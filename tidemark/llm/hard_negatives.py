"""Hard negatives for contrastive training: rows of another label that score nearly as high as a positive.

A component x counts as the whole number ``floor(scale * x)``, so a score (an inner product of two such vectors) is
a whole number and means the same in every block and on every machine. For each anchor all rows are scored and sorted
by (-score, id). The first ``positives`` rows of the anchor's label are its positives. In the same order, a binary search finds
where scores fall to a positive's upper limit, and the next ``k`` rows of other labels are read there, as long as they are
above its lower limit.

Rows go in blocks of ``ROW_BLOCK`` and anchors in blocks of at most ``ANCHOR_BLOCK``; a task holds one block of
anchors and reads blocks of rows one by one. It sorts an anchor's scores block by block and keeps the first few, so that
neither a label nor a score that a third of all rows share is ever gathered: a task gives out at most ``positives``
rows an anchor, or ``k`` a positive, and the firsts of all tasks are merged. Scores are computed twice, once to
find positives and once to find negatives, rather than stored. The work is anchors times rows, as the question is.

Rows with a null id, label or vector, or any null or non-finite component, take no part. Shorter vectors count as
followed by zeros; empty and zero vectors take part, with scores of 0. Of rows that repeat an id the one with the least
label, then vector, counts. Ties go to the smaller id. Components beyond 2^60 and scores beyond 2^56, up or down, count
as that. Without another row of its label an anchor has no positive, and gives no row; an empty table gives an
empty table. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stored, only, ship, tidy

ROW_BLOCK = 1024
#: Anchors that a task holds, less where vectors are long: at most so many bytes of them.
ANCHOR_BLOCK, ANCHOR_BYTES = 4096, 32 << 20
#: Blocks of rows that a task reads, and the most tasks.
TASK_BLOCKS, MOST_TASKS = 8, 100_000
#: Scores that are sorted together.
SORTED = 1 << 19
#: Components and scores beyond these, up or down, count as these.
MOST_COMPONENT, MOST_SCORE = 2.0**60, 2**56


def _whole(vectors: pa.ListArray, dim: int, scale: float) -> np.ndarray:
    """Whole numbers, as doubles, with zeros after short vectors."""
    flat, sizes = vectors.flatten().to_numpy(zero_copy_only=False), vectors.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(vectors), dim))
    out[np.arange(dim) < sizes[:, None]] = flat
    with np.errstate(over="ignore"):
        return np.clip(np.floor(out * scale), -MOST_COMPONENT, MOST_COMPONENT)


def _scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products: of doubles or longs where no sum can pass what these hold, else of Python's numbers."""
    high = [np.abs(x).max(axis=1, initial=0) * max(1, x.shape[1]) ** 0.5 for x in (anchors, rows)]
    most = high[0].max(initial=0) * high[1].max(initial=0)
    if most < 2**52:
        return (anchors @ rows.T).astype(np.int64)
    out = anchors.astype(np.int64) @ rows.astype(np.int64).T
    for i, j in np.argwhere(high[0][:, None] * high[1] >= 2**62):
        out[i, j] = max(-MOST_SCORE, min(MOST_SCORE, sum(int(x) * int(y) for x, y in zip(anchors[i], rows[j], strict=True))))
    return np.clip(out, -MOST_SCORE, MOST_SCORE)


def _order(scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each anchor its rows by (-score, id)."""
    return np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)


class Limits:
    """Scores of negatives, in hundredths of the positive's score: least to most."""

    def __init__(self, least: int, most: int):
        self.least, self.most = least, most

    def of(self, positive: int) -> tuple[int, int]:
        """The lowest and the highest whole score within the limits."""
        return -((-self.least * positive) // 100), self.most * positive // 100


def _first(kept: dict, key: tuple, found: list[tuple[int, int]], k: int) -> None:
    """Keeps the first ``k`` by (-score, id) of what was kept for a key and what is found."""
    old = kept.get(key)
    kept[key] = found if old is None else sorted(old + found, key=lambda t: (-t[0], t[1]))[:k]


def _positives(k: int):
    def found(own: int, same: np.ndarray, positives: list, scores: np.ndarray, ids: np.ndarray, order: np.ndarray, kept: dict) -> None:
        at = order[same[order] & (ids[order] != own)][:k]
        _first(kept, (own, None, None), list(zip(scores[at].tolist(), ids[at].tolist(), strict=True)), k)

    return found


def _negatives(k: int, limits: Limits):
    def found(own: int, same: np.ndarray, positives: list, scores: np.ndarray, ids: np.ndarray, order: np.ndarray, kept: dict) -> None:
        other = order[~same[order]]
        falling = -scores[other]
        for positive, score in positives:
            low, high = limits.of(score)
            at = int(np.searchsorted(falling, -high))
            read = [j for j in other[at : at + k] if scores[j] >= low]
            _first(kept, (own, positive, score), [(int(scores[j]), int(ids[j])) for j in read], k)

    return found


_FOUND = "anchor_id long, positive_id long, positive_score long, row_id long, score long"


def _search(dim: int, scale: float, look):
    """Rows come sorted by task: a block of anchors, then blocks of rows for it. A block of anchors without any, or without
    positives, doesn't come, and its rows are passed over."""

    def given(kept: dict) -> Iterator[pa.RecordBatch]:
        rows = [(*key, i, s) for key, found in kept.items() for s, i in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["anchor_id", "positive_id", "positive_score", "row_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_task, held, kept = None, None, {}
        for batch in batches:
            for r in range(batch.num_rows):
                task, is_anchors = batch.column("task")[r].as_py(), batch.column("anchors")[r].as_py()
                if not is_anchors and task != of_task:
                    continue
                ids, labels = batch.column("ids")[r].as_py(), batch.column("labels")[r].as_py()
                vectors = _whole(batch.column("vectors")[r].values, dim, scale)
                if is_anchors:
                    yield from given(kept)
                    positives = [[(p["id"], p["score"]) for p in own or ()] for own in batch.column("positives")[r].as_py()]
                    of_task, held, kept = task, (ids, labels, positives, vectors), {}
                    continue
                ids, (distinct, code) = np.array(ids, np.int64), np.unique(np.array(labels), return_inverse=True)
                of = {x: i for i, x in enumerate(distinct.tolist())}
                step = max(1, SORTED // len(ids))
                for low in range(0, len(held[0]), step):
                    scores = _scores(held[3][low : low + step], vectors)
                    order = _order(scores, ids)
                    for own, label, positives, s, o in zip(*(x[low : low + step] for x in held[:3]), scores, order, strict=True):
                        look(own, code == of.get(label, -1), positives, s, ids, o, kept)
        yield from given(kept)

    return tidy(run)


def _blocked(rows: DataFrame, blocks: int, anchors: bool) -> DataFrame:
    """Rows in blocks by a hash of their id: block, ids, labels, vectors, positives, anchors (are they?)."""
    block = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(blocks)).cast("int").alias("block")
    packed = rows.groupBy(block).agg(F.collect_list(F.struct("id", "label", "v", "positives")).alias("r"))
    return packed.select("block", F.col("r.id").alias("ids"), F.col("r.label").alias("labels"), F.col("r.v").alias("vectors"), F.col("r.positives").alias("positives"), F.lit(anchors).alias("anchors"))


def _met(rows: DataFrame, row_blocks: int, anchors: DataFrame, anchor_blocks: int, search) -> DataFrame:
    """What all blocks of rows hold for all blocks of anchors."""
    chunks = -(-row_blocks // TASK_BLOCKS)
    sent = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.col("block").alias("of"), "*")
    read = rows.select(F.floor(F.col("block") / TASK_BLOCKS).cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(anchor_blocks - 1))).alias("of"), "*")
    laid = sent.unionByName(read).withColumn("task", F.col("of").cast("long") * chunks + F.col("chunk"))
    tasks = min(anchor_blocks * chunks, MOST_TASKS)
    laid = laid.repartitionById(tasks, F.pmod("task", F.lit(tasks)).cast("int")).sortWithinPartitions("task", F.desc("anchors"), "block")
    return laid.select("task", "ids", "labels", "vectors", "positives", "anchors").mapInArrow(search, _FOUND)


def _sound(vectors: DataFrame, label: Column) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    own = only(vectors, "vec_id", "embedding", "label").select(F.col("vec_id").cast("long").alias("id"), label.cast("string").alias("label"), v.alias("v"))
    good = own.where("id is not null and label is not null and v is not null").where(whole)
    rows = good.agg(F.count("id"), F.count_distinct("id")).first()
    if rows[0] == rows[1]:
        return good
    return good.groupBy("id").agg(F.min(F.struct("label", "v")).alias("least")).select("id", "least.label", "least.v")


def mine(vectors: DataFrame, anchors: Column, label: Column | None = None, positives: int = 5, k: int = 3, scale: float = 256.0, least: int = 50, most: int = 95, row_block: int = ROW_BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors`` tells by vec_id which rows are anchors. ``label`` is what rows are told apart by, the column of that name
    if not given. Scores of negatives lie between ``least`` and ``most`` hundredths of the positive's.
    """
    spark = vectors.sparkSession
    ship(spark)
    store = Stored(spark, "hard-negatives")
    good = store.keep(_sound(vectors, F.col("label") if label is None else label), "rows")
    n, dim = good.agg(F.count("id"), F.max(F.size("v"))).first()
    asked = good.withColumnRenamed("id", "vec_id").where(anchors).withColumnRenamed("vec_id", "id")
    many = asked.count() if n else 0
    if not many:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    none = F.lit(None).cast("array<struct<id:bigint,score:bigint>>").alias("positives")
    row_blocks = -(-n // row_block)
    rows = store.keep(_blocked(good.select("*", none), row_blocks, False), "row_blocks")
    anchor_blocks = -(-many // max(1, min(ANCHOR_BLOCK, ANCHOR_BYTES // (8 * max(1, dim)))))
    near = _met(rows, row_blocks, _blocked(asked.select("*", none), anchor_blocks, True), anchor_blocks, _search(dim, scale, _positives(positives)))
    by = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "row_id")
    best = near.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= positives)
    own = best.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct(F.col("row_id").alias("id"), "score")).alias("positives"))
    told = store.keep(_blocked(asked.join(own, "id"), anchor_blocks, True), "anchor_blocks")
    found = _met(rows, row_blocks, told, anchor_blocks, _search(dim, scale, _negatives(k, Limits(least, most))))
    by = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "row_id")
    ranked = found.withColumn("rank", F.row_number().over(by).cast("int")).where(F.col("rank") <= k)
    return ranked.select("anchor_id", "positive_id", "rank", F.col("row_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
