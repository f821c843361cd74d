"""Nearest neighbours of every row by trees of random splits: near rows mostly end up in one leaf, and leaves are small.

A group with more than ``leaf`` rows is split by ``PLANES`` planes, each half way between two of its rows, into up to
2^PLANES groups, until all are leaves; a leaf is searched exactly, by a task for each. Every tree splits anew, and a row's
neighbours are the best of all trees. A table of no more than ``leaf`` rows is one leaf, and its result exact. Rows
must differ (equal ones could not be told apart by any plane); the caller puts them together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import kept

LEAF, TREES, PLANES = 2048, 4, 3
#: Rows of a group among which the ends of planes are drawn, on average.
DRAWN = 64


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _split(rows: DataFrame, leaf: int, seed: int) -> DataFrame:
    """``rows`` (id, v, grp) with groups of at most ``leaf`` rows."""
    for level in range(64):
        sizes = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > leaf)
        sizes = kept(sizes, "sizes")
        if sizes.isEmpty():
            break
        # Ends of planes: the first few by a hash, among those few whose hash is small for the size of their group.
        h = F.xxhash64("id", F.lit(seed), F.lit(level))
        some = rows.join(sizes, "grp").withColumn("h", h).where((F.col("h").cast("double") / 2.0**64 + 0.5) * F.col("size") < DRAWN)
        place = F.row_number().over(Window.partitionBy("grp").orderBy("h", "id"))
        ends = some.withColumn("place", place).where(F.col("place") <= 2 * PLANES)
        ends = ends.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "v"))), lambda x: x["v"]).alias("ends"))
        ends = kept(ends.where(F.size("ends") > 1), "ends")
        bits = F.lit(0)
        for p in range(PLANES):
            a, b = F.get("ends", F.lit(2 * p)), F.get("ends", F.lit(2 * p + 1))
            nearer = _dot(F.col("v"), F.zip_with(a, b, lambda x, y: x - y)) * 2 > _dot(a, a) - _dot(b, b)
            bits = bits + F.when(nearer, F.lit(1 << p)).otherwise(0)
        rows = kept(rows.join(ends, "grp", "left").select("id", "v", F.when(F.col("ends").isNull(), F.col("grp")).otherwise(F.xxhash64("grp", bits)).alias("grp")), "split")
    return rows


def _near(k: int):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by("id")
        ids = table.column("id").to_numpy()
        x = np.array(table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(len(ids), -1)
        for low in range(0, len(ids), 256):
            # Differences rather than products: equal pairs have equal distances in every leaf.
            part = np.arange(low, min(low + 256, len(ids)))
            away = np.stack([np.sqrt(((x - x[i]) ** 2).sum(axis=1)) for i in part])
            away[np.arange(len(part)), part] = np.inf
            order = np.lexsort((np.broadcast_to(ids, away.shape), away), axis=1)[:, : min(k, len(ids) - 1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[part], order.shape[1])), pa.array(ids[order].ravel()), pa.array(np.take_along_axis(away, order, 1).ravel())], names=["id", "other", "distance"])

    return run


def nearest(rows: DataFrame, k: int, leaf: int = LEAF, trees: int = TREES, seed: int = 0) -> DataFrame:
    """id, other, distance: the ``k`` nearest rows found for each of ``rows`` (id long, v array<double>); ties to the
    smaller id."""
    own = kept(rows.select("id", "v"), "vectors")
    if own.count() <= leaf:
        trees = 1
    found = None
    for t in range(trees):
        leaves = _split(own.withColumn("grp", F.lit(0).cast("long")), leaf, seed + t)
        near = leaves.groupBy("grp").applyInArrow(_near(k), "id long, other long, distance double")
        found = near if found is None else found.unionByName(near)
    by = Window.partitionBy("id").orderBy("distance", "other")
    return kept(found.distinct().withColumn("place", F.row_number().over(by)).where(F.col("place") <= k).drop("place"), "nearest")
