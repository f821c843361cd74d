"""Connected components of a link table, all in Spark: alternating large-star and small-star."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored


def _least(df: DataFrame) -> DataFrame:
    """For each u the smallest of itself and its neighbours; combined before the shuffle."""
    return df.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame, store: Stored, name: str) -> DataFrame:
    """(node, component) of all nodes with a link; links has long columns u and v.

    Each round is written to the shared folder and compared with the one before by count and a sum
    of hashes; the stars of the last round are the components. Loops and repeated links do no harm.
    """
    now = store.keep(links.select("u", "v").where("u <> v").distinct(), f"{name}-0")
    mark = None
    for k in count(1):
        step = store.keep(_small_star(_large_star(now)), f"{name}-{k}")
        found = step.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        store.drop(f"{name}-{k - 1}")
        now = step
        if tuple(found) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        mark = tuple(found)
