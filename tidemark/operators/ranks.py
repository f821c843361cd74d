"""Positions in an order over whole tables or large groups, without a window that holds all of one.

Rows are ordered by group and value over ranges; what a group has before it, a row for each group, is taken off again, so
a group as large as the table is ranked in parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import Ordered


def below(counts: DataFrame, value: str, n: str, *by: str) -> DataFrame:
    """``counts`` (a row for each value of a group, ``n`` times) with ``below``: how many are smaller."""
    placed = Ordered(counts, *by, value).running({"__before": ("sum", F.col(n))}, own=False).withColumn("__before", F.coalesce("__before", F.lit(0)))
    if not by:
        return placed.withColumnRenamed("__before", "below")
    starts = placed.groupBy(*by).agg(F.min("__before").alias("__start"))
    return placed.join(starts, list(by)).withColumn("below", F.col("__before") - F.col("__start")).drop("__before", "__start")


def dealt(rows: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    """``rows`` with ``__rank``, from 1, in an order within each label that depends on key and seed alone."""
    placed = Ordered(rows.withColumn("__hash", F.xxhash64(key, F.lit(seed))), label, "__hash", key).numbered("__at", 1)
    starts = placed.groupBy(F.col(label).alias("__label")).agg((F.min("__at") - 1).alias("__start"))
    ranked = placed.join(starts, F.col(label).eqNullSafe(F.col("__label")))
    return ranked.withColumn("__rank", F.col("__at") - F.col("__start")).select(*rows.columns, "__rank")
