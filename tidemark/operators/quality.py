"""Quality metrics and issues of ingested tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def identity_conflicts(docs: DataFrame, key: str, content: str) -> DataFrame:
    """Keys that stand for more than one content."""
    return docs.groupBy(key).agg(F.count_distinct(content).alias("contents"), F.count(F.lit(1)).alias("rows")).where("contents > 1")


def group_sizes(df: DataFrame, *keys: str) -> DataFrame:
    """How many groups have several rows, and how many rows are in them."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return sizes.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows_in_groups"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def as_map(counts: DataFrame, column: str) -> DataFrame:
    return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(column).cast("string"), "n")))).alias("counts"))


def issue(df: DataFrame, code: str, severity: str, cond: Column, example: Column, order: str, most: int = 5) -> DataFrame:
    """How many rows have an issue, and the first few of them by order. Examples are kept by a bounded
    aggregate, so an issue that all rows have gathers no more than one that five have."""
    bad = df.where(F.coalesce(cond, F.lit(False))).select(F.col(order).alias("o"), example.cast("string").alias("x"))
    first = bad.orderBy("o", "x").limit(most)
    examples = first.agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "x"))), lambda s: s["x"]).alias("examples"))
    return bad.agg(F.count(F.lit(1)).alias("n")).crossJoin(examples).select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), "n", "examples")
