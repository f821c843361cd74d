"""Metrics of whole tables, in one row each."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..stats.inference import quantiles


def market_metrics(series: DataFrame, date: str, value: str, usable: Column) -> DataFrame:
    """Different dates, missing values, excluded rows, and the range of the usable values."""
    own = F.when(usable, F.col(value))
    return series.agg(
        F.count(F.lit(1)).alias("input_rows"), F.count_distinct(date).alias("unique_trading_dates"), F.count_if(F.col(value).isNull()).alias("missing_value_rows"),
        F.count_if(~F.coalesce(usable, F.lit(False))).alias("excluded_rows"), F.min(own).alias("minimum_usable_value"), F.max(own).alias("maximum_usable_value"),
    )


def quality_metrics(docs: DataFrame, content: Column, size: Column, flags: Mapping[str, Column]) -> DataFrame:
    """Rows, different contents, groups of equal ones and their rows, the longest, and rows that each flag marks."""
    sizes = docs.groupBy(content.alias("h")).agg(F.count(F.lit(1)).alias("n"))
    several = F.col("n") > 1
    a = sizes.agg(
        F.sum("n").alias("input_rows"), F.count(F.lit(1)).alias("distinct_contents"), F.count_if(several).alias("duplicate_groups"), F.coalesce(F.sum(F.when(several, F.col("n"))), F.lit(0)).alias("duplicate_rows"),
    )
    b = docs.agg(F.max(size).alias("longest"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in flags.items()))
    return a.crossJoin(b)  # one row each


def missing_counts(df: DataFrame) -> DataFrame:
    """Nulls of each column, in one row."""
    return df.agg(*(F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns))


def numeric(df: DataFrame, unnamed: str = "Unnamed") -> DataFrame:
    """The columns that hold numbers, without those that a reader had to name."""
    kept = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and not f.name.startswith(unnamed)]
    return df.select(*(F.col(f"`{c}`") for c in kept))


def box(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Box-plot statistics: quartiles, whiskers within one and a half times their distance, and outliers."""
    q = quantiles(df.where(F.col(value).isNotNull()), value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, *by)
    fences = q.withColumns({"low": F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), "high": F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))})
    rows = df.join(F.broadcast(fences), list(by)) if by else df.crossJoin(F.broadcast(fences))
    inside = F.col(value).between(F.col("low"), F.col("high"))
    names = ("q1", "median", "q3")
    return rows.groupBy(*by, *names).agg(
        F.count(value).alias("n"), F.min(F.when(inside, F.col(value))).alias("whisker_low"), F.max(F.when(inside, F.col(value))).alias("whisker_high"), F.count_if(~inside).alias("outliers"),
    )


def extraction_summary(records: DataFrame, stances: tuple[str, ...], usage: tuple[str, ...]) -> DataFrame:
    """Reliability of extractions: ``records`` has status, stance and abstained (null without a sound result),
    supported, unsupported (an array) and the columns of ``usage``."""
    sound, n = F.col("stance").isNotNull(), F.count(F.lit(1))
    share = lambda c: F.try_divide(F.count_if(F.coalesce(c, F.lit(False))).cast("double"), n)
    return records.agg(
        n.alias("sample_size"), F.count_if(F.col("status") == "success").alias("success"), F.count_if(F.coalesce(F.col("status") != "success", F.lit(True))).alias("error"),
        share(sound).alias("schema_validity_rate"), share(F.col("supported")).alias("evidence_support_rate"),
        F.coalesce(F.sum(F.size(F.coalesce("unsupported", F.array().cast("array<string>")))), F.lit(0)).alias("unsupported_quote_count"), share(sound & F.col("abstained")).alias("abstention_rate"),
        *(F.count_if(F.coalesce(F.col("stance") == s, F.lit(False))).alias(f"stance_{s}") for s in stances), *(F.coalesce(F.sum(F.coalesce(u, F.lit(0))), F.lit(0)).cast("long").alias(u) for u in usage),
    )


def metadata_sets(df: DataFrame, *columns: str) -> DataFrame:
    """The different values of each column as text, sorted; columns that the table lacks are left out."""
    return df.agg(*(F.array_sort(F.collect_set(F.col(c).cast("string"))).alias(c) for c in columns if c in df.columns))
