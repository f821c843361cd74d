"""Market series: checks, normalisation and the outer merge by date."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalise(raw: DataFrame, date: str, value: str, name: str, positive: bool = True) -> DataFrame:
    """(trading_date, name) of rows with a value, dates in UTC without time; errors for repeated dates and
    for values that are not positive."""
    out = raw.select(utc_midnight(F.col(date)).alias("trading_date"), F.col(value).cast("double").alias(name)).where(F.col("trading_date").isNotNull() & F.col(name).isNotNull() & ~F.isnan(name))
    checks = out.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("trading_date").alias("d"), F.count_if(F.col(name) <= 0).alias("low")).first()
    if not checks["n"]:
        raise ValueError(f"{name} has no observations")
    if checks["n"] != checks["d"]:
        raise ValueError(f"{name} repeats dates")
    if positive and checks["low"]:
        raise ValueError(f"{name} has values that are not positive")
    return out


def utc_midnight(time: Column, zone: str | None = None) -> Column:
    """The day in UTC of a time, which is local to ``zone`` if that is given."""
    return F.to_date(F.to_utc_timestamp(time, zone) if zone else time)


def window(df: DataFrame, start: str, end: str, date: str = "trading_date") -> DataFrame:
    return df.where(F.col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def merge(series: list[DataFrame]) -> DataFrame:
    """All series by date, with nulls where one has no session."""
    return reduce(lambda a, b: a.join(b, "trading_date", "full"), series)


def coverage(df: DataFrame, names: tuple[str, ...], date: str = "trading_date") -> DataFrame:
    """For each series how many observations it has, and its first and last date."""
    long = df.unpivot([date], list(names), "series", "value").where("value is not null")
    return long.groupBy("series").agg(F.count(F.lit(1)).alias("observations"), F.min(date).alias("first_date"), F.max(date).alias("last_date"))


def content_hash(df: DataFrame, order: str = "trading_date") -> DataFrame:
    """One hash of all rows as text, whatever their order: rows are hashed and the hashes sorted."""
    row = F.sha2(F.concat_ws(",", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns)), 256)
    # By month first, so that no buffer holds more than a month's hashes and then one for each month.
    months = df.select(row.alias("h"), F.col(order).alias("o")).groupBy(F.date_trunc("month", "o").alias("m")).agg(F.array_sort(F.collect_list(F.struct("o", "h"))).alias("x"))
    hashed = months.select("m", F.sha2(F.array_join(F.transform("x", lambda x: x["h"]), ","), 256).alias("h"))
    return hashed.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("m", "h"))), lambda x: x["h"]), ","), 256).alias("content_sha256"))
