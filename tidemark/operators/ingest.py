"""Coercion, row validation and usability of raw rows; nothing is ever dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import Ordered

#: Formats tried in turn where dates come in several.
DATE_FORMATS = ("yyyy-MM-dd", "M/d/yyyy", "d.M.yyyy", "MMM d, yyyy")
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def require(df: DataFrame, columns: tuple[str, ...], what: str) -> DataFrame:
    """The frame itself, or an error that names the missing columns in order."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks columns: {', '.join(missing)}")
    return df


def require_unique(df: DataFrame, keys: tuple[str, ...], what: str) -> DataFrame:
    if df.groupBy(*keys).count().where("count > 1").head(1):
        raise ValueError(f"{what} repeats keys: {', '.join(keys)}")
    return df


def require_match(left: DataFrame, right: DataFrame, key: str, what: str) -> DataFrame:
    """Every key on the left has a row on the right; up to ten that don't are named."""
    lost = [r[0] for r in left.join(right, key, "left_anti").select(key).orderBy(key).limit(10).collect()]
    if lost:
        raise ValueError(f"{what} has no rows for {lost}")
    return left


def category(c: Column) -> Column:
    return F.lower(F.trim(c))


def strict_date(c: Column, fmt: str = "yyyy-MM-dd") -> Column:
    return F.to_date(F.try_to_timestamp(F.trim(c), F.lit(fmt)))


def mixed_date(c: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    return F.coalesce(*(strict_date(c, f) for f in formats))


def number(c: Column) -> Column:
    """A decimal number or null; forms such as ``1.5d`` are no numbers."""
    text = F.trim(c.cast("string"))
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def truth(c: Column) -> Column:
    """True or false from text in any case; null for anything else, which callers reject or read as false."""
    text = F.lower(F.trim(c.cast("string")))
    return F.when(text.isin("true", "false"), text == "true")


def require_truth(df: DataFrame, column: str) -> DataFrame:
    """``df`` with a boolean column: true booleans pass (null is false), text must be true or false in any case."""
    if dict(df.dtypes)[column] == "boolean":
        return df.withColumn(column, F.coalesce(column, F.lit(False)))
    bad = [r[0] for r in df.where(truth(F.col(column)).isNull()).select(column).distinct().orderBy(column).limit(10).collect()]
    if bad:
        raise ValueError(f"{column} is neither true nor false: {bad}")
    return df.withColumn(column, truth(F.col(column)))


def codes(*checks: tuple[str, Column]) -> Column:
    """Names of the checks that hold, comma-joined in order."""
    return F.concat_ws(",", *(F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in checks))


def document_errors(canonical: Column, kind: Column, date: Column, cleaned: Column, kinds: tuple[str, ...]) -> Column:
    return codes(
        ("invalid_url", F.coalesce(canonical, F.lit("")) == ""),
        ("invalid_document_type", ~F.coalesce(kind.isin(*kinds), F.lit(False))),
        ("invalid_date", date.isNull()),
        ("empty_text", F.coalesce(cleaned, F.lit("")) == ""),
    )


def exclusion(date: Column, value: Column) -> Column:
    """Why an observation can't be used: its date, and a value that is missing or else negative."""
    return codes(("invalid_date", date.isNull()), ("missing_value", value.isNull()), ("negative_value", value < 0))


def era(date: Column) -> Column:
    return F.when(F.year(date) <= 2004, "through_2004").when(F.year(date) <= 2014, "2005_2014").otherwise("since_2015")


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``source_row`` from 0 by a stated order, in parallel."""
    return Ordered(df, *order).numbered("source_row")
