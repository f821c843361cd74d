"""Joins that put documents, predictions and reports together, with the checks they must pass."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ingest import require, require_match, require_unique


def with_predictions(docs: DataFrame, predictions: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """Every document with its prediction: keys are unique on both sides and none is missing."""
    require_unique(docs, (key,), "the documents")
    require_unique(require(predictions, (key, *fields), "the predictions"), (key,), "the predictions")
    require_match(docs, predictions, key, "the predictions")
    return docs.join(predictions.select(key, *fields), key, "left")


def with_domain_policy(docs: DataFrame, domain: DataFrame, key: str, status: str, features: tuple[str, ...], eligible: Column) -> DataFrame:
    """Documents with their domain shares as numbers. Only eligible ones must have a successful row; others keep
    what there is, or nulls."""
    require_unique(require(domain, (key, status, *features), "the domain policy"), (key,), "the domain policy")
    out = docs.join(domain.select(key, status, *(F.col(f).try_cast("double").alias(f) for f in features)), key, "left")
    lost = [r[0] for r in out.where(eligible & ~F.col(status).eqNullSafe(F.lit("success"))).select(key).orderBy(key).limit(10).collect()]
    if lost:
        raise ValueError(f"eligible documents lack a successful domain policy: {lost}")
    return out


def judged(annotations: DataFrame, predictions: DataFrame, key: str, status: str, pairs: tuple[tuple[str, str], ...]) -> DataFrame:
    """Annotations with predictions to compare: one row (key, task, expected, predicted) for each task, given as
    (expected, predicted) columns. Empty annotations, unsuccessful predictions and missing labels are errors."""
    if not annotations.head(1):
        raise ValueError("there are no annotations")
    both = with_predictions(annotations, predictions, key, (status, *(p for _, p in pairs)))
    whole = reduce(and_, (F.col(c).isNotNull() for pair in pairs for c in pair))
    bad = [r[0] for r in both.where(~F.col(status).eqNullSafe(F.lit("success")) | ~whole).select(key).orderBy(key).limit(10).collect()]
    if bad:
        raise ValueError(f"annotated documents without a successful prediction or a label: {bad}")
    tasks = F.array(*(F.struct(F.lit(e).alias("task"), F.col(e).alias("expected"), F.col(p).alias("predicted")) for e, p in pairs))
    return both.select(key, F.explode(tasks).alias("x")).select(key, "x.*")


def dashboard(documents: DataFrame, nlp: DataFrame, domain: DataFrame, events: DataFrame, key: str, nlp_fields: tuple[str, ...], domain_fields: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Documents with both predictions, latest first, and events by date. Dates that can't be read are null."""
    require(events, ("event_date", "event_era"), "the events")
    out = documents
    for what, side, fields in (("predictions", nlp, nlp_fields), ("domain policy", domain, domain_fields)):
        require_unique(require(side, (key, *fields), f"the {what}"), (key,), f"the {what}")
        out = out.join(side.select(key, *fields), key, "left")
    dated = out.withColumn("publication_date", F.col("publication_date").try_cast("date"))
    return dated.orderBy(F.desc("publication_date"), key), events.withColumn("event_date", F.col("event_date").try_cast("date")).orderBy("event_date")


def looked_up(keys: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """The record of each key; a key without one is an error."""
    return require_match(keys, records, key, "the records").join(records, key)


def at_positions(sample: DataFrame, rows: DataFrame, position: str, same: str) -> DataFrame:
    """The row at each sampled position of a numbered table (column ``position``), whose ``same`` column must be
    the sample's."""
    found = require_match(sample, rows, position, "the numbered rows").join(rows.withColumnRenamed(same, "__theirs"), position)
    if found.where(~F.col(same).eqNullSafe(F.col("__theirs"))).head(1):
        raise ValueError(f"{same} of the numbered rows is not the sample's")
    return found.drop("__theirs")


def written_back(report: DataFrame, tests: DataFrame, keys: tuple[str, ...], columns: tuple[str, ...]) -> DataFrame:
    """A report with results of tests in their rows; rows without a test keep what they had."""
    news = tests.select(*keys, *(F.col(c).alias(f"__{c}") for c in columns))
    both = report.join(news, list(keys), "left")
    own = {c: F.coalesce(f"__{c}", c) if c in report.columns else F.col(f"__{c}") for c in columns}
    return both.select(*(own.pop(c).alias(c) if c in own else F.col(c) for c in report.columns), *(v.alias(c) for c, v in own.items()))


def same_day(series: DataFrame, docs: DataFrame, date: str, other: str) -> DataFrame:
    """Each observation with all documents of its day, or none."""
    return series.join(docs.withColumnRenamed(other, "__day"), F.col(date) == F.col("__day"), "left").drop("__day")


def first_of_each(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """The first row of each key; kept by an aggregate, so that copies of a key are dropped before the shuffle."""
    rest = [c for c in df.columns if c not in (*keys, *order)]
    least = F.min_by(F.struct(*(F.col(c) for c in (*order, *rest))), F.struct(*order))
    return df.groupBy(*keys).agg(least.alias("x")).select(*keys, "x.*").select(*df.columns)
