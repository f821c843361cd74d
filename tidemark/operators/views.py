"""Frames behind a dashboard: filters, unpivots, rolling means, dominant stances, coefficient arms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.probs import first_largest
from .ordered import Ordered


def between(events: DataFrame, start: str, end: str, eras: tuple[str, ...], date: str = "event_date") -> DataFrame:
    """An inclusive range of dates and a choice of eras."""
    return events.where(F.col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date")) & F.col("event_era").isin(*eras))


def overview(events: DataFrame, documents: DataFrame) -> DataFrame:
    a = events.agg(F.count(F.lit(1)).alias("events"), F.min(F.year("event_date")).alias("first_year"), F.max(F.year("event_date")).alias("last_year"))
    b = documents.agg(F.count_if(F.col("document_type") == "statement").alias("statements"))
    return a.crossJoin(b)  # one row each


def long_shares(events: DataFrame, ids: tuple[str, ...], columns: tuple[str, ...], prefix: str) -> DataFrame:
    out = events.unpivot(list(ids), list(columns), "stance", "share")
    return out.withColumn("stance", F.regexp_replace("stance", f"^{prefix}", ""))


def rolling(events: DataFrame, columns: tuple[str, ...], n: int = 8, date: str = "event_date") -> DataFrame:
    """Means of the last n events (of those there are), over what a filter has left."""
    if not 1 <= n <= 20:
        raise ValueError("the window is 1 to 20 events")
    return Ordered(events, date).window(n - 1, lambda w: {f"{c}_rolling": F.avg(c).over(w.rowsBetween(-(n - 1), 0)) for c in columns})


def dominant(events: DataFrame, columns: tuple[str, ...], names: tuple[str, ...], out: str = "dominant_stance") -> DataFrame:
    return events.withColumn(out, first_largest(F.array(*(F.col(c) for c in columns)), names))


def announcements(documents: DataFrame, events: DataFrame) -> DataFrame:
    """Successful statements of event dates, with the text that a list shows."""
    kept = documents.where("document_type = 'statement' and status = 'success'").join(events.select(F.col("event_date").alias("publication_date")).distinct(), "publication_date", "left_semi")
    return kept.withColumn("label", F.concat_ws(" · ", F.date_format("publication_date", "yyyy-MM-dd"), "document_id"))


def coefficient_arms(coefficients: DataFrame, level: float = 0.05) -> DataFrame:
    """Terms other than the intercept with the two arms of their intervals and whether p is below ``level``."""
    kept = coefficients.where("term <> 'Intercept'")
    return kept.withColumns({"arm_up": F.col("ci_upper") - F.col("coefficient"), "arm_down": F.col("coefficient") - F.col("ci_lower"), "significant": F.col("p_value") < level})
