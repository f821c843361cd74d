"""Announcement events: aggregation by date and strict positional alignment with trading sessions.

A horizon counts sessions of a series' own calendar, not days. The value of the day of an event is used
neither before nor after it. Sessions are numbered, and events placed among them, range by range of the dates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ingest import era
from .ordered import NUMBER, Ordered

HORIZONS = (1, 5)
#: Days of turmoil that a sensitivity analysis leaves out.
CRISIS = (2007, 2009)


def sessions(observations: DataFrame, date: str, value: str, looks: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Usable observations (date and value there) numbered by date, with values some sessions back."""
    usable = observations.where(F.col(date).isNotNull() & F.col(value).isNotNull())
    dated = Ordered(usable.select(F.col(date).alias("session_date"), F.col(value).alias("session_value")), "session_date")
    return dated.window(max(looks, default=0), lambda w: {"rn": F.col(NUMBER), **{f"back_{k}": F.lag("session_value", k).over(w) for k in looks}})


def positions(events: DataFrame, index: DataFrame, date: str = "event_date") -> DataFrame:
    """For each event date the number of the last session before it and of the first after it."""
    marks = events.select(F.col(date).alias("d"), F.lit(0).alias("rn")).distinct().unionByName(index.select(F.col("session_date").alias("d"), "rn"))
    at = Ordered(marks, "d", "rn").running({"prior": ("max", F.when(F.col("rn") > 0, F.col("rn")))}, own=False).where("rn = 0").drop("rn")
    same = index.select(F.col("session_date").alias("d"), F.lit(1).alias("same"))
    return at.join(same, "d", "left").select(F.col("d").alias(date), "prior", (F.coalesce("prior", F.lit(0)) + F.coalesce("same", F.lit(0)) + 1).alias("after"))


def align(events: DataFrame, observations: DataFrame, date: str, value: str, horizons: tuple[int, ...] = HORIZONS, looks: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Each event with prior value, look-backs, and for each horizon date, value, change and usability.

    Without a prior session everything is null, later sessions or not.
    """
    index = sessions(observations, date, value, looks)
    at = positions(events, index)
    prior = index.select(F.col("rn").alias("prior"), F.col("session_date").alias("prior_date"), F.col("session_value").alias("prior_value"), *(f"back_{k}" for k in looks))
    out = events.join(at, "event_date").join(prior, "prior", "left")
    reasons = [F.when(F.col("prior").isNull(), F.lit("no_prior_session"))]
    for h in horizons:
        post = index.select((F.col("rn") - (h - 1)).alias("after"), F.col("session_date").alias(f"post_date_{h}d"), F.col("session_value").alias(f"post_value_{h}d"))
        out = out.join(post, "after", "left")
        reasons.append(F.when(F.col("prior").isNotNull() & F.col(f"post_date_{h}d").isNull(), F.lit(f"no_session_after_{h}d")))
    known = F.col("prior").isNotNull()
    for h in horizons:
        out = out.withColumns({c: F.when(known, F.col(c)) for c in (f"post_date_{h}d", f"post_value_{h}d")})
        out = out.withColumns({
            f"change_{h}d": F.col(f"post_value_{h}d") - F.col("prior_value"),
            f"pct_change_{h}d": F.try_divide(F.col(f"post_value_{h}d") - F.col("prior_value"), F.col("prior_value")) * 100,
            f"is_usable_{h}d": known & F.col(f"post_value_{h}d").isNotNull(),
        })
    for k in looks:
        out = out.withColumn(f"pre_change_{k}d", F.col("prior_value") - F.col(f"back_{k}"))
    return out.withColumn("exclusion_reason", F.concat_ws(";", *reasons)).drop("prior", "after")


def simple_return(after: Column, before: Column) -> Column:
    return F.try_divide(after, before) - 1


def basis_points(after: Column, before: Column) -> Column:
    return (after - before) * 100


def align_external(events: DataFrame, observations: DataFrame, date: str, value: str, name: str, measure, horizons: tuple[int, ...] = HORIZONS, looks: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Columns of another series: ``{name}_{h}d``, ``pre_{name}_{k}d`` and ``is_usable_{name}_{h}d``."""
    plain = align(events.select("event_date").distinct(), observations, date, value, horizons, looks)
    cols = [measure(F.col(f"post_value_{h}d"), F.col("prior_value")).alias(f"{name}_{h}d") for h in horizons]
    cols += [measure(F.col("prior_value"), F.col(f"back_{k}")).alias(f"pre_{name}_{k}d") for k in looks]
    cols += [F.col(f"is_usable_{h}d").alias(f"is_usable_{name}_{h}d") for h in horizons]
    return plain.select("event_date", *cols)


def aggregate(docs: DataFrame, date: str, means: tuple[str, ...], eligible: tuple[str, ...] = ("statement",), ok: str = "success") -> DataFrame:
    """One row a date: counts by type and status, sorted ids, and means over successful rows only.

    ``docs`` has document_id, document_type, status and the columns of ``means``.
    """
    good = F.col("status") == ok
    return docs.where(F.col("document_type").isin(*eligible)).groupBy(F.col(date).alias("event_date")).agg(
        F.count(F.lit(1)).alias("document_count"),
        F.count_if(F.col("document_type") == "statement").alias("statement_count"),
        F.count_if(F.col("document_type") == "transcript").alias("transcript_count"),
        F.count_if(F.coalesce(good, F.lit(False))).alias("success_count"),
        F.count_if(~F.coalesce(good, F.lit(False))).alias("error_count"),
        F.to_json(F.array_sort(F.collect_list("document_id"))).alias("document_ids"),
        *(F.avg(F.when(good, F.col(m))).alias(m) for m in means),
    ).withColumns({"event_year": F.year("event_date"), "event_month": F.month("event_date"), "event_era": era(F.col("event_date"))})


def report(aligned: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    counts = [F.count_if(F.col(f"is_usable_{h}d")).alias(f"usable_{h}d") for h in horizons] + [F.count_if(~F.col(f"is_usable_{h}d")).alias(f"excluded_{h}d") for h in horizons]
    return aligned.agg(F.count(F.lit(1)).alias("events"), F.min("event_date").alias("first_event"), F.max("event_date").alias("last_event"), *counts)


def outside_crisis(df: DataFrame, date: str) -> DataFrame:
    """Rows of other years, and those without a date."""
    return df.where(~F.coalesce(F.year(date).between(*CRISIS), F.lit(False)))


def complete(df: DataFrame, date: str, flags: tuple[str, ...], numbers: tuple[str, ...]) -> DataFrame:
    """Rows that are usable and lack nothing, by date; an error where there are none."""
    kept = df.where(F.col(date).isNotNull())
    for f in flags:
        kept = kept.where(F.col(f))
    kept = kept.dropna(subset=list(numbers)).orderBy(date)
    if not kept.head(1):
        raise ValueError("no complete rows")
    return kept
