"""Descriptives, rank tests, correlations and multiplicity corrections."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import below
from . import dist


def describe(df: DataFrame, value: str, *by: str) -> DataFrame:
    """n, mean, median, standard deviation (null for one row) and quartiles, by group or overall."""
    v = F.col(value).cast("double")
    rows = df.select(*by, v.alias("__v"))
    basic = rows.groupBy(*by).agg(F.count("__v").alias("n"), F.avg("__v").alias("mean"), F.stddev_samp("__v").alias("sd"))
    places = quantiles(rows.where("__v is not null"), "__v", {"median": 0.5, "q1": 0.25, "q3": 0.75}, *by)
    if not by:
        return basic.join(places).select("n", "mean", "median", "sd", "q1", "q3")  # one row each
    same = reduce(and_, (basic[c].eqNullSafe(places[c]) for c in by))
    return basic.join(places, same, "left").select(*(basic[c] for c in by), "n", "mean", "median", "sd", "q1", "q3")


def quantiles(df: DataFrame, value: str, shares: dict[str, float], *by: str) -> DataFrame:
    """Exact quantiles, interpolated between neighbours: a value's place follows from the counts of smaller ones,
    so no group is sorted or held as a whole."""
    counts = df.groupBy(*(F.struct(c).alias(c) for c in by), value).agg(F.count(F.lit(1)).alias("__n"))
    placed = below(counts, value, "__n", *by)
    total = counts.groupBy(*by).agg(F.sum("__n").alias("__total"))
    placed = placed.join(total, list(by)) if by else placed.join(total)
    aggs = []
    for name, q in shares.items():
        at = (F.col("__total") - 1) * q
        low, high = (F.max(F.when(F.col("below") <= edge, F.col(value))) for edge in (F.floor(at), F.ceil(at)))
        aggs.append((low + (high - low) * F.max(at - F.floor(at))).alias(name))
    out = placed.groupBy(*by).agg(*aggs)
    return out.select(*(F.col(c)[c].alias(c) for c in by), *shares)


def mean_test(df: DataFrame, value: str) -> dict[str, float]:
    """The mean with a 95 % t interval and a test against zero."""
    r = df.agg(F.count(value), F.avg(value), F.stddev_samp(value)).first()
    n, mean, sd = r
    se = sd / math.sqrt(n)
    wide = dist.t_quantile(0.05, n - 1) * se
    t = mean / se if se else math.nan
    return {"n": n, "mean": mean, "ci_lower": mean - wide, "ci_upper": mean + wide, "t": t, "p_value": dist.t_two_sided(t, n - 1)}


def average_rank(value: str | Column, *by: str) -> Column:
    """Ranks from 1, ties sharing their mean rank."""
    v = F.col(value) if isinstance(value, str) else value
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, v))
    return F.rank().over(Window.partitionBy(*by).orderBy(v)) + (ties - 1) / 2.0


def ranked(df: DataFrame, value: str, out: str) -> DataFrame:
    """Average ranks in parallel: counts by value are added up in order, bucket by bucket, and joined back."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("__n"))
    ranks = below(counts, value, "__n").select(F.col(value).alias("__v"), (F.col("below") + (F.col("__n") + 1) / 2.0).alias(out))
    return df.join(ranks, F.col(value) == F.col("__v"), "left").drop("__v")


def signed_rank(df: DataFrame, value: str) -> dict[str, float]:
    """Wilcoxon's statistic with the normal approximation and its tie term; NaN without non-zero values."""
    rows = ranked(df.where(F.col(value) != 0).select(F.col(value).alias("v"), F.abs(value).alias("a")), "a", "r")
    s = rows.agg(F.count(F.lit(1)), F.sum(F.when(F.col("v") > 0, F.col("r"))), F.sum(F.when(F.col("v") < 0, F.col("r")))).first()
    ties = rows.groupBy("a").agg(F.count(F.lit(1)).alias("t")).agg(F.sum(F.col("t") ** 3 - F.col("t"))).first()[0]
    n = s[0]
    if not n:
        return {"n": 0, "w": math.nan, "p_value": math.nan}
    w = min(s[1] or 0.0, s[2] or 0.0)
    sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    return {"n": n, "w": w, "p_value": dist.normal_two_sided((w - n * (n + 1) / 4) / sd)}


def kruskal(df: DataFrame, value: str, group: str) -> dict[str, float]:
    """H with tie correction over groups of more than one row; NaN with fewer than two groups."""
    sizes = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("__m")).where("__m > 1")
    rows = ranked(df.join(sizes, group).select(group, F.col(value).alias("v")).where("v is not null"), "v", "r")
    groups = rows.groupBy(group).agg(F.sum("r").alias("s"), F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("s") ** 2 / F.col("n")), F.sum("n"), F.count(F.lit(1))).first()
    if not groups[2] or groups[2] < 2:
        return {"groups": groups[2] or 0, "h": math.nan, "p_value": math.nan}
    ties = rows.groupBy("v").agg(F.count(F.lit(1)).alias("t")).agg(F.sum(F.col("t") ** 3 - F.col("t"))).first()[0]
    n = groups[1]
    h = (12 / (n * (n + 1)) * groups[0] - 3 * (n + 1)) / (1 - ties / (n**3 - n))
    return {"groups": groups[2], "h": h, "p_value": dist.chi2_upper(h, groups[2] - 1)}


def correlations(df: DataFrame, outcome: str, feature: str) -> dict[str, float]:
    """Pearson's r and Spearman's rho with p-values by Student's t."""
    rows = df.select(F.col(outcome).cast("double").alias("y"), F.col(feature).cast("double").alias("x")).dropna()
    rows = ranked(ranked(rows, "y", "ry"), "x", "rx")
    n, r, rho = rows.agg(F.count(F.lit(1)), F.corr("y", "x"), F.corr("ry", "rx")).first()

    def p(c: float | None) -> float:
        if c is None or n < 3:
            return math.nan
        return dist.t_two_sided(c * math.sqrt((n - 2) / max(1 - c * c, 1e-300)), n - 2)

    return {"n": n, "pearson_r": r, "pearson_p_value": p(r), "spearman_rho": rho, "spearman_p_value": p(rho)}


def holm(df: DataFrame, p: str, *family: str) -> DataFrame:
    """Rows with step-down adjusted p-values within each family of tests."""
    order = Window.partitionBy(*family).orderBy(p)
    scaled = (F.count(p).over(Window.partitionBy(*family)) - F.row_number().over(order) + 1) * F.col(p)
    stepped = df.withColumn("__scaled", scaled)
    so_far = F.max("__scaled").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return stepped.withColumn(f"{p}_holm", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), so_far))).drop("__scaled")


def trend(df: DataFrame, y: str, x: str) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def families(tests: DataFrame, p: str, *family: str, level: float = 0.05) -> DataFrame:
    """Holm-adjusted p-values of each family (a block of terms across all outcomes, or a correlation across all
    outcomes and features) with the decision at ``level``."""
    return holm(tests, p, *family).withColumn(f"{p}_reject", F.coalesce(F.col(f"{p}_holm") < level, F.lit(False)))
