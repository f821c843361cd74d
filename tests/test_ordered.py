"""Order over a whole table without a window that gathers it."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import events, views
from tidemark.operators.ordered import NUMBER, Ordered
from tidemark.plans import catalogue
from tidemark.stats import ols


def unkeyed(df):
    """Windows without a key in the plan that would run."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [w for w in re.findall(r"windowspecdefinition\((.*?)\)", plan) if "__o_range" not in w.split("ASC")[0]]


@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_numbers_lags_and_running_values(spark, ranges):
    r = random.Random(ranges)
    rows = [(i, r.choice([None, "a", "b", "b", "b", "c"]), r.choice([None, r.randrange(100)])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, k string, v long").repartition(5)
    want = sorted(rows, key=lambda x: (x[1] is not None, x[1] or "", x[0]))
    o = Ordered(df, "k", "id", ranges=ranges)
    assert [(x.id, x.n) for x in o.numbered("n", 1).orderBy("n").collect()] == [(x[0], i + 1) for i, x in enumerate(want)] and o.total == 300
    for n in (1, 5, 60):
        got = {x.id: (x.back, x.m) for x in o.window(n, lambda w, n=n: {"back": F.lag("v", n).over(w), "m": F.sum("v").over(w.rowsBetween(-n, 0))}).collect()}
        for i, x in enumerate(want):
            near = [v for *_, v in want[max(0, i - n) : i + 1] if v is not None]
            assert got[x[0]] == (want[i - n][2] if i >= n else None, sum(near) if near else None)
    for own in (True, False):
        out = o.running({"s": ("sum", F.col("v")), "c": ("count", F.col("v")), "h": ("max", F.col("v")), "l": ("min", F.col("v"))}, own)
        got = {x.id: (x.s, x.c, x.h, x.l) for x in out.collect()}
        for i, x in enumerate(want):
            near = [v for *_, v in want[: i + own] if v is not None]
            assert got[x[0]] == ((sum(near), len(near), max(near), min(near)) if near else (None, 0, None, None))


def test_columns_may_be_called_like_counts(spark):
    df = spark.createDataFrame([(3, 10), (1, 20), (2, 30)], "v int, __n int").withColumns({"__range": F.lit(1), "__start": F.lit(2)})
    got = Ordered(df, "v").running({"before": ("sum", F.col("__n"))}, own=False)
    assert sorted((r.v, r["__n"], r.before) for r in got.collect()) == [(1, 20, None), (2, 30, 20), (3, 10, 50)]


def test_no_rows(spark):
    o = Ordered(spark.createDataFrame([], "id long, v long"), "id")
    assert o.numbered("n").collect() == [] and o.window(2, lambda w: {"b": F.lag("v").over(w)}).collect() == [] and o.running({"s": ("sum", F.col("v"))}).collect() == []


def test_a_million_rows_in_many_ranges(spark):
    """A third of all rows share a value, and fill as many ranges as others do."""
    n = 1_000_000
    df = spark.range(n, numPartitions=16).select("id", F.when(F.col("id") % 3 == 0, 500_000).otherwise(F.col("id")).alias("k"))
    o = Ordered(df, "k", ranges=50)
    sizes = [r["count"] for r in o.rows.groupBy("__o_range").count().collect()]
    assert len(sizes) > 40 and max(sizes) < 3 * n / 50
    out = o.window(7, lambda w: {"m": F.avg("k").over(w.rowsBetween(-7, 0)), "n": F.col(NUMBER), "back": F.lag("k", 7).over(w)})
    assert unkeyed(out) == []
    low = out.where("n <= 100000").agg(F.sum("m"), F.min("back"), F.count("back")).first()
    keys = sorted(500_000 if i % 3 == 0 else i for i in range(n))[:100_000]
    assert abs(low[0] - sum(sum(keys[max(0, i - 7) : i + 1]) / len(keys[max(0, i - 7) : i + 1]) for i in range(100_000))) < 1e-3
    assert (low[1], low[2]) == (keys[0], 100_000 - 7)
    assert out.agg(F.sum("n"), F.max("n")).first() == (n * (n + 1) // 2, n)


def test_plans_of_ordered_queries(spark, sf_small):
    for name in ("q_event_align", "q_event_align_external", "q_rolling_mean", "q_hac"):
        assert unkeyed(catalogue.queries()[name](spark, sf_small)) == []
    days = spark.range(200).select(F.expr("date_add(date'2000-01-01', cast(id as int))").alias("event_date"), (F.col("id") % 7).cast("double").alias("s"))
    assert unkeyed(views.rolling(days, ("s",))) == [] and unkeyed(events.sessions(days, "event_date", "s")) == []


def test_hac_equals_plain_sums_over_many_ranges(spark, monkeypatch):
    import numpy as np

    r = np.random.default_rng(0)
    x = np.cumsum(r.normal(size=(400, 2)), axis=0)
    y = 1 + x @ [0.5, -0.2] + np.cumsum(r.normal(size=400)) * 0.3
    df = spark.createDataFrame([(i, float(x[i, 0]), float(x[i, 1]), float(y[i])) for i in range(400)], "t int, a double, b double, y double").repartition(6)
    f = ols.fit(df, ols.design(df, ("a", "b")), "y")
    design = np.column_stack([np.ones(400), x])
    u = (y - design @ np.linalg.lstsq(design, y, rcond=None)[0])[:, None] * design
    for lags in (1, 5, 11):
        middle = u.T @ u
        for k in range(1, lags + 1):
            middle += (1 - k / (lags + 1)) * (u[k:].T @ u[:-k] + u[:-k].T @ u[k:])
        inverse = np.linalg.inv(design.T @ design)
        assert np.allclose(f.hac(df, lags, "t"), inverse @ middle @ inverse, rtol=1e-6)
    e = u[:, 0]
    assert abs(f.diagnostics(df, "t")["durbin_watson"] - ((e[1:] - e[:-1]) ** 2).sum() / (e**2).sum()) < 1e-8
