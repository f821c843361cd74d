import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark import config
from tidemark.plans import queries_models
from tidemark.operators import aggregate, backends, cache, evaluate, events, ingest, markets, quality, topics, views
from tidemark.sources import files, sinks
from tidemark.stats import dist, inference as rank_tests, ols
from tidemark.streaming import counts

DAY = dt.date(2020, 3, 2)  # a Monday


def days(*offsets):
    return [DAY + dt.timedelta(days=o) for o in offsets]


@pytest.fixture(scope="module")
def series(spark):
    dates = days(0, 1, 2, 3, 4, 7, 8, 9, 10, 11)
    return spark.createDataFrame([(d, float(10 + i)) for i, d in enumerate(dates)] + [(None, 5.0), (DAY + dt.timedelta(days=5), None)], "d date, v double")


def test_alignment_is_strict_on_both_sides(spark, series):
    ev = spark.createDataFrame([(d,) for d in days(-3, 0, 4, 5, 11, 30)], "event_date date")
    rows = {r.event_date: r for r in events.align(ev, series, "d", "v").collect()}
    friday = rows[days(4)[0]]
    assert (friday.prior_value, friday.post_value_1d, friday.change_1d, friday.change_5d, friday.pre_change_1d) == (13.0, 15.0, 2.0, 6.0, 1.0)
    assert friday.exclusion_reason == "" and friday.is_usable_5d and friday.pre_change_5d is None
    early = rows[days(-3)[0]]
    assert early.exclusion_reason == "no_prior_session" and early.post_value_1d is None and not early.is_usable_1d
    assert rows[days(0)[0]].exclusion_reason == "no_prior_session"
    assert rows[days(5)[0]].post_value_1d == 15.0 and rows[days(5)[0]].prior_value == 14.0
    assert rows[days(11)[0]].exclusion_reason == "no_session_after_1d;no_session_after_5d"
    assert math.isclose(friday.pct_change_1d, 100 * 2 / 13)


def test_external_series_and_report(spark, series):
    ev = spark.createDataFrame([(d,) for d in days(4, 30)], "event_date date")
    rows = {r.event_date: r for r in events.align_external(ev, series, "d", "v", "x", events.basis_points).collect()}
    assert rows[days(4)[0]].x_1d == 200.0 and rows[days(4)[0]].pre_x_1d == 100.0 and not rows[days(30)[0]].is_usable_x_1d
    never = events.align_external(ev, series.limit(0), "d", "v", "x", events.simple_return).collect()
    assert all(r.is_usable_x_5d is False for r in never)
    report = events.report(events.align(ev, series, "d", "v")).first()
    assert (report.events, report.usable_1d, report.excluded_5d) == (2, 1, 1)


def test_events_average_successful_rows_only(spark):
    rows = [("b", "statement", DAY, "success", 0.2), ("a", "statement", DAY, "error", 9.0), ("c", "transcript", DAY, "success", 5.0), ("d", "statement", days(1)[0], None, 1.0)]
    df = spark.createDataFrame(rows, "document_id string, document_type string, p date, status string, s double")
    got = {r.event_date: r for r in events.aggregate(df, "p", ("s",)).collect()}
    first = got[DAY]
    assert (first.document_count, first.success_count, first.error_count, first.s, first.document_ids) == (2, 1, 1, 0.2, '["a","b"]')
    assert got[days(1)[0]].s is None and first.event_era == "since_2015"


def test_crisis_keeps_rows_without_a_date(spark):
    df = spark.createDataFrame([(dt.date(2008, 1, 1),), (dt.date(2010, 1, 1),), (None,)], "d date")
    assert events.outside_crisis(df, "d").count() == 2
    with pytest.raises(ValueError):
        events.complete(df.withColumn("x", F.lit(None).cast("double")), "d", (), ("x",))


def test_markets(spark):
    raw = spark.createDataFrame([("2020-03-02", 1.0), ("2020-03-03", 2.0), ("2020-03-04", None)], "d string, v double")
    a = markets.normalise(raw, "d", "v", "a")
    b = markets.normalise(raw.withColumn("d", F.lit("2020-03-03")).limit(1), "d", "v", "b")
    merged = markets.merge([a, b])
    assert sorted((r.a, r.b) for r in merged.collect() if r.b) == [(2.0, 1.0)] and merged.count() == 2
    assert len(markets.content_hash(merged).first()[0]) == 64
    for bad in (raw.withColumn("v", F.lit(-1.0)), raw.withColumn("d", F.lit("2020-03-02")), raw.limit(0)):
        with pytest.raises(ValueError):
            markets.normalise(bad, "d", "v", "a")


def test_ingestion(spark):
    df = spark.createDataFrame([("3/4/1999", " 1.5 "), ("1999-03-04", "1.5d"), ("x", "-2"), (None, ".")], "d string, v string")
    rows = df.select(ingest.mixed_date(F.col("d")).alias("d"), ingest.number(F.col("v")).alias("v"), ingest.exclusion(ingest.mixed_date(F.col("d")), ingest.number(F.col("v"))).alias("e")).collect()
    assert [r.e for r in rows] == ["", "missing_value", "invalid_date,negative_value", "invalid_date,missing_value"] and rows[0].v == 1.5
    with pytest.raises(ValueError, match="a, b"):
        ingest.require(df, ("d", "b", "a"), "t")
    with pytest.raises(ValueError):
        ingest.require_unique(df.unionAll(df), ("d",), "t")
    with pytest.raises(ValueError):
        ingest.require_match(df, df.where("d = 'x'"), "d", "t")
    many = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    assert ingest.numbered(many, "k").where("k <> source_row").count() == 0


def test_quality(spark):
    df = spark.createDataFrame([(i, "a" if i < 8 else "b", str(i % 2)) for i in range(10)], "i int, k string, h string")
    issue = quality.issue(df, "c", "warning", F.col("k") == "a", F.col("i"), "i").first()
    assert (issue.n, issue.examples) == (8, ["0", "1", "2", "3", "4"])
    assert quality.issue(df, "c", "warning", F.lit(False), F.col("i"), "i").first().n == 0
    assert quality.identity_conflicts(df, "k", "h").count() == 2
    assert tuple(quality.group_sizes(df, "k").first()) == (2, 10)


def test_metrics(spark):
    pairs = spark.createDataFrame([("h", "h"), ("h", "d"), ("d", "d"), ("n", "n")], "t string, g string")
    m = evaluate.confusion(pairs, "t", "g", ("h", "d", "n", "never"))
    by = {r.label: r for r in evaluate.class_metrics(m).collect()}
    assert by["h"].recall == 0.5 and by["h"].precision == 1.0 and by["never"].f1 == 0.0 and m.count() == 16
    assert evaluate.macro(evaluate.class_metrics(m)).first().accuracy == 0.75
    rows = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(15)], "i int, l string")
    one, two = (sorted(map(tuple, evaluate.stratified_sample(rows, "l", "i", 9, 3).select("i", "l").collect())) for _ in range(2))
    assert one == two and len(one) == 9
    even = evaluate.even_sample(spark.range(3).withColumnRenamed("id", "rank"), 3, 2)
    assert [r.rank for r in even.orderBy("rank").collect()] == [0, 2]


def test_aggregation_of_probabilities(spark):
    df = spark.createDataFrame([("d", 1, [0.8, 0.2], 3), ("d", 1, [0.2, 0.8], 1), ("d", 2, [0.0, 1.0], 9)], "k string, p int, x array<double>, n int")
    first = aggregate.weighted(df.where("p = 1"), ("k",), "x", 2, "n").first()
    np.testing.assert_allclose(first.probabilities, [0.65, 0.35])
    assert (first.chunk_count, first.token_count) == (2, 4)
    np.testing.assert_allclose(aggregate.by_paragraph(df, "k", "p", "x", 2, "n").first().probabilities, [0.325, 0.675])


def test_backend_errors_stay_in_their_rows(spark):
    class Picky(backends.HashedLogits):
        def __call__(self, ids):
            if any(13 in x for x in ids):
                raise RuntimeError("no")
            return super().__call__(ids)

    df = spark.createDataFrame([("a", [1, 2, 3]), ("b", [13]), ("c", [])], "k string, ids array<int>")
    got = {r.k: r for r in backends.classify(df, "k", "ids", lambda: Picky(("x", "y")), ("x", "y"), 4, 1).collect()}
    assert {k: r.status for k, r in got.items()} == {"a": "success", "b": "error", "c": "error"}
    assert math.isclose(sum(got["a"].probabilities), 1) and got["b"].label is None
    with pytest.raises(ValueError):
        backends.check_labels(backends.HashedLogits(("x",)), ("y",))


def test_extraction_cache_and_provider(spark):
    docs = spark.createDataFrame([("a", "Prices rise."), ("b", "boom"), ("c", "bad keys")], "document_id string, text string")
    work = cache.keyed(docs, "mock", "m", "1")
    first = cache.offline(work).withColumns({"schema_version": F.lit("1.0"), "generated_at": F.lit("2024")})
    held = first.select(*first.columns)
    assert [r.reused for r in cache.probe(work, held).collect()] == [True] * 3
    assert not any(r.reused for r in cache.probe(work, held.withColumn("status", F.lit("error"))).collect())
    calls = []

    def provider(text):
        if text == "boom":
            raise RuntimeError("down")
        return {"x": 1} if text == "bad keys" else {
            "schema_version": "1.0", "policy_stance": "hawkish", "inflation_outlook": None, "labor_market_outlook": None, "economic_growth_outlook": None, "key_risks": [], "policy_rationale": [],
            "supporting_evidence": [{"field": "policy_stance", "quote": "not there", "claim_type": "explicit", "explanation": "e"}], "uncertainties": [], "abstained": False,
        }

    got = {r.document_id: r for r in cache.by_provider(work, provider, attempts=2, sleep=lambda s: calls.append(s)).collect()}
    assert {k: r.status for k, r in got.items()} == {"a": "invalid_evidence", "b": "error", "c": "error"}
    assert got["b"].error == "RuntimeError: down" and got["c"].result is None and got["a"].unsupported_evidence == ["not there"]


def sample(spark, n=200):
    r = np.random.default_rng(0)
    x, z = r.normal(size=n), r.normal(size=n)
    y = 1 + 2 * x - z + r.normal(size=n) * (1 + abs(x))
    pdf = pd.DataFrame({"t": range(n), "x": x, "z": z, "g": ["a", "b"] * (n // 2), "y": y})
    return spark.createDataFrame(pdf), pdf


def test_least_squares_against_numpy(spark):
    df, pdf = sample(spark)
    f = ols.fit(df, ols.design(df, ("x", "z"), "g"), "y")
    X = np.column_stack([np.ones(200), pdf.g == "b", pdf.x, pdf.z]).astype(float)
    y = pdf.y.to_numpy()
    b = np.linalg.lstsq(X, y, rcond=None)[0]
    np.testing.assert_allclose(f.beta, b, rtol=1e-8)
    e, inv = y - X @ b, np.linalg.inv(X.T @ X)
    h = np.einsum("ij,jk,ik->i", X, inv, X)
    np.testing.assert_allclose(f.hc3(df), inv @ ((X * (e**2 / (1 - h) ** 2)[:, None]).T @ X) @ inv, rtol=1e-6)
    u = X * e[:, None]
    middle = u.T @ u
    for k in range(1, 4):
        g = u[k:].T @ u[:-k]
        middle += (1 - k / 4) * (g + g.T)
    np.testing.assert_allclose(f.hac(df, 3, "t"), inv @ middle @ inv, rtol=1e-6)
    d = f.diagnostics(df, "t")
    assert math.isclose(d["durbin_watson"], ((e[1:] - e[:-1]) ** 2).sum() / (e**2).sum(), rel_tol=1e-8)
    cook = e**2 * h / (4 * (e @ e / 196) * (1 - h) ** 2)
    assert math.isclose(f.influence(df)["max_cook"], cook.max(), rel_tol=1e-8) and f.influence(df)["influential"] == (cook > 4 / 200).sum()
    r2 = np.corrcoef(pdf.x, np.column_stack([np.ones(200), pdf.g == "b", pdf.z]).astype(float) @ np.linalg.lstsq(np.column_stack([np.ones(200), pdf.g == "b", pdf.z]).astype(float), pdf.x, rcond=None)[0])[0, 1] ** 2
    assert math.isclose(f.vif()["x"], 1 / (1 - r2), rel_tol=1e-6)
    F_, p, q = f.wald(f.plain(), ("z",))
    assert q == 1 and math.isclose(F_, f.table(f.plain())[3][3] ** 2, rel_tol=1e-8) and math.isclose(p, f.table(f.plain())[3][4], rel_tol=1e-6)
    models = ols.hierarchy(df, ("x",), [("more", ("z",))], "g", "y", 1, "t")
    assert [m["model"] for m in models] == ["baseline", "more"] and models[1]["adjusted_r_squared"] > models[0]["adjusted_r_squared"] and "delta_aic" in models[1]


def test_distributions():
    assert math.isclose(dist.t_two_sided(2.0, 10), 0.0733880348, rel_tol=1e-7) and math.isclose(dist.t_quantile(0.05, 10), 2.228138852, rel_tol=1e-7)
    assert math.isclose(dist.f_upper(3.0, 2, 20), 1.3**-10, rel_tol=1e-9) and math.isclose(dist.chi2_upper(3.841458821, 1), 0.05, rel_tol=1e-7)
    assert math.isclose(dist.chi2_upper(2.0, 2), math.exp(-1), rel_tol=1e-9) and math.isclose(dist.normal_two_sided(1.959963985), 0.05, rel_tol=1e-7)


def test_rank_statistics(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "a"), (2.0, "b"), (4.0, "b"), (9.0, "c")], "v double, g string")
    k = rank_tests.kruskal(df, "v", "g")
    ranks = {"a": [1, 2.5], "b": [2.5, 4]}
    h = (12 / (4 * 5) * sum(sum(r) ** 2 / 2 for r in ranks.values()) - 15) / (1 - 6 / 60)
    assert k["groups"] == 2 and math.isclose(k["h"], h)
    w = rank_tests.signed_rank(spark.createDataFrame([(1.0,), (-2.0,), (3.0,), (0.0,), (4.0,)], "v double"), "v")
    assert (w["n"], w["w"]) == (4, 2.0) and math.isnan(rank_tests.signed_rank(df.where("v > 99"), "v")["w"])
    p = spark.createDataFrame([("f", 0.01), ("f", 0.04), ("f", 0.03)], "f string, p double")
    assert [round(r.p_holm, 4) for r in rank_tests.holm(p, "p", "f").orderBy("p").collect()] == [0.03, 0.06, 0.06]
    c = rank_tests.correlations(df.withColumn("w", F.col("v") ** 2), "v", "w")
    assert math.isclose(c["spearman_rho"], 1.0) and c["pearson_p_value"] < 0.05
    assert rank_tests.describe(df, "v", "g").where("g = 'c'").first().sd is None
    m = rank_tests.mean_test(df, "v")
    assert m["ci_lower"] < m["mean"] < m["ci_upper"]


def test_views(spark):
    ev = spark.createDataFrame([(d, float(i), 1.0 - i) for i, d in enumerate(days(0, 1, 2))], "event_date date, share_a double, share_b double")
    rolled = [r.share_a_rolling for r in views.rolling(ev, ("share_a",), 2).orderBy("event_date").collect()]
    assert rolled == [0.0, 0.5, 1.5]
    assert {r.stance for r in views.long_shares(ev, ("event_date",), ("share_a", "share_b"), "share_").collect()} == {"a", "b"}
    c = spark.createDataFrame([("Intercept", 1.0, 0.0, 2.0, 0.01), ("x", 1.0, 0.5, 2.5, 0.2)], "term string, coefficient double, ci_lower double, ci_upper double, p_value double")
    assert tuple(views.coefficient_arms(c).select("arm_up", "arm_down", "significant").first()) == (1.5, 0.5, False)


def test_sources_and_sinks(spark, tmp_path):
    p = tmp_path / "c.csv"
    p.write_text('﻿url,doc_type,date,text,year,meeting\nu,s,2020-01-01,"a ""q""\nNA",2020,\n', encoding="utf-8")
    (row,) = files.corpus(spark, str(p)).collect()
    assert row.text == 'a "q"\nNA' and row.meeting is None
    assert files.csv(spark, str(p), keep_empty=True).first().meeting == ""
    with pytest.raises(ValueError, match="missing"):
        files.csv(spark, str(p), ("missing",))
    s = files.series_from_text(spark, "DATE,DGS2\n2020-01-02,1.5\n2020-01-03,.\n", "DGS2").orderBy("trading_date").collect()
    assert [r.DGS2 for r in s] == [1.5, None]
    lines = tmp_path / "x.jsonl"
    lines.write_text('{"a": 1}\n{bad\n')
    with pytest.raises(Exception):
        files.json_lines(spark, str(lines), "a int").collect()
    sinks.report(str(tmp_path / "r.json"), {"b": float("nan"), "a": (1, 2)})
    assert (tmp_path / "r.json").read_text().split() == ["{", '"a":', "[", "1,", "2", "],", '"b":', "null", "}"]
    assert len(files.file_hashes(spark, str(p)).first().sha256) == 64 and files.exists(spark, str(p)) and not files.exists(spark, str(tmp_path / "no"))
    sinks.table(spark.range(4).withColumn("k", F.col("id") % 2), str(tmp_path / "t"), by=("k",))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4
    train = spark.createDataFrame([("s", 1, 2000)], "sentence string, label int, year int")
    out = files.labelled_splits(train, train.drop("year"), {0: "dovish", 1: "hawkish"})
    assert {r.policy_stance for r in out.collect()} == {"hawkish"} and "year" in out.columns
    with pytest.raises(ValueError):
        files.labelled_splits(train.withColumn("label", F.lit(9)), train, {1: "hawkish"})


def test_stream_equals_batch(spark, sf_small, tmp_path):
    stored = spark.read.parquet(f"{sf_small}/events.parquet")
    sinks.table(stored, str(tmp_path / "in"))
    stream = spark.readStream.schema(stored.schema).parquet(str(tmp_path / "in"))
    counts.drain(counts.daily(stream), lambda b, k: b.write.mode("overwrite").parquet(str(tmp_path / "out")), str(tmp_path / "cp"), "complete")
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted(map(tuple, counts.daily(stored).collect()))


def test_topics_and_classifier(spark):
    df = spark.createDataFrame([(i, t, float(i % 2)) for i, t in enumerate(["rates rise inflation prices", "jobs labor hiring wages"] * 6)], "i int, text string, label double")
    _, assigned, leading = topics.lda(df, "text", 2, terms=3, iterations=5)
    assert assigned.count() == 12 and leading.groupBy("topic").count().where("count = 3").count() == 2
    model = topics.stance_classifier(df, "text", "label", 256)
    assert model.transform(df).where("prediction = label").count() == 12


def test_settings():
    base = {"root": "/r", "corpus": "c.csv", "series": "v.csv"}
    assert config.load(base, {"TIDEMARK_SEED": "7"}).seed == 7
    for bad in ({"stride": 510}, {"provider": "other"}, {"max_length": 0}, {"nonsense": 1}):
        with pytest.raises(ValueError):
            config.load(base | bad, {})


def test_topics_learn_from_every_document(spark):
    """One iteration over all documents gives each topic-term weight its whole count: priors plus all words."""
    docs = spark.createDataFrame([(i, f"alpha beta gamma word{chr(97 + i % 5)}x only{chr(97 + i % 26)}y") for i in range(300)], "doc_id long, text string")
    for seed in (1, 2):
        model, _, _ = topics.lda(docs, "text", 3, seed=seed, max_df=10**6, iterations=1)
        fitted = model.stages[-1]
        v = fitted.vocabSize()
        assert abs(fitted.topicsMatrix().toArray().sum() - (300 * 5 + v)) < 1e-3
    assert topics.MOST_TERMS > 262_144
    assert set(queries_models.q_topics_lda(spark, "/root/testdata/sf0.001").columns) == {"doc_id", "topic", "topic_weight"}
