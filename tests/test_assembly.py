"""Checks of joins, sources, sinks, logs and settings that queries don't show."""

import datetime
import io
import json
import logging

import pandas as pd
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from tidemark import __main__ as command
from tidemark import config, log
from tidemark.functions import identity, stance, text
from tidemark.operators import assemble, backends, ingest, ranks, summaries
from tidemark.sources import files, sinks


def test_joins_name_what_is_wrong(spark):
    docs = spark.createDataFrame([(1, "statement"), (2, "minutes")], "id int, kind string")
    preds = spark.createDataFrame([(1, "success", "a"), (2, "error", None)], "id int, status string, label string")
    assert assemble.with_predictions(docs, preds, "id", ("label",)).count() == 2
    for bad in (preds.union(preds), preds.where("id = 1"), preds.drop("label")):
        with pytest.raises(ValueError):
            assemble.with_predictions(docs, bad, "id", ("label",))
    with pytest.raises(ValueError, match=r"\[2\]"):
        assemble.with_domain_policy(docs, preds, "id", "status", (), F.lit(True))
    assert assemble.with_domain_policy(docs, preds, "id", "status", (), F.col("kind") == "statement").count() == 2
    truth = spark.createDataFrame([(1, "a")], "id int, truth string")
    assert [tuple(r) for r in assemble.judged(truth, preds, "id", "status", (("truth", "label"),)).collect()] == [(1, "truth", "a", "a")]
    for annotations in (truth.limit(0), docs.select("id", F.col("kind").alias("truth")), truth.withColumn("truth", F.lit(None).cast("string"))):
        with pytest.raises(ValueError):
            assemble.judged(annotations, preds, "id", "status", (("truth", "label"),))
    with pytest.raises(ValueError):
        assemble.looked_up(docs, truth, "id")
    with pytest.raises(ValueError, match="not the sample's"):
        assemble.at_positions(truth, docs.withColumnRenamed("kind", "truth"), "id", "truth")


def test_dashboard_is_sorted_and_dates_are_lenient(spark):
    docs = spark.createDataFrame([(1, "2001-02-03"), (2, "no date"), (3, "2002-01-01")], "id int, publication_date string")
    side = spark.createDataFrame([(1, 0.5)], "id int, x double")
    events = spark.createDataFrame([("2002-01-01", "b"), ("2001-01-01", "a")], "event_date string, event_era string")
    a, b = assemble.dashboard(docs, side, side.withColumnRenamed("x", "y"), events, "id", ("x",), ("y",))
    assert [(r.id, r.publication_date and r.publication_date.year, r.x) for r in a.collect()] == [(3, 2002, None), (1, 2001, 0.5), (2, None, None)]
    assert [r.event_era for r in b.collect()] == ["a", "b"]


def test_boolean_text_is_strict(spark):
    df = spark.createDataFrame([(" True", True), ("FALSE", None)], "t string, b boolean")
    assert [r.t for r in ingest.require_truth(df, "t").collect()] == [True, False]
    assert [r.b for r in ingest.require_truth(df, "b").collect()] == [True, False]
    for bad in ("yes", "", None):
        with pytest.raises(ValueError):
            ingest.require_truth(spark.createDataFrame([(bad,)], "t string"), "t")


def test_ranks_and_quantiles_of_ties(spark):
    df = spark.range(0, 4000).select((F.col("id") % 7).cast("double").alias("v"), (F.col("id") % 3).alias("g"))
    counts = df.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    got = {r.v: r.below for r in ranks.below(counts, "v", "n").collect()}
    assert got == {float(v): sum(1 for i in range(4000) if i % 7 < v) for v in range(7)}
    dealt = ranks.dealt(df.withColumn("id", F.monotonically_increasing_id()), "g", "id", 1).collect()
    for g in range(3):
        own = sorted(r["__rank"] for r in dealt if r.g == g)
        assert own == list(range(1, len(own) + 1))


def test_sources_with_loaders(spark, tmp_path):
    raw = pd.DataFrame({"Close": [1.0, 2.0], "Adj Close": [1.5, 2.5]}, index=pd.to_datetime(["2020-01-02 23:00+00:00", "2020-01-03 01:00+00:00"]))
    asked = []
    got = files.index_prices(spark, lambda a, b: asked.append((a, b)) or raw, "2020-01-02", "2020-01-31").collect()
    assert asked == [("2020-01-02", "2020-02-01")] and [(r.trading_date, r.value) for r in got] == [(datetime.date(2020, 1, 2), 1.5), (datetime.date(2020, 1, 3), 2.5)]
    with pytest.raises(ValueError):
        files.index_prices(spark, lambda a, b: raw[[]], "2020-01-02", "2020-01-31")
    frame = pd.DataFrame({"sentence": ["x"], "label": [1]})
    assert files.pinned(spark, lambda n, r: {"train": frame, "test": frame}, "d", "0" * 40)[1].count() == 1
    for revision, tables in (("main", {"train": frame, "test": frame}), ("0" * 40, {"train": frame})):
        with pytest.raises(ValueError):
            files.pinned(spark, lambda n, r, t=tables: t, "d", revision)
    df = spark.createDataFrame([(" a ", "test"), ("b", "train ")], "x string, split string")
    assert [r.x for r in files.stripped(df, "train").collect()] == ["b"]
    with pytest.raises(ValueError):
        files.stripped(df, "valid")
    (tmp_path / "c.jsonl").write_text('{"a": 1}\n\n{"a": 2}\nnot json\n')
    with pytest.raises(ValueError, match="line 4"):
        files.json_lines(spark, str(tmp_path / "c.jsonl"), "a int")
    (tmp_path / "d.jsonl").write_text('{"a": 1}\n{"b": 2}\n')
    assert [r.a for r in files.json_lines(spark, str(tmp_path / "d.jsonl"), "a int").collect()] == [1, None]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None)], "b int, a string")
    sinks.records(df, str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).first()[0] == '{"a":null,"b":1}'
    sinks.pair((str(tmp_path / "x"), "1"), (str(tmp_path / "y"), "2"))
    assert (tmp_path / "x").read_text() + (tmp_path / "y").read_text() == "12" and len(list(tmp_path.iterdir())) == 3
    with pytest.raises(OSError):
        sinks.pair((str(tmp_path / "x"), "3"), (str(tmp_path / "y" / "z"), "4"))
    assert (tmp_path / "x").read_text() == "1"
    sinks.model(Pipeline(stages=[SQLTransformer(statement="SELECT * FROM __THIS__")]).fit(df), f"file://{tmp_path}/m", {"rows": 1, "score": float("nan")})
    assert json.loads(spark.read.text(f"file://{tmp_path}/m/provenance").first()[0]) == {"rows": 1, "score": None}


def test_logs_and_settings(tmp_path):
    out = io.StringIO()
    root = logging.getLogger()
    before = root.handlers[:], root.level
    try:
        log.configure("info", stream=out)
        logging.getLogger("t").info("done %s", 1, extra={"rows": 3})
        try:
            raise KeyError("k")
        except KeyError:
            logging.getLogger("t").exception("failed")
        with pytest.raises(ValueError):
            log.configure("loud")
    finally:
        root.handlers[:], _ = before
        root.setLevel(before[1])
    a, b = map(json.loads, out.getvalue().splitlines())
    assert (a["message"], a["level"], a["context"]) == ("done 1", "INFO", {"rows": 3}) and "KeyError" in b["exception"]
    (tmp_path / "s.yaml").write_text("paths:\n  root: /x\n  corpus: c\n  series: s\nseed: 7\n")
    assert config.read(str(tmp_path / "s.yaml"), {"TIDEMARK_SEED": "9"}).seed == 9
    (tmp_path / "l.yaml").write_text("- 1\n")
    with pytest.raises(ValueError):
        config.read(str(tmp_path / "l.yaml"), {})


def test_models_and_tokenizers(spark):
    for a, b in (("x/y", "x/z"), ("", "")):
        with pytest.raises(ValueError):
            identity.require_pair(a, b)
    identity.require_pair(" X\\Y/ ", "x/y")

    class Lengths:
        name = "m/one/"

        def __call__(self, words):
            return [len(w) for w in words.split()]

    ids = backends.tokens_udf(Lengths, "M/one")
    df = spark.createDataFrame([(1, 0, "a bb ccc " * 30), (1, 1, "dd"), (2, 0, None)], "k int, par int, t string").withColumn("ids", ids("t"))
    make = lambda: backends.HashedLogits(("p", "q"))
    whole = df.where("par = 0")
    by = {a: {r.k: r for r in backends.classify(whole, "k", "ids", make, ("p", "q"), 34, 4, a).collect()} for a in backends.AGGREGATIONS[:2]}
    for rows in by.values():
        assert rows[1].status == "success" and abs(sum(rows[1].probabilities) - 1) < 1e-9 and rows[2].status == "error"
        assert rows[1].chunk_count == 4 and rows[1].token_count == by[backends.AGGREGATIONS[0]][1].token_count
    par = {r.k: r for r in backends.classify(df, "k", "ids", make, ("p", "q"), 34, 4, "paragraph_mean", "par").collect()}
    assert par[1].chunk_count == 5 and par[2].status == "error"
    with pytest.raises(ValueError):
        backends.classify(df, "k", "ids", make, ("p", "q"), aggregation="paragraph_mean")


def test_negations_turn_only_what_follows(spark):
    df = spark.createDataFrame([("They raise the rate. Not to raise the rate.",), ("No one will ever again think to raise the rate.",), (None,)], "t string")
    got = [r.s for r in df.select(stance.stance(F.col("t")).alias("s")).collect()]
    assert [(len(s.hawkish_matches), len(s.evidence), s.stance) for s in got] == [(1, 1, "hawkish"), (1, 1, "hawkish"), (0, 0, "insufficient_evidence")]
    windows = spark.createDataFrame([([1, 2, 3, 4, 5],), ([],), (None,)], "x array<int>").select(text.token_windows(F.col("x"), 5, 1).alias("w")).collect()
    assert [r.w for r in windows] == [[[1, 2, 3], [3, 4, 5]], None, None]


def test_numbers_without_names(spark):
    df = spark.createDataFrame([(1, "x", 2.0, 3)], "a int, b string, c double, `Unnamed: 0` int")
    assert summaries.numeric(df).columns == ["a", "c"]


def test_command_prints_a_summary(spark, sf_small, capsys, tmp_path):
    summary = command.main(["q_holm_written_back", sf_small, str(tmp_path / "out"), "--log-level", "ERROR"])
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == {**summary} and summary["rows"] == 25
