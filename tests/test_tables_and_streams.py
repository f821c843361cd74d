"""Table functions in SQL, and the extraction stream over restarts."""

import json
import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidemark.functions import tables, text
from tidemark.streaming import extraction


def test_windows_go_on_over_the_rows_of_a_partition(spark):
    tables.register(spark)
    df = spark.createDataFrame([(1, "a", [1, 2, 3, 4, 5], "x"), (1, "b", [7, 8], "y"), (2, "c", None, "z"), (2, "d", [], "z"), (3, "e", [9], "w")], "id int, part string, ids array<int>, window2 string")
    df.createOrReplaceTempView("token_docs")
    got = spark.sql("SELECT * FROM token_windows(TABLE(token_docs) PARTITION BY (id) ORDER BY (part), 'ids', 5, 1)")
    assert got.columns == ["id", "part", "window2", "window", "ids"]
    assert sorted(map(tuple, got.collect())) == [(1, "a", "x", 0, [1, 2, 3]), (1, "a", "x", 1, [3, 4, 5]), (1, "b", "y", 2, [7, 8]), (3, "e", "w", 0, [9])]
    for call in ("token_windows(TABLE(token_docs), 'part', 5, 1)", "token_windows(TABLE(token_docs), 'none', 5, 1)", "token_windows(TABLE(token_docs), 'ids', 5, 3)", "token_windows(TABLE(token_docs), 'ids', 2, 0)"):
        with pytest.raises(AnalysisException):
            spark.sql(f"SELECT * FROM {call}").collect()


def test_table_functions_equal_the_expressions(spark, sf_small):
    tables.register(spark)
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, " \x1c. A\xa0\n b! “C”?  9 x.\tD"), (-4, "a.b. C\r\nd")], "doc_id long, text string")
    docs = docs.unionByName(odd)
    want = docs.select("doc_id", F.posexplode(text.sentences_by_line(F.col("text"))).alias("sentence", "text"))
    got = spark.sql("SELECT d.doc_id, s.* FROM {docs} AS d, LATERAL sentences(d.text) AS s", docs=docs)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    ids = docs.select("doc_id", F.transform(F.split("text", r"\s+"), lambda w: F.length(w)).alias("ids"))
    for length, stride in ((66, 8), (5, 2), (3, 0)):
        want = ids.select("doc_id", F.posexplode(text.token_windows(F.col("ids"), length, stride)).alias("window", "ids"))
        got = spark.sql("SELECT * FROM token_windows(TABLE(SELECT * FROM {ids}) PARTITION BY (doc_id), 'ids', {length}, {stride})", ids=ids, length=length, stride=stride)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


class Provider:
    """Counts calls in a file, which all workers share, and fails as often as a text's first number says."""

    def __init__(self, folder):
        self.folder = folder

    def __call__(self, text, attempt):
        path = os.path.join(self.folder, "none" if text is None else text.replace(" ", "_") or "tick")
        with open(path, "a") as f:
            f.write("x")
        if os.path.getsize(path) <= int((text or "0").split()[0]):
            raise OSError("down")
        return {"text": text}


def test_restarts_answer_each_request_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    base = f"file://{tmp_path}"

    def step(rows, at, later):
        df = spark.createDataFrame(rows, "document_id string, text string")
        extraction.asked(df, at).unionByName(extraction.tick(spark, later)).write.mode("append").parquet(f"{base}/in")
        extraction.run(extraction.requests(spark, f"{base}/in"), f"{base}/out", f"{base}/checkpoint", Provider(str(calls)), attempts=3, wait=60)
        return sorted(tuple(r)[:1] + tuple(r)[2:4] for r in spark.read.schema(extraction.ANSWERS).parquet(f"{base}/out").where("document_id <> ''").collect())

    rows = [("a", "0 fine"), ("b", "1 late"), ("c", "9 never"), ("d", None)]
    first = step(rows, "2024-01-01 00:00:00", "2024-01-01 01:00:00")
    assert first == [("a", "success", 1), ("b", "success", 2), ("d", "success", 1)]
    second = step([*rows, ("a", "0 changed"), ("a", "0 fine")], "2024-01-01 02:00:00", "2024-01-01 03:00:00")
    assert second == sorted([*first, ("a", "reused", 1), ("a", "reused", 1), ("a", "success", 1), ("b", "reused", 2), ("c", "error", 3), ("d", "reused", 1)])
    # Nothing new: nothing happens. A request for what has failed begins anew, and its retries wait for the next start.
    assert step([], "2024-01-01 04:00:00", "2024-01-01 04:30:00") == second
    third = step([("c", "9 never")], "2024-01-01 05:00:00", "2024-01-01 06:00:00")
    assert third == second
    last = step([], "2024-01-01 07:00:00", "2024-01-01 08:00:00")
    assert last == sorted([*second, ("c", "error", 3)])
    made = {p.name: p.stat().st_size for p in calls.iterdir()}
    assert made["0_fine"] == 1 and made["1_late"] == 2 and made["9_never"] == 6 and made["none"] == 1 and made["0_changed"] == 1
    payload = [json.loads(r.payload) for r in spark.read.schema(extraction.ANSWERS).parquet(f"{base}/out").where("document_id = 'b' and payload is not null").collect()]
    assert payload == [{"text": "1 late"}]
