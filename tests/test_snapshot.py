"""Versions of several tables: crashes between files, mixtures, changed rows."""

import shutil

import pytest

from tidemark import __main__ as command
from tidemark.sources import snapshot

NEEDS = {"documents": ("id", "text"), "events": ("day",)}


def tables(spark, n):
    return {"documents": spark.range(n).selectExpr("id", "concat('t', id) as text").repartition(3), "events": spark.range(n).selectExpr("id as day"), "notes": spark.range(1).selectExpr("'x' as note")}


def test_a_reader_sees_whole_versions_only(spark, tmp_path):
    folder = f"file://{tmp_path}/snap"
    with pytest.raises(snapshot.Mismatch):
        snapshot.load(spark, folder, NEEDS)
    assert snapshot.commit(spark, folder, tables(spark, 10)) == 1
    assert {k: v.count() for k, v in snapshot.load(spark, folder, NEEDS).items()} == {"documents": 10, "events": 10}

    class Lost(Exception):
        pass

    class Half(dict):
        """A writer that is lost between the tables."""

        def items(self):
            yield "documents", self["documents"]
            raise Lost

    with pytest.raises(Lost):
        snapshot.commit(spark, folder, Half(tables(spark, 20)))
    assert snapshot.versions(spark, folder) == [1] and snapshot.load(spark, folder, NEEDS)["documents"].count() == 10
    assert snapshot.commit(spark, folder, tables(spark, 30)) == 2
    assert snapshot.load(spark, folder, NEEDS)["events"].count() == 30 and snapshot.load(spark, folder, NEEDS, 1)["events"].count() == 10


def test_mixtures_and_changes_are_refused(spark, tmp_path):
    folder, local = f"file://{tmp_path}/snap", tmp_path / "snap"
    snapshot.commit(spark, folder, tables(spark, 10))
    snapshot.commit(spark, folder, tables(spark, 11))
    one, two = sorted(local.glob("versions/*/documents"), key=lambda p: spark.read.parquet(f"file://{p}").count())
    shutil.copytree(two, one.parent / "kept")
    shutil.rmtree(two)
    with pytest.raises(snapshot.Mismatch, match="gone"):
        snapshot.load(spark, folder, NEEDS)
    shutil.copytree(one, two)  # the other version's table
    with pytest.raises(snapshot.Mismatch, match="version 2"):
        snapshot.load(spark, folder, NEEDS)
    assert snapshot.load(spark, folder, {"events": ("day",)})["events"].count() == 11
    shutil.rmtree(two)
    spark.range(11).selectExpr("id", "concat('u', id) as text").write.parquet(f"file://{two}")  # as many rows, other words
    with pytest.raises(snapshot.Mismatch):
        snapshot.load(spark, folder, NEEDS)
    for needs in ({"documents": ("id", "nothing")}, {"others": ()}):
        with pytest.raises(snapshot.Mismatch):
            snapshot.load(spark, folder, needs, 1)
    with pytest.raises(snapshot.Mismatch):
        snapshot.load(spark, folder, NEEDS, 9)


def test_empty_tables_and_nulls_have_a_fingerprint(spark):
    empty = spark.createDataFrame([], "a int, b string")
    assert snapshot.fingerprint(empty) == {"rows": 0, "hash": "0:0"}
    x = spark.createDataFrame([(1, None), (None, "1")], "a int, b string")
    y = spark.createDataFrame([(None, "1"), (1, None)], "a int, b string")
    z = spark.createDataFrame([(None, None), (1, "1")], "a int, b string")
    assert snapshot.fingerprint(x) == snapshot.fingerprint(y) != snapshot.fingerprint(z)


def test_the_command_tells_how_many_rows_it_wrote(spark, sf_small, tmp_path):
    out = f"file://{tmp_path}/out"
    told = command.main(["q_source_rows", sf_small, out, "--log-level", "ERROR"])
    assert told["rows"] == spark.read.parquet(out).count() == command.main(["q_source_rows", sf_small, "--log-level", "ERROR"])["rows"]
