"""Paged sources: failures in the middle of a page, restarts of a stream; line numbers of bad records."""

import os

import pytest

from tidemark.sources import files, paged


def counted(folder):
    """Three rows a page; page 1 breaks twice after its first row, page 7 always."""

    def fetch(number):
        path = os.path.join(folder, str(number))
        with open(path, "a") as f:
            f.write("x")
        for i in range(3):
            if i and (number == 7 or (number == 1 and os.path.getsize(path) < 3)):
                raise OSError("broken off")
            yield number, i

    return fetch


def test_pages_are_read_whole_or_not_at_all(spark, tmp_path):
    form = paged.source("test_pages", "page int, row int", counted(str(tmp_path)), lambda: 5, wait=0.0)
    df = paged.read(spark, form)
    assert df.rdd.getNumPartitions() == 5
    for p in tmp_path.iterdir():
        p.unlink()
    assert sorted(map(tuple, df.collect())) == [(p, i) for p in range(5) for i in range(3)]
    assert {p.name: p.stat().st_size for p in tmp_path.iterdir()} == {"0": 1, "1": 3, "2": 1, "3": 1, "4": 1}
    broken = paged.read(spark, paged.source("broken_pages", "page int, row int", counted(str(tmp_path)), lambda: 8, wait=0.0))
    with pytest.raises(Exception, match="broken off"):
        broken.collect()


def test_a_stream_goes_on_behind_the_last_page(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    known = tmp_path / "known"

    def pages():
        return int(known.read_text())

    fetch = counted(str(calls))
    for there, least in ((3, 3), (3, 3), (6, 6)):
        known.write_text(str(there))
        rows = paged.stream(spark, paged.source("stream_pages", "page int, row int", fetch, pages, wait=0.0, most=2))
        q = rows.writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/checkpoint").trigger(processingTime="0 seconds").start(f"file://{tmp_path}/out")
        try:
            for _ in range(200):
                q.processAllAvailable()
                if os.path.isdir(tmp_path / "out" / "_spark_metadata") and spark.read.schema("page int, row int").parquet(f"file://{tmp_path}/out").count() >= 3 * least:
                    break
        finally:
            q.stop()
        assert sorted(map(tuple, spark.read.schema("page int, row int").parquet(f"file://{tmp_path}/out").collect())) == [(p, i) for p in range(there) for i in range(3)]


def test_a_bad_line_is_named_whatever_the_pieces(spark, tmp_path):
    lines = ['{"a": %d, "b": "%s"}' % (i, "x" * (i % 40)) for i in range(500)]
    lines[17] = ""
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.jsonl").write_text("\n".join([*lines[:321], "{broken", *lines[321:400], "[]"]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("700", before):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            with pytest.raises(ValueError, match=r"^b\.jsonl, line 322: not a record$"):
                files.json_lines(spark, f"file://{tmp_path}", "a long, b string")
            assert files.json_lines(spark, f"file://{tmp_path}/a.jsonl", "a long, b string").count() == 499
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
