import importlib

import numpy as np
import public_tokenizers
import pytest

from tidemark.llm import pii_bootstrap, quality_qda
from tidemark.llm.wordcache import WordCache

from .conftest import ODD, frame
from .test_decontamination import brute as contaminated
from .test_jaccard import brute as components
from .test_packing import check_pieces
from .test_pii import brute as seeds

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_run_equals_the_stages_by_hand(spark, sf_small):
    """Kept documents, redaction and packing against brute force; the classifier's scores are its own."""
    documents = spark.read.parquet(f"{sf_small}/documents.parquet")
    labels = spark.read.parquet(f"{sf_small}/labels.parquet")
    score = {r.doc_id: r.score for r in quality_qda.score(documents, labels).collect()}
    texts = {r.doc_id: r.text for r in documents.collect() if score[r.doc_id] >= corpus_pipeline.LEAST_QUALITY}
    assert len(texts) < len(score)
    groups = components(list(texts.items()), 5, 8, 10)
    texts = {i: t for i, t in texts.items() if groups[i][1] == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()]
    texts = {i: t for i, t in texts.items() if not contaminated(t, items)[4]}
    for i, t in texts.items():
        at, out = 0, ""
        for span in filter(None, seeds(t).split(",")):
            kind, a, b = span.split(":")
            if int(a) >= at:
                out += t[at : int(a)] + f"<{kind.upper()}>"
            at = max(at, int(b))
        texts[i] = out + t[at:]
    rows = corpus_pipeline.run(spark, sf_small).collect()
    check_pieces(rows, list(texts.items()), WordCache(public_tokenizers.path("word_bpe_49k.json")), corpus_pipeline.SEQUENCE_LENGTH)


def test_stages_return_the_columns_of_documents(spark, sf_small):
    documents = spark.read.parquet(f"{sf_small}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "benchmark_passages", "personal_data", "packing"]
    for _, stage in corpus_pipeline.STAGES[2:4]:
        assert stage(spark, documents, sf_small).columns == documents.columns


def test_import_needs_nothing_else():
    assert importlib.import_module("corpus_pipeline").ORACLE_SQL is None
    assert np.isfinite(corpus_pipeline.LEAST_QUALITY) and pii_bootstrap.KINDS


def test_run_on_odd_rows(spark, monkeypatch):
    """Nulls, empty and long texts, repeated rows and clashing names go through all stages; an empty table too."""
    pairs = [*ODD, (None, None), (None, "a text without an id, as there may be"), (None, "a text without an id, as there may be"), (20, "é" * 200_000), (21, "word " * 100_000)]
    tables = {"documents": frame(spark, pairs), "labels": spark.createDataFrame([], "doc_id long, quality int, toxic int"), "benchmark": spark.createDataFrame([(None, None), ("x", "")], "item_id string, text string")}
    monkeypatch.setattr(corpus_pipeline, "table", lambda s, d, name: tables[name])
    rows = corpus_pipeline.run(spark, "nowhere").collect()
    kept = {r.doc_id for r in rows}
    assert {1, 2, 3, 4, 5, 6, 8, 9, 20, 21, None} <= kept and 7 not in kept  # 7 has the text of 6
    tables["documents"] = frame(spark, [])
    assert corpus_pipeline.run(spark, "nowhere").collect() == []
