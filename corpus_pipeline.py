"""A corpus from raw documents to packed sequences, in five stages.

Each stage works on all that the one before kept. All but the last return the columns of
``documents``: the quality classifier drops what it rejects, of each group of near duplicates one
document stays, contaminated documents go, personal data is replaced by its kind, and what is left
is cut and packed into sequences.

Rows with null columns, repeated rows, empty and very long texts and further columns, whatever their names, go
through all stages as each stage's operator says: null and empty texts are scored as empty, are never near
duplicates, contaminated or personal, and are packed as an end id if the classifier keeps them; of equal rows
one stays. Ties are settled by the smaller doc_id. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontamination, jaccard_join, packing_cutting_stock, pii_bootstrap, quality_qda
from tidemark.llm.common import Columns, Stored, table

#: Documents with a lower score are rejected; clean documents score far above it.
LEAST_QUALITY = 0.5
#: Near duplicates share this part of their shingles of so many words.
SHINGLE_WORDS, SIMILARITY = 5, (8, 10)
SEQUENCE_LENGTH = 2048


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_qda.keep_good(docs, table(spark, sf_dir, "labels"), LEAST_QUALITY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs, SHINGLE_WORDS, *SIMILARITY)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.remove(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii_bootstrap.redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing_cutting_stock.pack(docs, public_tokenizers.path("word_bpe_49k.json"), SEQUENCE_LENGTH, remember=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("benchmark_passages", benchmark_passages),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Token ids and the trained classifier can't be told in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Stored(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            own = Columns(docs)
            docs = own.back(store.keep(own.df, name))
    return docs
