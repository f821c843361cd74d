"""One registered query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann_hnsw, chat_preference, decontamination, hard_negatives, jaccard_join, oracles, packing_best_fit, packing_cutting_stock, pii_bootstrap, quality_qda, source_mixing, token_alignment, toxicity_fm, url_automaton
from .common import table


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _word_vocabulary() -> str:
    return _vocabulary("word_bpe_49k.json")


def _fold(n: int) -> Column:
    """The remainder that decides which labels may be learnt from."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def op1_toxicity_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity_fm.score(docs, labels, "toxic", _fold(5) != 0)
    return scored.select("doc_id", (_fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_best_fit.pack(table(spark, sf_dir, "documents"), _word_vocabulary())


def op3_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_bootstrap.find(table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, pii_bootstrap.KINDS), F.sha2(pii_bootstrap.joined(F.col("base")), 256).alias("base_sha256"), pii_bootstrap.joined(F.col("spans")).alias("spans"))


def op4_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_cutting_stock.pack(table(spark, sf_dir, "documents"), _word_vocabulary())


def op5_small_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_hnsw.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_url_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_automaton.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_components(table(spark, sf_dir, "documents"), k=3, p=90, q=100).select("doc_id", "n_shingles", "component_id")


def op9_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    pairs, rejected = chat_preference.answers_swapped(turns)
    return chat_preference.format_pairs(turns, pairs, rejected)


def op10_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality_qda.score(docs, labels, "quality", _fold(4) != 2)
    return scored.select("doc_id", (_fold(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = token_alignment.align(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), _vocabulary("piece_bpe_32k.model"))
    return found.select("doc_id", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", F.col("n_best_b").alias("n_best"), "count_sum", F.col("groups").alias("groups_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


_OPERATORS = (
    op1_toxicity_machine, op2_token_matrices, op3_contextual_pii, op4_cutting_stock, op5_small_world, op6_decontamination, op7_url_automaton, op8_jaccard_join, op9_preference_pairs,
    op10_quality_discriminant, op11_token_alignment, op12_hard_negatives, op13_source_mixing,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {
        "op6_decontamination": oracles.DECONTAMINATION, "op7_url_automaton": oracles.url_filter(), "op8_jaccard_join": oracles.JACCARD, "op9_preference_pairs": oracles.PREFERENCES,
        "op12_hard_negatives": oracles.HARD_NEGATIVES, "op13_source_mixing": oracles.SOURCE_MIXING,
    }
