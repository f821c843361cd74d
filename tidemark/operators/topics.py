"""Topics: word counts, pruned vocabularies, LDA and its substitutes for a stance classifier."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words
from .lda import train

#: The largest vocabulary that Spark can count: pruning by documents alone decides about terms.
MOST_TERMS = 2**31 - 1


def term_counts(docs: DataFrame, text: str, stop_words: tuple[str, ...] = ()) -> DataFrame:
    terms = docs.select(F.explode(words(F.col(text), stop_words)).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def pruned_vocabulary(docs: DataFrame, key: str, text: str, least: int, share: float, stop_words: tuple[str, ...] = ()) -> DataFrame:
    """Terms in at least ``least`` documents and at most ``share`` of them."""
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    terms = docs.select(key, F.explode(F.array_distinct(words(F.col(text), stop_words))).alias("term"))
    counts = terms.groupBy("term").agg(F.count(F.lit(1)).alias("documents"))
    return counts.crossJoin(F.broadcast(n)).where((F.col("documents") >= least) & (F.col("documents") <= share * F.col("n"))).drop("n")  # n is one row


def lda(docs: DataFrame, text: str, topics: int, terms: int = 10, seed: int = 42, min_df: float = 2, max_df: float = 0.95, iterations: int = 10, keep: tuple[str, ...] | None = None) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """The model, each document's columns (those in ``keep``, if given) with its first largest topic and that topic's weight,
    and each topic's leading terms."""
    model, assigned = train(docs, text, topics, seed, min_df, max_df, iterations, keep or tuple(docs.columns))
    return PipelineModel([model]), assigned, model.leading(terms)


def top_terms(weights: DataFrame, topic: str, term: str, weight: str, k: int) -> DataFrame:
    w = Window.partitionBy(topic).orderBy(F.desc(weight), term)
    return weights.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def stance_classifier(train: DataFrame, text: str, label: str, features: int = 1 << 16) -> PipelineModel:
    """A trained classifier behind the interface of a fine-tuned one: TF-IDF and logistic regression."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="__words", pattern="\\W+"), HashingTF(inputCol="__words", outputCol="__tf", numFeatures=features),
        IDF(inputCol="__tf", outputCol="__x"), LogisticRegression(featuresCol="__x", labelCol=label, maxIter=20, regParam=0.01),
    ]).fit(train)
