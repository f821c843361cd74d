"""Quality by regularised quadratic discriminant analysis.

Each whole text becomes a vector of transformed statistics (``features``); texts are read once and the
vectors kept. For each class the count, sum and sum of products of all labelled training vectors are
added up by Spark, in numbers of a size that does not grow with the data; no row is sampled. The
covariance of a class is shrunk towards the pooled one and that towards its diagonal, which keeps it
positive definite. Scores are the logistic function of the difference of log densities (Mahalanobis
distance by the Cholesky factors, computed once, and log determinants) and log priors, divided by
``temper`` since the statistics of a text are not independent.

Null and empty texts have the statistics of an empty text and get a score as others do. With no
training row of a class, every score is the share of label 1, or 0.5 with none at all. Repeated
labels count as often as they come, null labels not at all. Repeated documents are scored once each,
extra columns are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Columns, Stored, only, ship, tidy
from .features import NAMES, text_statistics

D = len(NAMES)
SHRINK = 0.1
DIAGONAL = 0.05
TEMPER = 2.0


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = [text_statistics(t) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])


def vectors(docs: DataFrame) -> DataFrame:
    ship(docs.sparkSession)
    return only(docs, "doc_id", "text").mapInArrow(tidy(_vectors), "doc_id long, x array<double>")


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, 1 + D + D * D))
    for b in batches:
        if not b.num_rows:
            continue
        x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, D)
        y = b.column(1).to_numpy(zero_copy_only=False)
        for k in (0, 1):
            own = x[y == k]
            total[k] += np.concatenate(([len(own)], own.sum(axis=0), (own.T @ own).ravel()))
    yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["label", "m"])


@dataclass(frozen=True)
class Model:
    """Means, inverse Cholesky factors, log determinants and priors; None where a class is missing."""

    share: float
    mean: np.ndarray | None = None
    whiten: np.ndarray | None = None
    log_det: np.ndarray | None = None
    temper: float = TEMPER

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.mean is None or not len(x):
            return np.full(len(x), self.share)
        density = []
        for k in (0, 1):
            # Not a matrix product, whose last digits depend on the number of rows.
            z = np.einsum("ij,kj->ik", x - self.mean[k], self.whiten[k])
            density.append(-0.5 * (np.einsum("ij,ij->i", z, z) + self.log_det[k]))
        odds = (density[1] - density[0]) / self.temper + np.log(self.share / (1 - self.share))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def fit(moments: np.ndarray, shrink: float = SHRINK, diagonal: float = DIAGONAL, temper: float = TEMPER) -> Model:
    """From count, sum and sum of products of each class."""
    n = moments[:, 0]
    if n.min() < 1:
        return Model(float(n[1] / n.sum()) if n.sum() else 0.5)
    mean = moments[:, 1 : 1 + D] / n[:, None]
    spread = moments[:, 1 + D :].reshape(2, D, D) / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
    pooled = (n[:, None, None] * spread).sum(axis=0) / n.sum()
    pooled = (1 - diagonal) * pooled + diagonal * np.diag(np.diag(pooled)) + 1e-4 * np.eye(D)
    whiten, log_det = [], []
    for k in (0, 1):
        # A class of few rows leans more on the pooled covariance.
        own = max(shrink, min(1.0, 2 * D / n[k]))
        root = np.linalg.cholesky((1 - own) * spread[k] + own * pooled)
        whiten.append(np.linalg.inv(root))
        log_det.append(2 * np.log(np.diag(root)).sum())
    return Model(float(n[1] / n.sum()), mean, np.array(whiten), np.array(log_det), temper)


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, D)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(x))], names=["doc_id", "score"])

    return run


def _gram(x: DataFrame, labels: DataFrame, label: str, train: Column) -> np.ndarray:
    known = only(labels, "doc_id", label).where(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("y"))
    pairs = x.where(train).join(known, "doc_id").select("x", "y")
    total = np.zeros((2, 1 + D + D * D))
    for r in pairs.mapInArrow(_moments, "label int, m array<double>").groupBy("label").agg(F.array(*(F.sum(F.col("m")[i]) for i in range(1 + D + D * D))).alias("m")).collect():
        total[r["label"]] = r["m"]
    return total


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", train: Column | None = None) -> DataFrame:
    """doc_id and score of every document, by a model of the labelled rows for which ``train`` holds."""
    store = Stored(docs.sparkSession, "quality")
    x = store.keep(vectors(docs), "vectors")
    model = fit(_gram(x, labels, label, F.lit(True) if train is None else train))
    return x.mapInArrow(_score(model), "doc_id long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float, label: str = "quality", train: Column | None = None) -> DataFrame:
    """The documents with at least this score, with all their columns and in no new order.

    Documents are written with their vectors once, so that neither texts are read for statistics twice
    nor decisions joined to texts by a shuffle.
    """
    ship(docs.sparkSession)

    @F.pandas_udf("array<double>")
    def statistics(text: pd.Series) -> pd.Series:
        return text.map(text_statistics)

    own, store = Columns(docs), Stored(docs.sparkSession, "quality")
    both = store.keep(own.df.withColumn("x", statistics(F.coalesce(own.of("text"), F.lit("")))), "documents")
    model = fit(_gram(both.select(F.col(own.of("doc_id")).alias("doc_id"), "x"), labels, label, F.lit(True) if train is None else train))

    @F.pandas_udf("double")
    def scored(x: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.array(x.tolist()).reshape(-1, D)), dtype=float)

    return own.back(both.where(scored("x") >= threshold))
