"""From sentences, windows and paragraphs to documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.probs import first_largest, softmax


def weighted(rows: DataFrame, by: tuple[str, ...], probabilities: str, n: int, weight: str | None = None) -> DataFrame:
    """Mean probability vector, weighted or not, made to add up to 1; also chunk and token totals."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    sums = [F.sum(F.col(probabilities)[i] * w).alias(f"__s{i}") for i in range(n)]
    out = rows.groupBy(*by).agg(*sums, F.count(F.lit(1)).alias("chunk_count"), F.sum(F.col(weight) if weight else F.lit(1)).cast("long").alias("token_count"))
    whole = sum((F.col(f"__s{i}") for i in range(1, n)), F.col("__s0"))
    return out.withColumn("probabilities", F.array(*(F.try_divide(F.col(f"__s{i}"), whole) for i in range(n)))).drop(*(f"__s{i}" for i in range(n)))


def by_paragraph(rows: DataFrame, by: str, paragraph: str, probabilities: str, n: int, weight: str) -> DataFrame:
    """Weighted within a paragraph, then unweighted over paragraphs."""
    inner = weighted(rows, (by, paragraph), probabilities, n, weight)
    outer = weighted(inner.select(by, "probabilities"), (by,), "probabilities", n).select(by, "probabilities")
    totals = inner.groupBy(by).agg(F.sum("chunk_count").alias("chunk_count"), F.sum("token_count").alias("token_count"))
    return outer.join(totals, by)


def sentence_features(rows: DataFrame, by: str, label: str, probabilities: str, labels: tuple[str, ...], up: str, down: str) -> DataFrame:
    """Shares of hard labels, mean probabilities and their largest label, net stance, mean confidence."""
    out = rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("sentence_count"),
        *(F.avg((F.col(label) == k).cast("double")).alias(f"share_{k}") for k in labels),
        *(F.avg(F.col(probabilities)[i]).alias(f"mean_{k}") for i, k in enumerate(labels)),
        F.avg(F.array_max(probabilities)).alias("mean_confidence"),
    )
    means = F.array(*(F.col(f"mean_{k}") for k in labels))
    return out.withColumn("stance", first_largest(means, labels)).withColumn("net_stance", F.col(f"share_{up}") - F.col(f"share_{down}"))


def logit_mean(rows: DataFrame, by: str, logits: str, n: int) -> DataFrame:
    """Probabilities of the mean logits of a document's windows."""
    means = rows.groupBy(by).agg(*(F.avg(F.col(logits)[i]).alias(f"__m{i}") for i in range(n)))
    return means.select(by, softmax(F.array(*(F.col(f"__m{i}") for i in range(n)))).alias("probabilities"))
