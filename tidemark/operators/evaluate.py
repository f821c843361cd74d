"""Classification metrics, selective metrics and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import Ordered
from .ranks import dealt


def confusion(pairs: DataFrame, truth: str, guess: str, labels: tuple[str, ...]) -> DataFrame:
    """Counts of every pair of labels, zeros included, in the order of ``labels``."""
    spark = pairs.sparkSession
    grid = spark.createDataFrame([(i, t, j, g) for i, t in enumerate(labels) for j, g in enumerate(labels)], "truth_order int, truth string, guess_order int, guess string")
    counts = pairs.groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(grid).join(counts, ["truth", "guess"], "left").select("truth", "guess", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "truth_order", "guess_order")


def class_metrics(matrix: DataFrame) -> DataFrame:
    """Precision, recall, F1 (0 where undefined) and support of each label."""
    hit = F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0)
    by_truth = matrix.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support"), F.sum(hit).alias("hits"))
    by_guess = matrix.groupBy(F.col("guess").alias("label")).agg(F.sum("n").alias("guessed"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    out = by_truth.join(by_guess, "label").select("label", share("hits", "guessed").alias("precision"), share("hits", "support").alias("recall"), "support", "hits")
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return out.withColumn("f1", f1)


def macro(metrics: DataFrame) -> DataFrame:
    """Accuracy and unweighted means over all labels."""
    return metrics.agg(
        F.coalesce(F.try_divide(F.sum("hits").cast("double"), F.sum("support").cast("double")), F.lit(0.0)).alias("accuracy"),
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"), F.sum("support").alias("n"),
    )


def selective(rows: DataFrame, truth: str, guess: str, valid: str, abstained: str, covered: str) -> DataFrame:
    """Coverage, accuracy over all and over covered rows, validity, and whether abstaining agrees with no guess."""
    yes = lambda c: F.avg(c.cast("double"))
    right = F.coalesce(F.col(guess) == F.col(truth), F.lit(False))
    return rows.agg(
        F.count(F.lit(1)).alias("n"), yes(F.col(covered)).alias("coverage"), yes(F.col(covered) & right).alias("all_row_accuracy"),
        F.avg(F.when(F.col(covered), right.cast("double"))).alias("covered_accuracy"), yes(F.col(valid)).alias("valid_share"),
        yes(F.col(abstained)).alias("abstained_share"), yes(F.col(abstained) == F.col(guess).isNull()).alias("consistent_share"),
    )


def stratified_sample(rows: DataFrame, label: str, key: str, n: int, labels: int, seed: int = 42) -> DataFrame:
    """n rows dealt evenly over the labels, the first labels getting the remainder; the same each time."""
    rank = Ordered(rows.select(label).distinct(), label).numbered("label_rank", 1)
    quota = rank.select(label, (F.lit(n // labels) + F.when(F.col("label_rank") <= n % labels, 1).otherwise(0)).alias("quota"))
    return dealt(rows, label, key, seed).join(F.broadcast(quota), label).where(F.col("__rank") <= F.col("quota")).drop("__rank", "quota")


def even_sample(ranked: DataFrame, total: int, n: int, rank: str = "rank") -> DataFrame:
    """n rows spread evenly over ranks 0..total-1, the ends included; half ranks round to even."""
    at = sorted({round(i * (total - 1) / (n - 1)) if n > 1 else 0 for i in range(min(n, total))})
    return ranked.where(F.col(rank).isin(*at))


def split(rows: DataFrame, label: str, key: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Marks ``share`` of each label's rows as validation, the same ones each time."""
    sizes = rows.groupBy(label).agg(F.count(F.lit(1)).alias("__n")).withColumnRenamed(label, "__l")
    marked = dealt(rows, label, key, seed).join(F.broadcast(sizes), F.col(label).eqNullSafe(F.col("__l")))
    return marked.withColumn("split", F.when(F.col("__rank") <= F.round(F.col("__n") * share), "validation").otherwise("train")).drop("__rank", "__n", "__l")
