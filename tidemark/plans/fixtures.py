"""Stand-ins for announcements, predictions and market series, made from the star-schema tables.

Each has a Spark form and the DuckDB text of the same rows, so that queries and oracles share them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.probs import softmax
from ..session import table

STANCES = ("hawkish", "dovish", "neutral")
SHARES = tuple(f"share_{s}" for s in STANCES)

DOCS_SQL = """docs AS (
  SELECT doc_id, printf('doc%08d', doc_id) AS document_id, DATE '1995-01-01' + CAST(doc_id * 7 % 2300 AS INTEGER) AS publication_date,
    CASE WHEN doc_id % 3 < 2 THEN 'statement' ELSE 'transcript' END AS document_type, text
  FROM documents)"""

#: Three numbers of each vector as logits.
PREDICTIONS_SQL = """raw3 AS (
  SELECT vec_id AS doc_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c FROM embeddings),
exp3 AS (SELECT doc_id, exp(a - greatest(a, b, c)) AS a, exp(b - greatest(a, b, c)) AS b, exp(c - greatest(a, b, c)) AS c FROM raw3),
preds AS (SELECT doc_id, a / (a + b + c) AS share_hawkish, b / (a + b + c) AS share_dovish, c / (a + b + c) AS share_neutral FROM exp3)"""

MARKET_SQL = "market AS (SELECT CAST(o_orderdate AS DATE) AS d, max(o_totalprice) AS v FROM orders GROUP BY 1)"


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id", F.format_string("doc%08d", "doc_id").alias("document_id"), F.expr("date_add(date'1995-01-01', cast(doc_id * 7 % 2300 as int))").alias("publication_date"),
        F.when(F.col("doc_id") % 3 < 2, "statement").otherwise("transcript").alias("document_type"), "text",
    )


def logits() -> Column:
    return F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double"))


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), softmax(logits()).alias("p"))
    return p.select("doc_id", *(F.col("p")[i].alias(c) for i, c in enumerate(SHARES)))


def predicted_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with its prediction; those without one have an error status."""
    joined = documents(spark, sf).drop("text").join(predictions(spark, sf), "doc_id", "left")
    return joined.withColumn("status", F.when(F.col(SHARES[0]).isNotNull(), "success").otherwise("error"))


def market(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.max("o_totalprice").alias("v"))


def external(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem")
    return line.groupBy(F.to_date("l_shipdate").alias("d")).agg(F.max("l_extendedprice").alias("price"), F.max("l_discount").alias("rate"), F.max("l_tax").alias("tax"))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})
