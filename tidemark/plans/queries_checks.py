"""Checks, look-ups, codings and hashes that other queries pass by."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import probs
from ..operators import assemble, events, ingest, markets, quality, summaries, views
from ..session import table
from ..sources import files
from ..stats import ols
from .catalogue import register
from .fixtures import DOCS_SQL, MARKET_SQL, documents, market, rounded
from .queries_events import _ALIGN_SQL


@register(
    "q_complete_cases",
    f"""WITH {DOCS_SQL}, {MARKET_SQL}, {_ALIGN_SQL} SELECT CAST(event_date AS VARCHAR) AS event_date, round(v1 - prior_value, 4) AS change_1d, round(prior_value - b5, 4) AS pre_change_5d FROM al
WHERE prior_date IS NOT NULL AND v1 IS NOT NULL AND v5 IS NOT NULL AND b1 IS NOT NULL AND b5 IS NOT NULL""",
)
def q_complete_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Events that are usable over both horizons and lack no number."""
    days = documents(spark, sf).where("document_type = 'statement'").select(F.col("publication_date").alias("event_date")).distinct()
    aligned = events.align(days, market(spark, sf), "d", "v")
    kept = events.complete(aligned, "event_date", ("is_usable_1d", "is_usable_5d"), ("change_1d", "change_5d", "pre_change_1d", "pre_change_5d"))
    return rounded(kept.select(F.col("event_date").cast("string").alias("event_date"), "change_1d", "pre_change_5d"), "change_1d", "pre_change_5d", digits=4)


@register(
    "q_coefficient_arms",
    "SELECT p_partkey, CAST(2 * p_size AS DOUBLE) AS arm_up, CAST(p_size AS DOUBLE) AS arm_down, p_size < 5 AS significant FROM part WHERE p_partkey % 10 <> 0",
)
def q_coefficient_arms(spark: SparkSession, sf: str) -> DataFrame:
    """Parts stand for terms, every tenth for an intercept; sizes for the arms of an interval and for p-values in hundredths."""
    size, price = F.col("p_size").cast("double"), F.col("p_retailprice").cast("double")
    terms = table(spark, sf, "part").select(
        "p_partkey", F.when(F.col("p_partkey") % 10 == 0, "Intercept").otherwise(F.col("p_name")).alias("term"), price.alias("coefficient"),
        (price - size).alias("ci_lower"), (price + 2 * size).alias("ci_upper"), (size / 100).alias("p_value"),
    )
    return rounded(views.coefficient_arms(terms).select("p_partkey", "arm_up", "arm_down", "significant"), "arm_up", "arm_down", digits=4)


@register("q_group_sizes", 'SELECT count(*) AS "groups", CAST(coalesce(sum(n), 0) AS BIGINT) AS rows_in_groups FROM (SELECT count(*) AS n FROM documents GROUP BY lang, n_chars HAVING count(*) > 1)')
def q_group_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return quality.group_sizes(table(spark, sf, "documents"), "lang", "n_chars")


@register(
    "q_content_hash",
    """WITH d AS (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT d, sha256(CAST(d AS VARCHAR) || ',' || CAST(n AS VARCHAR)) AS h FROM d),
m AS (SELECT date_trunc('month', d) AS m, sha256(string_agg(h, ',' ORDER BY d, h)) AS h FROM r GROUP BY 1) SELECT sha256(string_agg(h, ',' ORDER BY m, h)) AS content_sha256 FROM m""",
)
def q_content_hash(spark: SparkSession, sf: str) -> DataFrame:
    daily = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("trading_date")).agg(F.count(F.lit(1)).alias("n"))
    return markets.content_hash(daily)


@register("q_truth_flags", "SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS flag FROM part")
def q_truth_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Text in any case and with blanks around is true or false; other text and none are neither."""
    said = F.element_at(F.array(F.lit(" TRUE"), F.lit("False "), F.lit("yes"), F.lit(""), F.lit(None)), (F.col("p_size") % 5 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", ingest.truth(said).alias("flag"))


@register(
    "q_label_aliases",
    "SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) + CAST(embedding[2] AS DOUBLE), 6) + 0.0 AS up, round(CAST(embedding[3] AS DOUBLE), 6) + 0.0 AS down, 2 AS labels FROM embeddings",
)
def q_label_aliases(spark: SparkSession, sf: str) -> DataFrame:
    """A model's own names for labels become the standard ones; values of names that are one label are added."""
    v = [F.element_at("embedding", i).cast("double") for i in (1, 2, 3)]
    own = F.map_from_arrays(F.array(F.lit("LABEL_2"), F.lit(" Hawkish"), F.lit("dovish")), F.array(*v))
    named = table(spark, sf, "embeddings").select("vec_id", probs.normalised_labels(own, {"label_2": "hawkish"}).alias("p"))
    up, down = (F.round(F.col("p")[k], 6) + 0.0 for k in ("hawkish", "dovish"))
    return named.select("vec_id", up.alias("up"), down.alias("down"), F.size("p").alias("labels"))


@register("q_lenient_json", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(json_extract(props, '$.k') AS DOUBLE) END AS k, event_id % 3 <> 0 OR json_extract(props, '$.k') IS NULL AS nothing FROM events")
def q_lenient_json(spark: SparkSession, sf: str) -> DataFrame:
    """What can't be read is shown as nothing."""
    told = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, "").otherwise(F.concat(F.lit("{"), F.col("props")))
    shown = table(spark, sf, "events").select("event_id", probs.decode_lenient(told).alias("m"))
    return shown.select("event_id", F.try_element_at("m", F.lit("k")).alias("k"), F.try_element_at("m", F.lit("k")).isNull().alias("nothing"))


@register("q_numeric_columns", "SELECT count(*) FILTER (c_custkey IS NULL) AS c_custkey, count(*) FILTER (c_nationkey IS NULL) AS c_nationkey, count(*) FILTER (c_acctbal < 0) AS c_acctbal FROM customer")
def q_numeric_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Missing values of all columns that hold numbers, where debts are taken for missing."""
    own = table(spark, sf, "customer").withColumns({"Unnamed: 0": F.lit(1), "c_acctbal": F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))})
    return summaries.missing_counts(summaries.numeric(own))


@register("q_looked_up", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def q_looked_up(spark: SparkSession, sf: str) -> DataFrame:
    """Every order with its customer's name; an order without one would be an error."""
    keys = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return assemble.looked_up(keys, table(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey").select("o_orderkey", "c_name")


@register("q_stripped_rows", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, trim(lang) AS lang, 'held' AS split FROM documents WHERE doc_id % 4 = 1")
def q_stripped_rows(spark: SparkSession, sf: str) -> DataFrame:
    """One split of all rows, as text without blanks around."""
    split = F.when(F.col("doc_id") % 4 == 1, " held").otherwise("used ")
    return files.stripped(table(spark, sf, "documents").select("doc_id", F.concat(F.lit("  "), "lang", F.lit(" ")).alias("lang"), split.alias("split")), "held")


@register(
    "q_labelled_splits",
    "SELECT doc_id, quality AS label_id, CASE quality WHEN 1 THEN 'good' ELSE 'bad' END AS policy_stance, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL AND trim(text) <> ''",
)
def q_labelled_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled texts as the two tables of a data set, with the names of their labels."""
    texts = table(spark, sf, "documents").select("doc_id", F.col("text").alias("sentence")).where(F.trim("sentence") != "")
    rows = table(spark, sf, "labels").where("quality is not null").select("doc_id", F.col("quality").alias("label")).join(texts, "doc_id")
    named = files.labelled_splits(rows.where("doc_id % 5 <> 0"), rows.where("doc_id % 5 = 0"), {0: "bad", 1: "good"})
    return named.select("doc_id", "label_id", "policy_stance", "split")


@register(
    "q_dummy_coding",
    "SELECT 'Intercept' AS term, CAST(count(*) AS DOUBLE) AS total FROM documents UNION ALL SELECT 'lang[T.' || lang || ']', CAST(count(*) AS DOUBLE) FROM documents WHERE lang > (SELECT min(lang) FROM documents) GROUP BY lang UNION ALL SELECT 'n_chars', CAST(sum(n_chars) AS DOUBLE) FROM documents",
)
def q_dummy_coding(spark: SparkSession, sf: str) -> DataFrame:
    """The columns of a design with languages as a factor, added up: the first language has none."""
    docs = table(spark, sf, "documents")
    names, cols = ols.design(docs, ("n_chars",), "lang")
    sums = docs.agg(*(F.sum(c).cast("double").alias(f"s{i}") for i, c in enumerate(cols)))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(n).alias("term"), F.col(f"s{i}").alias("total")) for i, n in enumerate(names)))).alias("x")).select("x.*")


@register("q_varying_terms", "SELECT term FROM (SELECT 'l_quantity' AS term, count(DISTINCT l_quantity) AS n FROM lineitem UNION ALL SELECT 'l_tax', count(DISTINCT l_tax) FROM lineitem UNION ALL SELECT 'one', 1) WHERE n > 1")
def q_varying_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Terms of a model that have more than one value."""
    lines = table(spark, sf, "lineitem").withColumn("one", F.col("l_linenumber") * 0)
    return spark.createDataFrame([(t,) for t in ols.varying(lines, ("l_quantity", "l_tax", "one"))], "term string")
