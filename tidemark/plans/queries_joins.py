"""Joins with their checks, summaries, and statistics whose formulas SQL can say."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity, probs, stance
from ..operators import aggregate, assemble, evaluate, events, ingest, markets, summaries
from ..session import table
from ..sources import snapshot
from ..stats import inference, ols
from ..storage import shared_folder
from .catalogue import register
from .fixtures import DOCS_SQL, MARKET_SQL, PREDICTIONS_SQL, SHARES, documents, logits, market, predictions, rounded

_SHARES_SQL = ", ".join(f"round({s}, 6) AS {s}" for s in SHARES)


@register("q_with_predictions", f"WITH {PREDICTIONS_SQL} SELECT vec_id AS doc_id, {_SHARES_SQL} FROM embeddings JOIN preds ON vec_id = doc_id")
def q_with_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector's row with its prediction; repeated and missing keys would be errors."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return rounded(assemble.with_predictions(rows, predictions(spark, sf), "doc_id", SHARES), *SHARES)


def _domain(spark: SparkSession, sf: str) -> DataFrame:
    return predictions(spark, sf).withColumn("domain_policy_status", F.when(F.col("doc_id") % 5 == 4, "error").otherwise("success"))


@register(
    "q_with_domain_policy",
    f"WITH {DOCS_SQL}, {PREDICTIONS_SQL} SELECT document_id, CASE WHEN share_hawkish IS NULL THEN NULL WHEN doc_id % 5 = 4 THEN 'error' ELSE 'success' END AS domain_policy_status, {_SHARES_SQL} FROM docs LEFT JOIN preds USING (doc_id)",
)
def q_with_domain_policy(spark: SparkSession, sf: str) -> DataFrame:
    docs, domain = documents(spark, sf).select("doc_id", "document_id"), _domain(spark, sf)
    known = domain.agg(F.max("doc_id")).first()[0]
    eligible = (F.col("doc_id") <= known) & (F.col("doc_id") % 5 != 4)
    out = assemble.with_domain_policy(docs, domain, "doc_id", "domain_policy_status", SHARES, eligible)
    return rounded(out, *SHARES).select("document_id", "domain_policy_status", *SHARES)


@register(
    "q_dashboard_documents",
    f"""WITH {DOCS_SQL}, {PREDICTIONS_SQL} SELECT document_id, publication_date, document_type, round(share_hawkish, 6) AS share_hawkish,
CASE WHEN share_hawkish IS NULL THEN NULL WHEN doc_id % 5 = 4 THEN 'error' ELSE 'success' END AS domain_policy_status FROM docs LEFT JOIN preds USING (doc_id)""",
)
def q_dashboard_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).drop("text").withColumn("publication_date", F.col("publication_date").cast("string"))
    days = market(spark, sf).select(F.col("d").cast("string").alias("event_date"), F.lit("x").alias("event_era"))
    out, _ = assemble.dashboard(docs, predictions(spark, sf).select("doc_id", SHARES[0]), _domain(spark, sf), days, "doc_id", (SHARES[0],), ("domain_policy_status",))
    return rounded(out.select("document_id", "publication_date", "document_type", SHARES[0], "domain_policy_status"), SHARES[0])


#: What the dashboard needs of each of its tables.
ARTEFACTS = {
    "documents": ("document_id", "publication_date", "document_type"), "nlp_predictions": ("doc_id", *SHARES), "domain_policy": ("doc_id", "domain_policy_status"), "events": ("event_date", "change_1d"),
    "coefficients": ("term", "coefficient", "std_error"), "correlations": ("outcome", "feature", "n"), "analysis": ("model", "nobs"),
}


@register(
    "q_dashboard_snapshot",
    f"""WITH {DOCS_SQL} SELECT artefact, CAST(n AS BIGINT) AS n FROM (SELECT 'documents' AS artefact, count(*) AS n FROM docs UNION ALL SELECT 'nlp_predictions', count(*) FROM embeddings UNION ALL SELECT 'domain_policy', count(*) FROM embeddings
  UNION ALL SELECT 'events', count(DISTINCT publication_date) FROM docs WHERE document_type = 'statement' UNION ALL SELECT 'coefficients', 2 UNION ALL SELECT 'correlations', 1 UNION ALL SELECT 'analysis', 1)""",
)
def q_dashboard_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """All seven tables of the dashboard, committed as one version and read back by its manifest."""
    lines = table(spark, sf, "lineitem")
    docs = documents(spark, sf).drop("text")
    days = docs.where("document_type = 'statement'").select(F.col("publication_date").alias("event_date")).distinct()
    f = ols.fit(lines, ols.design(lines, ("l_quantity", "l_discount")), "l_extendedprice")
    terms = [(t, float(b), float(se)) for t, b, se, *_ in f.table(f.plain()) if t != "Intercept"]
    n = lines.agg(F.count("l_quantity"), F.corr("l_extendedprice", "l_quantity")).first()
    made = {
        "documents": docs, "nlp_predictions": predictions(spark, sf), "domain_policy": _domain(spark, sf), "events": events.align(days, market(spark, sf), "d", "v"),
        "coefficients": spark.createDataFrame(terms, "term string, coefficient double, std_error double"),
        "correlations": spark.createDataFrame([("price", "quantity", n[0], n[1])], "outcome string, feature string, n long, pearson_r double"),
        "analysis": spark.createDataFrame([("plain", f.n, f.summary()["r_squared"])], "model string, nobs long, r_squared double"),
    }
    folder = f"{shared_folder(spark)}/dashboard-{uuid.uuid4().hex}"
    snapshot.commit(spark, folder, made)
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("artefact"), "n") for name, df in snapshot.load(spark, folder, ARTEFACTS).items()]
    return reduce(DataFrame.unionByName, parts)


_KNOWN_SQL = "SELECT doc_id, CASE quality WHEN 1 THEN 'good' ELSE 'bad' END AS good, CASE toxic WHEN 1 THEN 'toxic' ELSE 'clean' END AS tone FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL"
_JUDGED_SQL = f"k AS ({_KNOWN_SQL}), j AS (SELECT doc_id, 'good' AS task, good AS expected, CASE WHEN n_chars % 3 > 0 THEN 'good' ELSE 'bad' END AS predicted FROM k JOIN documents USING (doc_id) UNION ALL SELECT doc_id, 'tone', tone, CASE WHEN n_chars % 7 = 0 THEN 'toxic' ELSE 'clean' END FROM k JOIN documents USING (doc_id))"


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").where("quality is not null and toxic is not null")
    known = labels.select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("good"), F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("tone"))
    guesses = table(spark, sf, "documents").select(
        "doc_id", F.lit("success").alias("status"), F.when(F.col("n_chars") % 3 > 0, "good").otherwise("bad").alias("good_guess"), F.when(F.col("n_chars") % 7 == 0, "toxic").otherwise("clean").alias("tone_guess")
    )
    return assemble.judged(known, guesses, "doc_id", "status", (("good", "good_guess"), ("tone", "tone_guess")))


@register("q_judged_tasks", f"WITH {_JUDGED_SQL} SELECT * FROM j")
def q_judged_tasks(spark: SparkSession, sf: str) -> DataFrame:
    return _judged(spark, sf)


@register(
    "q_sentence_evaluation",
    f"""WITH {_JUDGED_SQL}, m AS (SELECT expected, predicted FROM j WHERE task = 'tone'), l(label) AS (VALUES ('toxic'), ('clean')),
c AS (SELECT label, (SELECT count(*) FROM m WHERE expected = label) AS support, (SELECT count(*) FROM m WHERE predicted = label) AS guessed, (SELECT count(*) FROM m WHERE expected = label AND predicted = label) AS hits FROM l)
SELECT label, support, round(coalesce(hits / nullif(guessed, 0), 0), 6) AS precision, round(coalesce(hits / nullif(support, 0), 0), 6) AS recall, round(coalesce(2 * hits / nullif(guessed + support, 0), 0), 6) AS f1 FROM c""",
)
def q_sentence_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    matrix = evaluate.confusion(_judged(spark, sf).where("task = 'tone'"), "expected", "predicted", ("toxic", "clean"))
    return rounded(evaluate.class_metrics(matrix).select("label", "support", "precision", "recall", "f1"), "precision", "recall", "f1")


@register(
    "q_market_metrics",
    """WITH s AS (SELECT CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderkey % 11 > 0 THEN o_totalprice END AS v FROM orders), u AS (SELECT *, coalesce(v > 2000, FALSE) AS ok FROM s)
SELECT count(*) AS input_rows, count(DISTINCT d) AS unique_trading_dates, count(*) FILTER (v IS NULL) AS missing_value_rows, count(*) FILTER (NOT ok) AS excluded_rows, min(v) FILTER (ok) AS minimum_usable_value, max(v) FILTER (ok) AS maximum_usable_value FROM u""",
)
def q_market_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d"), F.when(F.col("o_orderkey") % 11 > 0, F.col("o_totalprice")).alias("v"))
    return summaries.market_metrics(rows, "d", "v", F.col("v") > 2000)


_RECORDS_SQL = """r AS (SELECT CASE turn % 4 WHEN 3 THEN 'error' ELSE 'success' END AS status, CASE WHEN turn % 4 < 3 THEN CASE conv_id % 3 WHEN 0 THEN 'hawkish' WHEN 1 THEN 'dovish' ELSE 'insufficient_evidence' END END AS stance,
  turn % 4 < 3 AND conv_id % 3 = 2 AS abstained, conv_id % 2 = 0 AS supported, conv_id % 4 AS unsupported, CASE WHEN turn % 2 = 0 THEN length(text) END AS total_token_count FROM conversations)"""


def _records(spark: SparkSession, sf: str) -> DataFrame:
    c, t = F.col("conv_id"), F.col("turn")
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.when(t % 4 == 3, "error").otherwise("success").alias("status"),
        F.when(t % 4 < 3, F.when(c % 3 == 0, "hawkish").when(c % 3 == 1, "dovish").otherwise("insufficient_evidence")).alias("stance"),
        ((t % 4 < 3) & (c % 3 == 2)).alias("abstained"), (c % 2 == 0).alias("supported"), F.array_repeat(F.lit("q"), (c % 4).cast("int")).alias("unsupported"), F.when(t % 2 == 0, F.length("text")).alias("total_token_count"),
    )


@register(
    "q_extraction_summary",
    f"""WITH {_RECORDS_SQL} SELECT count(*) AS sample_size, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status <> 'success') AS error, round(avg((stance IS NOT NULL)::INT), 6) AS schema_validity_rate, round(avg(supported::INT), 6) AS evidence_support_rate,
CAST(sum(unsupported) AS BIGINT) AS unsupported_quote_count, round(avg((stance IS NOT NULL AND abstained)::INT), 6) AS abstention_rate, count(*) FILTER (stance = 'hawkish') AS stance_hawkish, count(*) FILTER (stance = 'dovish') AS stance_dovish,
count(*) FILTER (stance = 'neutral_or_mixed') AS stance_neutral_or_mixed, count(*) FILTER (stance = 'insufficient_evidence') AS stance_insufficient_evidence, CAST(coalesce(sum(total_token_count), 0) AS BIGINT) AS total_token_count FROM r""",
)
def q_extraction_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = summaries.extraction_summary(_records(spark, sf), stance.STANCES, ("total_token_count",))
    return rounded(out, "schema_validity_rate", "evidence_support_rate", "abstention_rate")


@register("q_compared_stance", f"WITH {_RECORDS_SQL.replace('SELECT CASE turn', 'SELECT conv_id, turn, CASE turn', 1)} SELECT conv_id, turn, CASE WHEN status = 'success' AND NOT abstained AND stance <> 'insufficient_evidence' THEN stance END AS label FROM r")
def q_compared_stance(spark: SparkSession, sf: str) -> DataFrame:
    return _records(spark, sf).select("conv_id", "turn", stance.compared(F.col("status"), F.col("stance"), F.col("abstained")).alias("label"))


@register("q_metadata_sets", "SELECT array_to_string(list_sort(list(DISTINCT lang)), ',') AS lang, array_to_string(list_sort(list(DISTINCT source)), ',') AS source FROM documents")
def q_metadata_sets(spark: SparkSession, sf: str) -> DataFrame:
    out = summaries.metadata_sets(table(spark, sf, "documents"), "lang", "source", "missing")
    return out.select(*(F.array_join(c, ",").alias(c) for c in out.columns))


@register("q_missing_counts", "SELECT count(*) FILTER (doc_id IS NULL) AS doc_id, count(*) FILTER (quality IS NULL) AS quality, count(*) FILTER (toxic IS NULL) AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def q_missing_counts(spark: SparkSession, sf: str) -> DataFrame:
    known = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    return summaries.missing_counts(summaries.numeric(known))


@register(
    "q_box_statistics",
    """WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, median(l_extendedprice) AS median, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1),
r AS (SELECT q.*, l_extendedprice AS v, l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS ok FROM lineitem JOIN q USING (l_returnflag))
SELECT l_returnflag, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, count(*) AS n, round(min(v) FILTER (ok), 4) AS whisker_low, round(max(v) FILTER (ok), 4) AS whisker_high, count(*) FILTER (NOT ok) AS outliers FROM r GROUP BY ALL""",
)
def q_box_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(summaries.box(table(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag"), "q1", "median", "q3", "whisker_low", "whisker_high", digits=4)


@register("q_same_day", f"WITH {DOCS_SQL}, {MARKET_SQL} SELECT d, v, document_id FROM market LEFT JOIN docs ON d = publication_date")
def q_same_day(spark: SparkSession, sf: str) -> DataFrame:
    return assemble.same_day(market(spark, sf), documents(spark, sf).select("document_id", "publication_date"), "d", "publication_date")


@register("q_first_of_date", "SELECT CAST(o_orderdate AS DATE) AS d, min(o_orderkey) AS o_orderkey, arg_min(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1")
def q_first_of_date(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d"), "o_orderkey", "o_totalprice")
    return assemble.first_of_each(rows, ("d",), ("o_orderkey",))


@register("q_identifiers", r"SELECT page_id, rtrim(replace(lower(trim(url)), '\', '/'), '/') AS identifier FROM pages")
def q_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", identity.identifier(F.col("url")).alias("identifier"))


@register("q_utc_midnight", "SELECT event_id, CAST(ts - INTERVAL 5 HOUR AS DATE) AS day FROM events")
def q_utc_midnight(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", markets.utc_midnight(F.col("ts"), "+05:00").alias("day"))


@register(
    "q_logit_mean",
    """WITH m AS (SELECT vec_id % 60 AS grp, avg(CAST(embedding[1] AS DOUBLE)) AS a, avg(CAST(embedding[2] AS DOUBLE)) AS b, avg(CAST(embedding[3] AS DOUBLE)) AS c FROM embeddings GROUP BY 1), e AS (SELECT grp, exp(a) AS a, exp(b) AS b, exp(c) AS c FROM m)
SELECT grp, round(a / (a + b + c), 6) AS p0, round(b / (a + b + c), 6) AS p1, round(c / (a + b + c), 6) AS p2, round(a / (a + b), 6) + 0.0 AS up FROM e""",
)
def q_logit_mean(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select((F.col("vec_id") % 60).alias("grp"), logits().alias("z"))
    out = aggregate.logit_mean(rows, "grp", "z", 3)
    named = F.map_from_arrays(F.array(*map(F.lit, "abc")), F.col("probabilities"))
    two = probs.regrouped(named, {"a": "up", "b": "down"}, ("up", "down"))
    return out.select("grp", *(F.round(F.col("probabilities")[i], 6).alias(f"p{i}") for i in range(3)), F.round(two["up"], 6).alias("up"))


_TESTS_SQL = "t AS (SELECT n_nationkey, n_regionkey, n_name, (n_nationkey * 37 % 25 + 1) / 800.0 AS p FROM nation), s AS (SELECT *, (count(*) OVER (PARTITION BY n_regionkey) - row_number() OVER (PARTITION BY n_regionkey ORDER BY p) + 1) * p AS scaled FROM t), h AS (SELECT *, least(1, max(scaled) OVER (PARTITION BY n_regionkey ORDER BY p ROWS UNBOUNDED PRECEDING)) AS p_holm FROM s)"


@register("q_holm_written_back", f"WITH {_TESTS_SQL} SELECT n_name, round(p, 6) AS p, round(p_holm, 6) AS p_holm, p_holm < 0.05 AS p_reject FROM h")
def q_holm_written_back(spark: SparkSession, sf: str) -> DataFrame:
    """A report of nations whose tests form a family for each region; the decisions go back into the report."""
    report = table(spark, sf, "nation").select("n_nationkey", "n_regionkey", "n_name", ((F.col("n_nationkey") * 37 % 25 + 1) / 800.0).alias("p"), F.lit(None).cast("double").alias("p_holm"))
    tests = inference.families(report.drop("p_holm", "n_name"), "p", "n_regionkey")
    out = assemble.written_back(report, tests, ("n_nationkey",), ("p_holm", "p_reject"))
    return rounded(out.select("n_name", "p", "p_holm", "p_reject"), "p", "p_holm")


@register("q_positional_lookup", "SELECT source_row, c_mktsegment, c_custkey FROM (SELECT row_number() OVER (ORDER BY c_name, c_custkey) - 1 AS source_row, c_mktsegment, c_custkey FROM customer)")
def q_positional_lookup(spark: SparkSession, sf: str) -> DataFrame:
    rows = ingest.numbered(table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_name", "c_custkey")
    sample = rows.select("source_row", "c_mktsegment")
    return assemble.at_positions(sample, rows.select("source_row", "c_mktsegment", "c_custkey"), "source_row", "c_mktsegment")


_XY = "l_extendedprice AS y, CAST(l_quantity AS DOUBLE) AS x"


@register(
    "q_robust_simple",
    f"""WITH r AS (SELECT {_XY} FROM lineitem), m AS (SELECT count(*) AS n, avg(x) AS mx, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_sxx(y, x) AS sxx FROM r),
e AS (SELECT y - a - b * x AS e, x - mx AS xc, 1.0 / n + (x - mx) * (x - mx) / sxx AS h, n, b, sxx FROM r, m), s AS (SELECT sum(e * e) / (max(n) - 2) AS s2 FROM e),
v AS (SELECT max(b) AS b, sum(xc * xc * e * e / ((1 - h) * (1 - h))) / (max(sxx) * max(sxx)) AS var, max(e * e * h / (2 * s2 * (1 - h) * (1 - h))) AS cook, count(*) FILTER (e * e * h / (2 * s2 * (1 - h) * (1 - h)) > 4.0 / n) AS influential FROM e, s)
SELECT round(b, 4) AS slope, round(sqrt(var), 4) AS hc3_error, round(b * b / var, 2) AS wald_f, round(cook, 8) AS max_cook, influential FROM v""",
)
def q_robust_simple(spark: SparkSession, sf: str) -> DataFrame:
    """Slope with its HC3 error, Wald's F, and Cook's distances, of prices on quantities."""
    df = table(spark, sf, "lineitem")
    f = ols.fit(df, ols.design(df, ("l_quantity",)), "l_extendedprice")
    v, cook = f.hc3(df), f.influence(df)
    row = (round(float(f.beta[1]), 4), round(float(v[1, 1]) ** 0.5, 4), round(f.wald(v, ("l_quantity",))[0], 2), round(cook["max_cook"], 8), cook["influential"])
    return spark.createDataFrame([row], "slope double, hc3_error double, wald_f double, max_cook double, influential long")


@register(
    "q_standardised",
    """WITH c AS (SELECT corr(l_extendedprice, l_quantity) AS r1, corr(l_extendedprice, l_discount) AS r2, corr(l_quantity, l_discount) AS r12 FROM lineitem)
SELECT 'l_quantity' AS term, round((r1 - r2 * r12) / (1 - r12 * r12), 6) + 0.0 AS beta, round(1 / (1 - r12 * r12), 6) AS vif FROM c UNION ALL SELECT 'l_discount', round((r2 - r1 * r12) / (1 - r12 * r12), 6) + 0.0, round(1 / (1 - r12 * r12), 6) FROM c""",
)
def q_standardised(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "lineitem")
    f = ols.fit(df, ols.design(df, ("l_quantity", "l_discount")), "l_extendedprice")
    vif = f.vif()
    rows = [(t, round(b, 6) + 0.0, round(vif[t], 6)) for t, b in f.standardised(df).items()]
    return spark.createDataFrame(rows, "term string, beta double, vif double")


@register(
    "q_anova",
    """WITH c AS (SELECT count(*) AS n, regr_syy(l_extendedprice, l_quantity) AS tss, corr(l_extendedprice, l_quantity) AS r1, corr(l_extendedprice, l_discount) AS r2, corr(l_quantity, l_discount) AS r12 FROM lineitem),
f AS (SELECT *, (r1 * r1 + r2 * r2 - 2 * r1 * r2 * r12) / (1 - r12 * r12) AS r FROM c)
SELECT 'l_quantity' AS term, 1 AS df, round((r - r2 * r2) / ((1 - r) / (n - 3)), 3) AS f FROM f UNION ALL SELECT 'l_discount', 1, round((r - r1 * r1) / ((1 - r) / (n - 3)), 3) FROM f""",
)
def q_anova(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "lineitem")
    f = ols.fit(df, ols.design(df, ("l_quantity", "l_discount")), "l_extendedprice")
    return spark.createDataFrame([(t, k, round(value, 3)) for t, _, k, value, _ in f.anova()], "term string, df int, f double")
