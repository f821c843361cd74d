"""Events, markets and dashboard queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.probs import first_largest, sole_largest
from ..operators import evaluate, events, markets, views
from ..session import table
from .catalogue import register
from .fixtures import DOCS_SQL, MARKET_SQL, PREDICTIONS_SQL, SHARES, STANCES, documents, external, market, predicted_documents, predictions, rounded

_ALIGN_SQL = """ev AS (SELECT DISTINCT publication_date AS event_date FROM docs WHERE document_type = 'statement'),
idx AS (SELECT d, v, row_number() OVER (ORDER BY d) AS rn, lag(v, 1) OVER (ORDER BY d) AS b1, lag(v, 5) OVER (ORDER BY d) AS b5 FROM market),
pos AS (SELECT event_date, (SELECT count(*) FROM idx WHERE d < event_date) AS p, (SELECT count(*) FROM idx WHERE d <= event_date) + 1 AS a FROM ev),
al AS (SELECT event_date, i.d AS prior_date, i.v AS prior_value, i.b1, i.b5,
    CASE WHEN i.rn IS NOT NULL THEN x.d END AS d1, CASE WHEN i.rn IS NOT NULL THEN x.v END AS v1, CASE WHEN i.rn IS NOT NULL THEN y.d END AS d5, CASE WHEN i.rn IS NOT NULL THEN y.v END AS v5,
    x.d AS any1, y.d AS any5
  FROM pos LEFT JOIN idx i ON i.rn = p LEFT JOIN idx x ON x.rn = a LEFT JOIN idx y ON y.rn = a + 4)"""


def _statement_events(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).where("document_type = 'statement'").select(F.col("publication_date").alias("event_date")).distinct()


def _aligned(spark: SparkSession, sf: str) -> DataFrame:
    return events.align(_statement_events(spark, sf), market(spark, sf), "d", "v")


@register(
    "q_event_align",
    f"""WITH {DOCS_SQL}, {MARKET_SQL}, {_ALIGN_SQL}
SELECT CAST(event_date AS VARCHAR) AS event_date, CAST(prior_date AS VARCHAR) AS prior_date, round(prior_value, 4) AS prior_value,
  CAST(d1 AS VARCHAR) AS post_date_1d, round(v1 - prior_value, 4) AS change_1d, round((v1 - prior_value) / nullif(prior_value, 0) * 100, 4) AS pct_change_1d,
  CAST(d5 AS VARCHAR) AS post_date_5d, round(v5 - prior_value, 4) AS change_5d, round(prior_value - b1, 4) AS pre_change_1d, round(prior_value - b5, 4) AS pre_change_5d,
  v1 IS NOT NULL AS is_usable_1d, v5 IS NOT NULL AS is_usable_5d,
  CASE WHEN prior_date IS NULL THEN 'no_prior_session' ELSE concat_ws(';', CASE WHEN d1 IS NULL THEN 'no_session_after_1d' END, CASE WHEN d5 IS NULL THEN 'no_session_after_5d' END) END AS exclusion_reason
FROM al""",
)
def q_event_align(spark: SparkSession, sf: str) -> DataFrame:
    out = _aligned(spark, sf)
    text = {c: F.col(c).cast("string") for c in ("event_date", "prior_date", "post_date_1d", "post_date_5d")}
    out = rounded(out.withColumns(text), "prior_value", "change_1d", "pct_change_1d", "change_5d", "pre_change_1d", "pre_change_5d", digits=4)
    return out.select(
        "event_date", "prior_date", "prior_value", "post_date_1d", "change_1d", "pct_change_1d", "post_date_5d", "change_5d", "pre_change_1d", "pre_change_5d",
        "is_usable_1d", "is_usable_5d", "exclusion_reason",
    )


_EXTERNAL_SQL = """market AS (SELECT CAST(l_shipdate AS DATE) AS d, max({m}) AS v FROM lineitem GROUP BY 1)"""


@register(
    "q_event_align_external",
    f"""WITH {DOCS_SQL}, {_EXTERNAL_SQL.format(m="l_extendedprice")}, {_ALIGN_SQL}
SELECT CAST(event_date AS VARCHAR) AS event_date, round(v1 / nullif(prior_value, 0) - 1, 6) AS price_1d, round(v5 / nullif(prior_value, 0) - 1, 6) AS price_5d,
  round(prior_value / nullif(b1, 0) - 1, 6) AS pre_price_1d, round(prior_value / nullif(b5, 0) - 1, 6) AS pre_price_5d, v1 IS NOT NULL AS is_usable_price_1d, v5 IS NOT NULL AS is_usable_price_5d
FROM al""",
)
def q_event_align_external(spark: SparkSession, sf: str) -> DataFrame:
    out = events.align_external(_statement_events(spark, sf), external(spark, sf), "d", "price", "price", events.simple_return)
    return rounded(out.withColumn("event_date", F.col("event_date").cast("string")), "price_1d", "price_5d", "pre_price_1d", "pre_price_5d")


@register(
    "q_event_align_basis_points",
    f"""WITH {DOCS_SQL}, {_EXTERNAL_SQL.format(m="l_tax")}, {_ALIGN_SQL}
SELECT CAST(event_date AS VARCHAR) AS event_date, round((v1 - prior_value) * 100, 6) + 0.0 AS tax_1d, round((prior_value - b1) * 100, 6) + 0.0 AS pre_tax_1d, v1 IS NOT NULL AS is_usable_tax_1d FROM al""",
)
def q_event_align_basis_points(spark: SparkSession, sf: str) -> DataFrame:
    out = events.align_external(_statement_events(spark, sf), external(spark, sf), "d", "tax", "tax", events.basis_points, (1,), (1,))
    return out.select(F.col("event_date").cast("string").alias("event_date"), (F.round("tax_1d", 6) + 0.0).alias("tax_1d"), (F.round("pre_tax_1d", 6) + 0.0).alias("pre_tax_1d"), "is_usable_tax_1d")


@register(
    "q_event_report",
    f"""WITH {DOCS_SQL}, {MARKET_SQL}, {_ALIGN_SQL}
SELECT count(*) AS events, CAST(min(event_date) AS VARCHAR) AS first_event, CAST(max(event_date) AS VARCHAR) AS last_event, count(v1) AS usable_1d, count(v5) AS usable_5d,
  count(*) - count(v1) AS excluded_1d, count(*) - count(v5) AS excluded_5d FROM al""",
)
def q_event_report(spark: SparkSession, sf: str) -> DataFrame:
    out = events.report(_aligned(spark, sf))
    return out.withColumns({c: F.col(c).cast("string") for c in ("first_event", "last_event")})


_AGG_SQL = f"""{DOCS_SQL}, {PREDICTIONS_SQL}, joined AS (SELECT docs.*, p.share_hawkish, p.share_dovish, p.share_neutral, p.doc_id IS NOT NULL AS good FROM docs LEFT JOIN preds p USING (doc_id)),
agg AS (SELECT publication_date AS event_date, count(*) AS document_count, count(*) FILTER (document_type = 'statement') AS statement_count, count(*) FILTER (good) AS success_count,
    count(*) FILTER (NOT good) AS error_count, '["' || string_agg(document_id, '","' ORDER BY document_id) || '"]' AS document_ids,
    avg(share_hawkish) AS share_hawkish, avg(share_dovish) AS share_dovish, avg(share_neutral) AS share_neutral
  FROM joined WHERE document_type = 'statement' GROUP BY 1)"""
_ERA_SQL = "CASE WHEN year({d}) <= 2004 THEN 'through_2004' WHEN year({d}) <= 2014 THEN '2005_2014' ELSE 'since_2015' END"


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return events.aggregate(predicted_documents(spark, sf), "publication_date", SHARES)


@register(
    "q_event_aggregate",
    f"""WITH {_AGG_SQL} SELECT CAST(event_date AS VARCHAR) AS event_date, CAST(year(event_date) AS INTEGER) AS event_year, CAST(month(event_date) AS INTEGER) AS event_month,
  {_ERA_SQL.format(d="event_date")} AS event_era, document_count, statement_count, CAST(0 AS BIGINT) AS transcript_count, success_count, error_count, document_ids,
  round(share_hawkish, 6) AS share_hawkish, round(share_dovish, 6) AS share_dovish, round(share_neutral, 6) AS share_neutral FROM agg""",
)
def q_event_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_events(spark, sf).withColumn("event_date", F.col("event_date").cast("string")), *SHARES)


@register(
    "q_docs_predictions_join",
    f"""WITH {DOCS_SQL}, {PREDICTIONS_SQL} SELECT document_id, CAST(publication_date AS VARCHAR) AS publication_date, document_type,
  CASE WHEN share_hawkish IS NULL THEN 'error' ELSE 'success' END AS status, round(share_hawkish, 6) AS share_hawkish, round(share_dovish, 6) AS share_dovish, round(share_neutral, 6) AS share_neutral
FROM docs LEFT JOIN preds USING (doc_id)""",
)
def q_docs_predictions_join(spark: SparkSession, sf: str) -> DataFrame:
    out = predicted_documents(spark, sf).withColumn("publication_date", F.col("publication_date").cast("string"))
    return rounded(out.select("document_id", "publication_date", "document_type", "status", *SHARES), *SHARES)


@register("q_missing_predictions", f"WITH {DOCS_SQL} SELECT document_id FROM docs WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def q_missing_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).join(predictions(spark, sf), "doc_id", "left_anti").select("document_id")


_MERGE_SQL = f"""{MARKET_SQL}, ext AS (SELECT CAST(l_shipdate AS DATE) AS d, max(l_extendedprice) AS price, max(l_tax) AS tax FROM lineitem GROUP BY 1),
merged AS (SELECT coalesce(market.d, ext.d) AS trading_date, v AS total, price, tax FROM market FULL JOIN ext ON market.d = ext.d)"""


def _merged(spark: SparkSession, sf: str) -> DataFrame:
    e = external(spark, sf)
    total = markets.normalise(market(spark, sf), "d", "v", "total")
    return markets.merge([total, markets.normalise(e, "d", "price", "price"), markets.normalise(e, "d", "tax", "tax", positive=False)])


@register("q_market_outer_merge", f"WITH {_MERGE_SQL} SELECT CAST(trading_date AS VARCHAR) AS trading_date, total, price, tax FROM merged WHERE trading_date BETWEEN DATE '1995-06-01' AND DATE '2001-06-30'")
def q_market_outer_merge(spark: SparkSession, sf: str) -> DataFrame:
    out = markets.window(_merged(spark, sf), "1995-06-01", "2001-06-30")
    return out.withColumn("trading_date", F.col("trading_date").cast("string"))


@register(
    "q_series_coverage",
    f"""WITH {_MERGE_SQL}, long AS (UNPIVOT merged ON total, price, tax INTO NAME series VALUE value)
SELECT series, count(*) AS observations, CAST(min(trading_date) AS VARCHAR) AS first_date, CAST(max(trading_date) AS VARCHAR) AS last_date FROM long GROUP BY series""",
)
def q_series_coverage(spark: SparkSession, sf: str) -> DataFrame:
    out = markets.coverage(_merged(spark, sf), ("total", "price", "tax"))
    return out.withColumns({c: F.col(c).cast("string") for c in ("first_date", "last_date")})


@register(
    "q_rolling_mean",
    f"""WITH {_AGG_SQL}, good AS (SELECT * FROM agg WHERE share_hawkish IS NOT NULL)
SELECT CAST(event_date AS VARCHAR) AS event_date, round(avg(share_hawkish) OVER (ORDER BY event_date ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), 6) AS share_hawkish_rolling,
  round(avg(share_dovish) OVER (ORDER BY event_date ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), 6) AS share_dovish_rolling FROM good""",
)
def q_rolling_mean(spark: SparkSession, sf: str) -> DataFrame:
    out = views.rolling(_events(spark, sf).where("share_hawkish is not null"), SHARES[:2])
    return rounded(out.select(F.col("event_date").cast("string").alias("event_date"), "share_hawkish_rolling", "share_dovish_rolling"), "share_hawkish_rolling", "share_dovish_rolling")


@register(
    "q_unpivot_shares",
    f"""WITH {_AGG_SQL}, long AS (SELECT event_date, 'hawkish' AS stance, share_hawkish AS share FROM agg UNION ALL SELECT event_date, 'dovish', share_dovish FROM agg UNION ALL SELECT event_date, 'neutral', share_neutral FROM agg)
SELECT CAST(event_date AS VARCHAR) AS event_date, stance, round(share, 6) AS share FROM long""",
)
def q_unpivot_shares(spark: SparkSession, sf: str) -> DataFrame:
    out = views.long_shares(_events(spark, sf), ("event_date",), SHARES, "share_")
    return rounded(out.withColumn("event_date", F.col("event_date").cast("string")), "share")


@register(
    "q_event_filter",
    f"""WITH {_AGG_SQL} SELECT CAST(event_date AS VARCHAR) AS event_date, document_count FROM agg
WHERE event_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND {_ERA_SQL.format(d="event_date")} IN ('through_2004')""",
)
def q_event_filter(spark: SparkSession, sf: str) -> DataFrame:
    out = views.between(_events(spark, sf), "1996-01-01", "1999-12-31", ("through_2004",))
    return out.select(F.col("event_date").cast("string").alias("event_date"), "document_count")


@register(
    "q_announcement_lookup",
    f"""WITH {_AGG_SQL} SELECT document_id, strftime(publication_date, '%Y-%m-%d') || ' · ' || document_id AS label FROM joined
WHERE good AND document_type = 'statement' AND publication_date IN (SELECT event_date FROM agg WHERE document_count > 1)""",
)
def q_announcement_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return views.announcements(predicted_documents(spark, sf), _events(spark, sf).where("document_count > 1")).select("document_id", "label")


@register(
    "q_overview",
    f"""WITH {_AGG_SQL} SELECT (SELECT count(*) FROM agg) AS events, (SELECT CAST(min(year(event_date)) AS INTEGER) FROM agg) AS first_year,
  (SELECT CAST(max(year(event_date)) AS INTEGER) FROM agg) AS last_year, (SELECT count(*) FROM docs WHERE document_type = 'statement') AS statements""",
)
def q_overview(spark: SparkSession, sf: str) -> DataFrame:
    return views.overview(_events(spark, sf), documents(spark, sf))


@register(
    "q_dominant_stance",
    """SELECT vec_id, CASE WHEN a = m THEN 'hawkish' WHEN b = m THEN 'dovish' ELSE 'neutral' END AS first_label,
  CASE WHEN (a = m)::INT + (b = m)::INT + (c = m)::INT > 1 THEN 'mixed_tie' WHEN a = m THEN 'hawkish' WHEN b = m THEN 'dovish' ELSE 'neutral' END AS sole_label
FROM (SELECT *, greatest(a, b, c) AS m FROM (SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 1) + 0.0 AS a, round(CAST(embedding[2] AS DOUBLE), 1) + 0.0 AS b, round(CAST(embedding[3] AS DOUBLE), 1) + 0.0 AS c FROM embeddings))""",
)
def q_dominant_stance(spark: SparkSession, sf: str) -> DataFrame:
    v = F.transform(F.slice("embedding", 1, 3), lambda x: F.round(x.cast("double"), 1) + 0.0)
    return table(spark, sf, "embeddings").select("vec_id", first_largest(v, STANCES).alias("first_label"), sole_largest(v, STANCES).alias("sole_label"))


@register(
    "q_outside_crisis",
    """SELECT o_orderkey FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderdate AS DATE) + 4018 END AS d FROM orders) WHERE NOT coalesce(year(d) BETWEEN 2007 AND 2009, FALSE)""",
)
def q_outside_crisis(spark: SparkSession, sf: str) -> DataFrame:
    moved = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 > 0, F.date_add(F.to_date("o_orderdate"), 4018)).alias("d"))
    return events.outside_crisis(moved, "d").select("o_orderkey")


@register(
    "q_even_sample",
    f"""WITH {DOCS_SQL}, r AS (SELECT document_id, row_number() OVER (ORDER BY publication_date, document_id) - 1 AS rank, count(*) OVER () AS n FROM docs WHERE document_type = 'statement')
SELECT document_id, rank FROM r WHERE rank IN (SELECT CAST(round_even(i * (n - 1) / 29.0, 0) AS BIGINT) FROM (SELECT unnest(range(30)) AS i), (SELECT max(n) AS n FROM r))""",
)
def q_even_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Thirty statements spread evenly over history; the sample size is the feature."""
    from ..operators.ingest import numbered

    own = documents(spark, sf).where("document_type = 'statement'").select("document_id", "publication_date")
    total = own.count()
    ranked = numbered(own, "publication_date", "document_id").withColumnRenamed("source_row", "rank")
    return evaluate.even_sample(ranked, total, 30).select("document_id", "rank")
