"""Explanatory statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import events
from ..session import table
from ..stats import inference, ols
from .catalogue import register
from .fixtures import MARKET_SQL, external, market, rounded

_LINES = "lineitem"


@register(
    "q_descriptives",
    "SELECT count(l_extendedprice) AS n, round(avg(l_extendedprice), 4) AS mean, round(median(l_extendedprice), 4) AS median, round(stddev_samp(l_extendedprice), 4) AS sd, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(quantile_cont(l_extendedprice, 0.75), 4) AS q3 FROM lineitem",
)
def q_descriptives(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(inference.describe(table(spark, sf, _LINES), "l_extendedprice"), "mean", "median", "sd", "q1", "q3", digits=4)


@register(
    "q_group_summary",
    "SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 4) AS mean, round(median(l_quantity), 4) AS median, round(stddev_samp(l_quantity), 4) AS sd, round(quantile_cont(l_quantity, 0.25), 4) AS q1, round(quantile_cont(l_quantity, 0.75), 4) AS q3 FROM lineitem GROUP BY l_returnflag",
)
def q_group_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(inference.describe(table(spark, sf, _LINES), "l_quantity", "l_returnflag"), "mean", "median", "sd", "q1", "q3", digits=4)


_RANK_SQL = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"


@register(
    "q_correlations",
    f"""WITH r AS (SELECT l_extendedprice AS y, l_quantity AS x, {_RANK_SQL.format(c="l_extendedprice")} AS ry, {_RANK_SQL.format(c="l_quantity")} AS rx FROM lineitem)
SELECT count(*) AS n, round(corr(y, x), 6) AS pearson_r, round(corr(ry, rx), 6) AS spearman_rho FROM r""",
)
def q_correlations(spark: SparkSession, sf: str) -> DataFrame:
    c = inference.correlations(table(spark, sf, _LINES), "l_extendedprice", "l_quantity")
    return rounded(spark.createDataFrame([(c["n"], c["pearson_r"], c["spearman_rho"])], "n long, pearson_r double, spearman_rho double"), "pearson_r", "spearman_rho")


@register("q_trend", "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem")
def q_trend(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(inference.trend(table(spark, sf, _LINES), "l_extendedprice", "l_quantity"), "slope", "intercept", digits=4)


_X = ("l_quantity", "l_discount", "l_tax")


@register(
    "q_ols_gram",
    """SELECT i, j, round(v, 4) AS v FROM (SELECT 0 AS i, 0 AS j, CAST(count(*) AS DOUBLE) AS v FROM lineitem UNION ALL SELECT 0, 1, sum(l_quantity) FROM lineitem UNION ALL SELECT 0, 2, sum(l_discount) FROM lineitem UNION ALL SELECT 0, 3, sum(l_tax) FROM lineitem
  UNION ALL SELECT 1, 1, sum(l_quantity * l_quantity) FROM lineitem UNION ALL SELECT 1, 2, sum(l_quantity * l_discount) FROM lineitem UNION ALL SELECT 1, 3, sum(l_quantity * l_tax) FROM lineitem
  UNION ALL SELECT 2, 2, sum(l_discount * l_discount) FROM lineitem UNION ALL SELECT 2, 3, sum(l_discount * l_tax) FROM lineitem UNION ALL SELECT 3, 3, sum(l_tax * l_tax) FROM lineitem)""",
)
def q_ols_gram(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, _LINES)
    xx = ols.gram(df, ols.design(df, _X)[1], "l_extendedprice")[0]
    return spark.createDataFrame([(i, j, round(float(xx[i, j]), 4)) for i in range(4) for j in range(i, 4)], "i int, j int, v double")


@register(
    "q_ols_simple",
    "SELECT term, round(b, 4) AS coefficient FROM (SELECT 'Intercept' AS term, regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem UNION ALL SELECT 'l_quantity', regr_slope(l_extendedprice, l_quantity) FROM lineitem)",
)
def q_ols_simple(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, _LINES)
    f = ols.fit(df, ols.design(df, _X[:1]), "l_extendedprice")
    return spark.createDataFrame([(n, round(float(b), 4)) for n, b in zip(f.names, f.beta, strict=True)], "term string, coefficient double")


@register(
    "q_ols_fit",
    """SELECT count(*) AS nobs, round(regr_r2(l_extendedprice, l_quantity), 6) AS r_squared, round(1 - (1 - regr_r2(l_extendedprice, l_quantity)) * (count(*) - 1) / (count(*) - 2), 6) AS adjusted_r_squared FROM lineitem""",
)
def q_ols_fit(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, _LINES)
    s = ols.fit(df, ols.design(df, _X[:1]), "l_extendedprice").summary()
    return spark.createDataFrame([(s["nobs"], round(s["r_squared"], 6), round(s["adjusted_r_squared"], 6))], "nobs long, r_squared double, adjusted_r_squared double")


def _sample(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions with what their series did before and after, as an event sample."""
    m, e = market(spark, sf), external(spark, sf)
    days = m.select(F.col("d").alias("event_date"))
    out = events.align(days, m, "d", "v").join(events.align_external(days, e, "d", "price", "price", events.simple_return), "event_date")
    out = out.withColumn("era", F.concat(F.lit("y"), F.floor(F.year("event_date") / 3).cast("string")))
    # A row a day, looked at by every model, so it is kept while they are fitted.
    return out.dropna(subset=["change_1d", "change_5d", "pre_change_1d", "pre_change_5d", "pre_price_1d"]).persist()


_BLOCKS = [("external", ("pre_price_1d",)), ("memory", ("pre_change_5d",))]


@register("q_nested_models")
def q_nested_models(spark: SparkSession, sf: str) -> DataFrame:
    """Nested models of one- and five-session changes, HC3 and HAC covariances, with block inference."""
    df = _sample(spark, sf)
    rows = []
    for y, h in (("change_1d", 1), ("change_5d", 5)):
        for m in ols.hierarchy(df, ("prior_value", "pre_change_1d"), _BLOCKS, "era", y, h, "event_date"):
            for term, *numbers in m["coefficients"]:
                rows.append((y, m["model"], term, *(float(x) for x in numbers), float(m["adjusted_r_squared"]), float(m.get("block_p", float("nan")))))
    df.unpersist()
    return spark.createDataFrame(rows, "outcome string, model string, term string, coefficient double, std_error double, statistic double, p_value double, ci_lower double, ci_upper double, adjusted_r_squared double, block_p double")


@register("q_crisis_sensitivity")
def q_crisis_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    """The same models without the middle years of the history, as a sensitivity check."""
    df = events.outside_crisis(_sample(spark, sf).withColumn("moved", F.add_months("event_date", 120)), "moved")
    df = df.persist()
    rows = [(m["model"], int(m["nobs"]), float(m["adjusted_r_squared"])) for m in ols.hierarchy(df, ("prior_value", "pre_change_1d"), _BLOCKS, None, "change_1d", 1, "event_date")]
    df.unpersist()
    return spark.createDataFrame(rows, "model string, nobs long, adjusted_r_squared double")


@register("q_model_diagnostics")
def q_model_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    df = _sample(spark, sf)
    f = ols.fit(df, ols.design(df, ("prior_value", "pre_change_1d", "pre_price_1d")), "change_1d")
    facts = {**f.diagnostics(df, "event_date"), **f.influence(df), **{f"vif_{k}": v for k, v in f.vif().items()}}
    df.unpersist()
    return spark.createDataFrame([(k, float(v)) for k, v in facts.items()], "measure string, value double")


_TWO_SQL = """z AS (SELECT t, y - avg(y) OVER () AS y, a - avg(a) OVER () AS a, b - avg(b) OVER () AS b FROM x),
s AS (SELECT count(*) AS n, sum(a * a) AS saa, sum(a * b) AS sab, sum(b * b) AS sbb, sum(a * y) AS say, sum(b * y) AS sby, sum(y * y) AS syy FROM z),
f AS (SELECT *, saa * sbb - sab * sab AS det, (sbb * say - sab * sby) / (saa * sbb - sab * sab) AS ga, (saa * sby - sab * say) / (saa * sbb - sab * sab) AS gb,
  sbb / (saa * sbb - sab * sab) AS iaa, -sab / (saa * sbb - sab * sab) AS iab, saa / (saa * sbb - sab * sab) AS ibb FROM s)"""


def _two_lines(spark: SparkSession, sf: str, name: str, third: Column) -> tuple[DataFrame, tuple[str, ...]]:
    return table(spark, sf, _LINES).withColumn(name, third), ("l_quantity", "l_discount", name)


_LINES_SQL = "x AS (SELECT 0 AS t, l_extendedprice AS y, l_quantity AS a, l_discount AS b FROM lineitem)"


@register(
    "q_collinear_fit",
    f"WITH {_LINES_SQL}, {_TWO_SQL} SELECT 'l_quantity' AS term, round(ga, 4) AS coefficient, TRUE AS kept FROM f UNION ALL SELECT 'l_discount', round(gb, 4), TRUE FROM f UNION ALL SELECT 'twice', NULL, FALSE",
)
def q_collinear_fit(spark: SparkSession, sf: str) -> DataFrame:
    """A term that two others explain has no coefficient, and theirs are as without it."""
    df, terms = _two_lines(spark, sf, "twice", 2 * F.col("l_quantity") + 3)
    f = ols.fit(df, ols.design(df, terms), "l_extendedprice")
    found = dict(zip(f.names, f.beta.tolist(), strict=True))
    return spark.createDataFrame([(t, round(found[t], 4) if t in found else None, t not in f.dropped) for t in terms], "term string, coefficient double, kept boolean")


@register("q_ill_conditioned_fit", f"WITH {_LINES_SQL}, {_TWO_SQL} SELECT round(ga, 2) AS of_quantity, round(gb, 1) AS of_discount FROM f")
def q_ill_conditioned_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Quantity, and quantity with a hundred-thousandth of the discount: cross products can't tell them apart."""
    df = table(spark, sf, _LINES).withColumn("near", F.col("l_quantity") + 1e-5 * F.col("l_discount"))
    f = ols.fit(df, ols.design(df, ("l_quantity", "near")), "l_extendedprice")
    _, one, two = f.beta.tolist()
    return spark.createDataFrame([(round(one + two, 2), round(two * 1e-5, 1))], "of_quantity double, of_discount double")


def _daily(spark: SparkSession, sf: str) -> DataFrame:
    """A row a day: the largest order, in thousands, with the largest line of the day and the number of orders."""
    day = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("t")).agg((F.max("o_totalprice") / 1000).alias("y"), F.count(F.lit(1)).cast("double").alias("b"))
    return day.join(table(spark, sf, _LINES).groupBy(F.to_date("l_shipdate").alias("t")).agg((F.max("l_extendedprice") / 1000).alias("a")), "t")


_DAILY_SQL = f"""x AS (SELECT t, y, a, b FROM (SELECT CAST(o_orderdate AS DATE) AS t, max(o_totalprice) / 1000 AS y, CAST(count(*) AS DOUBLE) AS b FROM orders GROUP BY 1) JOIN (SELECT CAST(l_shipdate AS DATE) AS t, max(l_extendedprice) / 1000 AS a FROM lineitem GROUP BY 1) USING (t)),
{_TWO_SQL}, r AS (SELECT t, a, b, y - ga * a - gb * b AS e, 1 / n + iaa * a * a + 2 * iab * a * b + ibb * b * b AS h FROM z, f),
ssr AS (SELECT sum(e * e) AS ssr FROM r)"""
#: Covariance of both slopes: the inverse cross products on both sides of a middle (maa, mab, mbb).
_SLOPES_SQL = """SELECT f.*, iaa * (iaa * maa + iab * mab) + iab * (iaa * mab + iab * mbb) AS vaa, iaa * (iab * maa + ibb * mab) + iab * (iab * mab + ibb * mbb) AS vab,
  iab * (iab * maa + ibb * mab) + ibb * (iab * mab + ibb * mbb) AS vbb FROM f, {middle}"""
_HC3_SQL = f"""hc AS (SELECT sum(a * a * e * e / ((1 - h) * (1 - h))) AS maa, sum(a * b * e * e / ((1 - h) * (1 - h))) AS mab, sum(b * b * e * e / ((1 - h) * (1 - h))) AS mbb FROM r), v3 AS ({_SLOPES_SQL.format(middle="hc")})"""
_LAGS = 5
_HAC_SQL = f"""u AS (SELECT t, a * e AS p, b * e AS q FROM r), lagged AS (SELECT u.*, {", ".join(f"lag(p, {k}) OVER (ORDER BY t) AS p{k}, lag(q, {k}) OVER (ORDER BY t) AS q{k}" for k in range(1, _LAGS + 1))} FROM u),
ha AS (SELECT sum(p * p) + {" + ".join(f"2 * (1 - {k} / 6.0) * sum(p * p{k})" for k in range(1, _LAGS + 1))} AS maa, sum(p * q) + {" + ".join(f"(1 - {k} / 6.0) * (sum(p * q{k}) + sum(q * p{k}))" for k in range(1, _LAGS + 1))} AS mab,
  sum(q * q) + {" + ".join(f"2 * (1 - {k} / 6.0) * sum(q * q{k})" for k in range(1, _LAGS + 1))} AS mbb FROM lagged), vh AS ({_SLOPES_SQL.format(middle="ha")})"""


def _terms(v: str, more: str = "") -> str:
    return " UNION ALL ".join(f"SELECT '{x}' AS term, round(g{x}, 6) AS coefficient, round(sqrt(v{x}{x}), 6) AS std_error, round(g{x} / sqrt(v{x}{x}), 4) AS statistic{more} FROM {v}" for x in "ab")


@register("q_hc3", f"WITH {_DAILY_SQL}, {_HC3_SQL} {_terms('v3', ', round(saa * sbb / det, 6) AS vif')}")
def q_hc3(spark: SparkSession, sf: str) -> DataFrame:
    """Both slopes of two regressors with errors that allow for unequal variances, and how far the other inflates them."""
    df = _daily(spark, sf)
    f = ols.fit(df, ols.design(df, ("a", "b")), "y")
    vif = f.vif()
    rows = [(t, round(b, 6), round(se, 6), round(s, 4), round(vif[t], 6)) for t, b, se, s, *_ in f.table(f.hc3(df)) if t != "Intercept"]
    return spark.createDataFrame(rows, "term string, coefficient double, std_error double, statistic double, vif double")


@register("q_hac", f"WITH {_DAILY_SQL}, {_HAC_SQL} {_terms('vh')}")
def q_hac(spark: SparkSession, sf: str) -> DataFrame:
    """The same with errors that allow for five days of memory."""
    df = _daily(spark, sf)
    f = ols.fit(df, ols.design(df, ("a", "b")), "y")
    rows = [(t, round(b, 6), round(se, 6), round(s, 4)) for t, b, se, s, *_ in f.table(f.hac(df, _LAGS, "t")) if t != "Intercept"]
    return spark.createDataFrame(rows, "term string, coefficient double, std_error double, statistic double")


def _wald_sql(v: str) -> str:
    return f"(SELECT (vbb * ga * ga - 2 * vab * ga * gb + vaa * gb * gb) / (vaa * vbb - vab * vab) / 2 FROM {v})"


@register(
    "q_joint_tests",
    f"""WITH {_DAILY_SQL}, {_HC3_SQL}, {_HAC_SQL}, k AS (SELECT e * e * h / (3 * (ssr / (n - 3)) * (1 - h) * (1 - h)) AS cook, n FROM r, f, ssr), d AS (SELECT e, e - lag(e) OVER (ORDER BY t) AS step FROM r),
mom AS (SELECT avg(e * e) AS m2, avg(e ** 3) AS m3, avg(e ** 4) AS m4 FROM r), j AS (SELECT m3 / m2 ** 1.5 AS skew, m4 / (m2 * m2) AS kurtosis FROM mom), like_ AS (SELECT -n / 2.0 * (ln(2 * pi()) + ln(ssr / n) + 1) AS ll, n, ssr FROM f, ssr)
SELECT measure, round(value, 4) AS value FROM (SELECT 'f_hc3' AS measure, {_wald_sql("v3")} AS value UNION ALL SELECT 'f_hac', {_wald_sql("vh")} UNION ALL SELECT 'max_cook', max(cook) FROM k UNION ALL SELECT 'influential', count(*) FILTER (cook > 4.0 / n) FROM k
  UNION ALL SELECT 'durbin_watson', sum(step * step) / sum(e * e) FROM d UNION ALL SELECT 'skew', skew FROM j UNION ALL SELECT 'kurtosis', kurtosis FROM j UNION ALL SELECT 'jarque_bera', n / 6.0 * (skew * skew + (kurtosis - 3) ** 2 / 4) FROM j, f
  UNION ALL SELECT 'rmse', sqrt(ssr / n) FROM like_ UNION ALL SELECT 'aic', 6 - 2 * ll FROM like_ UNION ALL SELECT 'bic', 3 * ln(n) - 2 * ll FROM like_ UNION ALL SELECT 'r_squared', 1 - ssr / syy FROM f, ssr)""",
)
def q_joint_tests(spark: SparkSession, sf: str) -> DataFrame:
    """Whether both slopes are zero, under either covariance, and what the residuals look like."""
    df = _daily(spark, sf)
    f = ols.fit(df, ols.design(df, ("a", "b")), "y")
    facts = {"f_hc3": f.wald(f.hc3(df), ("a", "b"))[0], "f_hac": f.wald(f.hac(df, _LAGS, "t"), ("a", "b"))[0], **f.influence(df), **f.diagnostics(df, "t"), **f.summary()}
    names = ("f_hc3", "f_hac", "max_cook", "influential", "durbin_watson", "skew", "kurtosis", "jarque_bera", "rmse", "aic", "bic", "r_squared")
    return spark.createDataFrame([(n, round(float(facts[n]), 4)) for n in names], "measure string, value double")


@register(
    "q_holm",
    """WITH p AS (SELECT l_linenumber, l_suppkey % 4 AS family, count(*) / 100000.0 AS p FROM lineitem GROUP BY ALL), s AS (SELECT *, (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p) + 1) * p AS scaled FROM p)
SELECT l_linenumber, family, round(p, 6) AS p, round(least(1, max(scaled) OVER (PARTITION BY family ORDER BY p ROWS UNBOUNDED PRECEDING)), 6) AS p_holm FROM s""",
)
def q_holm(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, _LINES).groupBy("l_linenumber", (F.col("l_suppkey") % 4).alias("family")).agg((F.count(F.lit(1)) / 100000.0).alias("p"))
    return rounded(inference.holm(p, "p", "family"), "p", "p_holm")


@register(
    "q_kruskal",
    f"""WITH r AS (SELECT l_returnflag AS g, {_RANK_SQL.format(c="l_quantity")} AS r, l_quantity AS v FROM lineitem), s AS (SELECT g, sum(r) AS s, count(*) AS n FROM r GROUP BY g), t AS (SELECT sum(CAST(t AS DOUBLE) * t * t - t) AS ties FROM (SELECT count(*) AS t FROM r GROUP BY v)), n AS (SELECT CAST(sum(n) AS DOUBLE) AS n FROM s)
SELECT count(*) AS groups, round((12 / (max(n.n) * (max(n.n) + 1)) * sum(s.s * s.s / s.n) - 3 * (max(n.n) + 1)) / (1 - max(t.ties) / (max(n.n) ** 3 - max(n.n))), 4) AS h FROM s, t, n""",
)
def q_kruskal(spark: SparkSession, sf: str) -> DataFrame:
    k = inference.kruskal(table(spark, sf, _LINES), "l_quantity", "l_returnflag")
    return spark.createDataFrame([(k["groups"], round(k["h"], 4))], "groups long, h double")


@register(
    "q_wilcoxon",
    f"""WITH {MARKET_SQL}, c AS (SELECT v - lag(v) OVER (ORDER BY d) AS x FROM market), n AS (SELECT x, abs(x) AS a FROM c WHERE x <> 0), r AS (SELECT x, {_RANK_SQL.format(c="a")} AS r FROM n)
SELECT count(*) AS n, least(sum(r) FILTER (x > 0), sum(r) FILTER (x < 0)) AS w FROM r""",
)
def q_wilcoxon(spark: SparkSession, sf: str) -> DataFrame:
    s = events.sessions(market(spark, sf), "d", "v", (1,)).select((F.col("session_value") - F.col("back_1")).alias("x"))
    w = inference.signed_rank(s, "x")
    return spark.createDataFrame([(w["n"], float(w["w"]))], "n long, w double")


@register("q_mean_test", "SELECT count(c_acctbal) AS n, round(avg(c_acctbal), 6) AS mean, round(avg(c_acctbal) / (stddev_samp(c_acctbal) / sqrt(count(c_acctbal))), 4) AS t FROM customer")
def q_mean_test(spark: SparkSession, sf: str) -> DataFrame:
    m = inference.mean_test(table(spark, sf, "customer"), "c_acctbal")
    return spark.createDataFrame([(m["n"], round(m["mean"], 6), round(m["t"], 4))], "n long, mean double, t double")
