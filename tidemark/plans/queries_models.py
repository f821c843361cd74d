"""Probability algebra, classification metrics, topics and streaming queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import probs, text
from ..operators import aggregate, backends, density, evaluate, topics, training
from ..session import table
from ..sources import paged
from ..storage import shared_folder
from ..streaming import counts, extraction
from .catalogue import register
from .fixtures import PREDICTIONS_SQL, SHARES, STANCES, logits, predictions, rounded

_TOP_SQL = "CASE greatest(share_hawkish, share_dovish, share_neutral) WHEN share_hawkish THEN 'hawkish' WHEN share_dovish THEN 'dovish' ELSE 'neutral' END"


@register(
    "q_softmax_label",
    f"WITH {PREDICTIONS_SQL} SELECT doc_id, round(share_hawkish, 6) AS share_hawkish, round(share_dovish, 6) AS share_dovish, round(share_neutral, 6) AS share_neutral, {_TOP_SQL} AS label, round(share_hawkish - share_dovish, 6) + 0.0 AS score, TRUE AS sound FROM preds",
)
def q_softmax_label(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), probs.softmax(logits()).alias("p"))
    named = probs.from_logits(STANCES, F.col("p"))
    out = p.select("doc_id", *(F.col("p")[i].alias(c) for i, c in enumerate(SHARES)), probs.first_largest(F.col("p"), STANCES).alias("label"), probs.margin(named, "hawkish", "dovish").alias("score"), probs.is_distribution(F.col("p")).alias("sound"))
    return rounded(out, *SHARES, "score").withColumn("score", F.col("score") + 0.0)


@register(
    "q_weighted_probs",
    f"""WITH {PREDICTIONS_SQL}, w AS (SELECT doc_id % 50 AS grp, doc_id % 7 + 1 AS n, * FROM preds), s AS (SELECT grp, sum(share_hawkish * n) AS a, sum(share_dovish * n) AS b, sum(share_neutral * n) AS c, count(*) AS chunk_count, sum(n)::BIGINT AS token_count FROM w GROUP BY grp)
SELECT grp, chunk_count, token_count, round(a / (a + b + c), 6) AS p0, round(b / (a + b + c), 6) AS p1, round(c / (a + b + c), 6) AS p2 FROM s""",
)
def q_weighted_probs(spark: SparkSession, sf: str) -> DataFrame:
    rows = predictions(spark, sf).select((F.col("doc_id") % 50).alias("grp"), (F.col("doc_id") % 7 + 1).alias("n"), F.array(*SHARES).alias("p"))
    out = aggregate.weighted(rows, ("grp",), "p", 3, "n")
    return out.select("grp", "chunk_count", "token_count", *(F.round(F.col("probabilities")[i], 6).alias(f"p{i}") for i in range(3)))


@register(
    "q_paragraph_probs",
    f"""WITH {PREDICTIONS_SQL}, w AS (SELECT doc_id % 20 AS grp, doc_id % 3 AS par, doc_id % 7 + 1 AS n, * FROM preds),
i AS (SELECT grp, par, sum(share_hawkish * n) / sum(n) AS a, sum(share_dovish * n) / sum(n) AS b, sum(share_neutral * n) / sum(n) AS c FROM w GROUP BY ALL)
SELECT grp, round(avg(a), 6) AS p0, round(avg(b), 6) AS p1, round(avg(c), 6) AS p2 FROM i GROUP BY grp""",
)
def q_paragraph_probs(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    rows = predictions(spark, sf).select((d % 20).alias("grp"), (d % 3).alias("par"), (d % 7 + 1).alias("n"), F.array(*SHARES).alias("p"))
    out = aggregate.by_paragraph(rows, "grp", "par", "p", 3, "n")
    return out.select("grp", *(F.round(F.col("probabilities")[i], 6).alias(f"p{i}") for i in range(3)))


@register(
    "q_sentence_shares",
    f"""WITH {PREDICTIONS_SQL}, w AS (SELECT doc_id % 40 AS grp, {_TOP_SQL} AS label, * FROM preds), g AS (SELECT grp, count(*) AS sentence_count, avg((label = 'hawkish')::INT) AS h, avg((label = 'dovish')::INT) AS d, avg((label = 'neutral')::INT) AS n,
  avg(share_hawkish) AS share_hawkish, avg(share_dovish) AS share_dovish, avg(share_neutral) AS share_neutral, avg(greatest(share_hawkish, share_dovish, share_neutral)) AS mean_confidence FROM w GROUP BY grp)
SELECT grp, sentence_count, round(h, 6) AS share_hawkish, round(d, 6) AS share_dovish, round(n, 6) AS share_neutral, round(h - d, 6) + 0.0 AS net_stance, round(mean_confidence, 6) AS mean_confidence, {_TOP_SQL} AS stance FROM g""",
)
def q_sentence_shares(spark: SparkSession, sf: str) -> DataFrame:
    rows = predictions(spark, sf).select((F.col("doc_id") % 40).alias("grp"), F.array(*SHARES).alias("p")).withColumn("label", probs.first_largest(F.col("p"), STANCES))
    out = aggregate.sentence_features(rows, "grp", "label", "p", STANCES, "hawkish", "dovish")
    out = rounded(out, *SHARES, "net_stance", "mean_confidence").withColumn("net_stance", F.col("net_stance") + 0.0)
    return out.select("grp", "sentence_count", *SHARES, "net_stance", "mean_confidence", "stance")


@register("q_json_probs", """SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, CASE WHEN json_extract(props, '$.k') IS NULL THEN NULL ELSE '{"a":' || CAST(CAST(json_extract(props, '$.k') AS DOUBLE) AS VARCHAR) || ',"b":1.0}' END AS sorted_json FROM events""")
def q_json_probs(spark: SparkSession, sf: str) -> DataFrame:
    out = table(spark, sf, "events").select("event_id", *(c.alias(k) for k, c in probs.decode(F.col("props"), ("k",)).items()))
    made = F.create_map(F.lit("b"), F.lit(1.0), F.lit("a"), F.col("k"))
    return out.withColumn("sorted_json", F.when(F.col("k").isNotNull(), probs.encode(made)))


_GUESS_SQL = "SELECT l.doc_id, CASE l.quality WHEN 1 THEN 'good' ELSE 'bad' END AS truth, CASE WHEN d.n_chars % 3 > 0 THEN 'good' ELSE 'bad' END AS guess FROM labels l JOIN documents d USING (doc_id)"
_MATRIX_SQL = f"pairs AS ({_GUESS_SQL}), grid AS (SELECT * FROM (VALUES ('good'), ('bad'), ('unsure')) t(truth), (VALUES ('good'), ('bad'), ('unsure')) g(guess)), m AS (SELECT truth, guess, (SELECT count(*) FROM pairs p WHERE p.truth = grid.truth AND p.guess = grid.guess) AS n FROM grid)"
_CLASS_SQL = f"""{_MATRIX_SQL}, c AS (SELECT t.truth AS label, sum(n)::BIGINT AS support, (sum(n) FILTER (t.truth = t.guess))::BIGINT AS hits, (SELECT sum(n) FROM m g WHERE g.guess = t.truth)::BIGINT AS guessed FROM m t GROUP BY t.truth),
r AS (SELECT label, coalesce(hits / nullif(guessed, 0), 0) AS precision, coalesce(hits / nullif(support, 0), 0) AS recall, support, hits FROM c), f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM r)"""


def _matrix(spark: SparkSession, sf: str) -> DataFrame:
    pairs = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    pairs = pairs.select(F.when(F.col("quality") == 1, "good").otherwise("bad").alias("truth"), F.when(F.col("n_chars") % 3 > 0, "good").otherwise("bad").alias("guess"))
    return evaluate.confusion(pairs, "truth", "guess", ("good", "bad", "unsure"))


@register("q_confusion", f"WITH {_MATRIX_SQL} SELECT truth, guess, n FROM m")
def q_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return _matrix(spark, sf).select("truth", "guess", "n")


@register("q_class_metrics", f"WITH {_CLASS_SQL} SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM f")
def q_class_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluate.class_metrics(_matrix(spark, sf)), "precision", "recall", "f1").select("label", "precision", "recall", "f1", "support")


@register("q_macro", f"WITH {_CLASS_SQL} SELECT round(sum(hits) / sum(support), 6) AS accuracy, round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1, sum(support)::BIGINT AS n FROM f")
def q_macro(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluate.macro(evaluate.class_metrics(_matrix(spark, sf))), "accuracy", "macro_precision", "macro_recall", "macro_f1")


@register(
    "q_selective_metrics",
    """WITH r AS (SELECT quality = 1 AS truth, CASE WHEN doc_id % 4 > 0 THEN toxic = 0 END AS guess, doc_id % 5 > 0 AS valid, doc_id % 8 = 0 AS abstained FROM labels), c AS (SELECT *, valid AND guess IS NOT NULL AS covered, coalesce(guess = truth, FALSE) AS good FROM r)
SELECT count(*) AS n, round(avg(covered::INT), 6) AS coverage, round(avg((covered AND good)::INT), 6) AS all_row_accuracy, round(avg(CASE WHEN covered THEN good::INT END), 6) AS covered_accuracy, round(avg(valid::INT), 6) AS valid_share,
  round(avg(abstained::INT), 6) AS abstained_share, round(avg((abstained = (guess IS NULL))::INT), 6) AS consistent_share FROM c""",
)
def q_selective_metrics(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    rows = table(spark, sf, "labels").select((F.col("quality") == 1).alias("truth"), F.when(d % 4 > 0, F.col("toxic") == 0).alias("guess"), (d % 5 > 0).alias("valid"), (d % 8 == 0).alias("abstained"))
    rows = rows.withColumn("covered", F.col("valid") & F.col("guess").isNotNull())
    return rounded(evaluate.selective(rows, "truth", "guess", "valid", "abstained", "covered"), "coverage", "all_row_accuracy", "covered_accuracy", "valid_share", "abstained_share", "consistent_share")


@register("q_stratified_sample")
def q_stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Sixty labelled rows dealt over the labels; the size is the feature."""
    return evaluate.stratified_sample(table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label")), "label", "doc_id", 60, 2)


@register("q_split_counts", "SELECT quality AS label, CAST(round(count(*) * 0.2) AS BIGINT) AS validation, count(*) - CAST(round(count(*) * 0.2) AS BIGINT) AS train FROM labels GROUP BY quality")
def q_split_counts(spark: SparkSession, sf: str) -> DataFrame:
    cut = evaluate.split(table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label")), "label", "doc_id")
    return cut.groupBy("label").agg(F.count_if(F.col("split") == "validation").alias("validation"), F.count_if(F.col("split") == "train").alias("train"))


_WORDS_SQL = "list_filter(string_split(trim(lower(regexp_replace(text, '[^a-zA-Z0-9]+', ' ', 'g'))), ' '), lambda w: length(w) > 2 AND w NOT IN ('the', 'and', 'der'))"


@register("q_term_frequency", f"SELECT term, count(*) AS n FROM (SELECT unnest({_WORDS_SQL}) AS term FROM documents) GROUP BY term ORDER BY n DESC, term LIMIT 100")
def q_term_frequency(spark: SparkSession, sf: str) -> DataFrame:
    """The hundred most frequent words, as a word cloud shows them."""
    return topics.term_counts(table(spark, sf, "documents"), "text", ("the", "and", "der")).orderBy(F.desc("n"), "term").limit(100)


@register("q_pruned_vocabulary", f"SELECT term, count(*) AS documents FROM (SELECT doc_id, unnest(list_distinct({_WORDS_SQL})) AS term FROM documents) GROUP BY term HAVING count(*) >= 5 AND count(*) <= 0.5 * (SELECT count(*) FROM documents)")
def q_pruned_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return topics.pruned_vocabulary(table(spark, sf, "documents"), "doc_id", "text", 5, 0.5, ("the", "and", "der"))


@register(
    "q_top_terms",
    f"""WITH t AS (SELECT lang, unnest({_WORDS_SQL}) AS term FROM documents), c AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL)
SELECT lang, term, n, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS r FROM c) WHERE r <= 10""",
)
def q_top_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Ten leading terms of each language; the number is the feature."""
    words = table(spark, sf, "documents").select("lang", F.explode(text.words(F.col("text"), ("the", "and", "der"))).alias("term"))
    return topics.top_terms(words.groupBy("lang", "term").agg(F.count(F.lit(1)).alias("n")), "lang", "term", "n", 10)


@register(
    "q_jaccard_category",
    """WITH t AS (SELECT p_partkey, list_distinct(list_filter(string_split(trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '')) AS w FROM part),
s AS (SELECT p_partkey, len(list_intersect(w, ['standard', 'promo', 'steel'])) AS i1, len(list_intersect(w, ['small', 'brass'])) AS i2, len(w) AS n FROM t),
j AS (SELECT p_partkey, i1 / (n + 3 - i1) AS j1, i2 / (n + 2 - i2) AS j2, i1, i2 FROM s)
SELECT p_partkey, CASE WHEN greatest(j1, j2) < 0.3 THEN 'Other' WHEN j1 >= j2 THEN 'First' ELSE 'Second' END AS category FROM j""",
)
def q_jaccard_category(spark: SparkSession, sf: str) -> DataFrame:
    groups = {"First": ("standard", "promo", "steel"), "Second": ("small", "brass")}
    tokens = text.label_tokens(F.col("p_type"))
    return table(spark, sf, "part").select("p_partkey", text.best_category(tokens, groups, "Other").alias("category"))


@register("q_topics_lda")
def q_topics_lda(spark: SparkSession, sf: str) -> DataFrame:
    _, assigned, _ = topics.lda(table(spark, sf, "documents").where("text is not null"), "text", 4, keep=("doc_id",))
    return assigned.select("doc_id", "topic", F.round("topic_weight", 4).alias("topic_weight"))


@register("q_paged_events", "SELECT event_type, count(*) AS n, CAST(max(event_id) AS BIGINT) AS last FROM events GROUP BY event_type")
def q_paged_events(spark: SparkSession, sf: str) -> DataFrame:
    """All events, laid out as sixteen pages and read back through a paged format, each page by a task."""
    folder = f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}"
    own = table(spark, sf, "events").select("event_id", "event_type", F.pmod(F.xxhash64("event_id"), F.lit(16)).cast("int").alias("page"))
    own.repartition("page").write.partitionBy("page").json(f"{folder}/parts")
    fetch = paged.part_files(f"{folder}/parts", ("event_id", "event_type"))
    rows = paged.read(spark, paged.source("event_pages", "event_id long, event_type string", fetch, lambda: 16))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last"))


class _Failing:
    """A provider that is never there for one document in ten, and not at first for another."""

    def __call__(self, text: str | None, attempt: int) -> dict:
        text = text or "0"
        kind = int(text.split(" ", 1)[0]) % 10
        if kind == 7 or (kind == 3 and attempt == 1):
            raise TimeoutError("no answer")
        return {"length": len(text)}


@register(
    "q_stateful_cache",
    """SELECT doc_id, 'success' AS outcome, CAST(CASE WHEN doc_id % 10 = 3 THEN 2 ELSE 1 END AS INTEGER) AS attempts FROM documents WHERE doc_id % 10 <> 7
UNION ALL SELECT doc_id, 'error', 3 FROM documents WHERE doc_id % 10 = 7
UNION ALL SELECT doc_id, 'reused', CASE WHEN doc_id % 10 = 3 THEN 2 ELSE 1 END FROM documents WHERE doc_id % 3 = 0 AND doc_id % 10 <> 7""",
)
def q_stateful_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Requests for all documents, then for every third again, through a stream that is stopped in between; a third start
    sees the retries that are left."""
    base = f"{shared_folder(spark)}/requests-{uuid.uuid4().hex}"
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.concat_ws(" ", F.col("doc_id").cast("string"), F.substring("text", 1, 100)).alias("text"))
    again = docs.where(F.col("document_id").cast("long") % 3 == 0)
    for at, later, rows in (("2024-01-01 00:00:00", "2024-01-01 01:00:00", docs), ("2024-01-01 02:00:00", "2024-01-01 03:00:00", again), ("2024-01-01 04:00:00", "2024-01-01 05:00:00", again.limit(0))):
        extraction.asked(rows, at).unionByName(extraction.tick(spark, later)).write.mode("append").parquet(f"{base}/in")
        extraction.run(extraction.requests(spark, f"{base}/in"), f"{base}/out", f"{base}/checkpoint", _Failing())
    found = spark.read.schema(extraction.ANSWERS).parquet(f"{base}/out").where("document_id <> ''")
    return found.select(F.col("document_id").cast("long").alias("doc_id"), "outcome", "attempts")


QUALITY = training.Settings(("bad", "good"), rate=0.2)


@register("q_training_run")
def q_training_run(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of held-out documents after each of three epochs, and which model is the best."""
    named = F.when(F.col("quality") == 1, "good").otherwise("bad").alias("quality")
    docs = table(spark, sf, "documents").select("doc_id", "text").join(table(spark, sf, "labels").select("doc_id", named), "doc_id")
    run = training.train(training.prepared(docs, "doc_id", "text", "quality", QUALITY), f"{shared_folder(spark)}/training-{uuid.uuid4().hex}", QUALITY, 3)
    return rounded(run, "loss", "accuracy", "macro_f1", digits=4)


@register("q_topic_clusters")
def q_topic_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Dense regions of all embeddings; null for those in none."""
    return density.clusters(table(spark, sf, "embeddings"), "vec_id", "embedding", smallest=8, samples=4)


@register("q_topic_words")
def q_topic_words(spark: SparkSession, sf: str) -> DataFrame:
    """Ten words for each topic, of the documents whose embeddings are in it; the number is the feature."""
    topic = q_topic_clusters(spark, sf).select(F.col("vec_id").alias("doc_id"), "topic")
    return density.class_terms(table(spark, sf, "documents").join(topic, "doc_id"), "topic", "text", 10, ("the", "and", "der"))


@register(
    "q_class_terms",
    f"""WITH t AS (SELECT lang, unnest({_WORDS_SQL}) AS term FROM documents WHERE lang IS NOT NULL), c AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL), w AS (SELECT lang, sum(n) AS words FROM c GROUP BY lang), a AS (SELECT term, sum(n) AS total FROM c GROUP BY term),
x AS (SELECT lang, term, round(n / words * ln(1 + (SELECT avg(words) FROM w) / total), 9) AS weight FROM c JOIN w USING (lang) JOIN a USING (term))
SELECT lang, term, round(weight, 7) AS weight, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY weight DESC, term) AS r FROM x) WHERE r <= 10""",
)
def q_class_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Ten words that tell each language from the others; the number is the feature."""
    return rounded(density.class_terms(table(spark, sf, "documents"), "lang", "text", 10, ("the", "and", "der")), "weight", digits=7)


@register("q_model_windows")
def q_model_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations through a pluggable model, window by window."""
    ids = F.transform(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: F.pmod(F.crc32(w), F.lit(30000)).cast("int"))
    turns = table(spark, sf, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("key"), ids.alias("ids"))
    return backends.classify(turns, "key", "ids", lambda: backends.HashedLogits(STANCES), STANCES, 66, 8).select("key", "status", "label", "chunk_count", "token_count")


@register("q_daily_counts", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def q_daily_counts(spark: SparkSession, sf: str) -> DataFrame:
    return counts.daily(table(spark, sf, "events")).withColumn("day", F.col("day").cast("string"))
