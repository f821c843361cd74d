"""Identity, ingestion, quality, text and extraction queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity, stance, tables, text
from ..operators import cache, ingest, pacing, quality, summaries
from ..session import table
from .catalogue import register
from .fixtures import DOCS_SQL, documents, rounded


@register(
    "q_duplicate_flags",
    "SELECT doc_id, sha256(text) AS content_sha256, count(*) OVER (PARTITION BY sha256(text)) > 1 AS is_duplicate_content, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) > 1 AS is_later_copy FROM documents",
)
def q_duplicate_flags(spark: SparkSession, sf: str) -> DataFrame:
    hashed = table(spark, sf, "documents").select("doc_id", identity.content_hash(F.col("text")).alias("content_sha256"))
    return identity.flag_copies(hashed, ("content_sha256",), ("doc_id",), "is_duplicate_content", "is_later_copy")


@register("q_identity_conflicts", "SELECT lang || ':' || n_chars AS document_key, count(DISTINCT sha256(text)) AS contents, count(*) AS rows FROM documents GROUP BY 1 HAVING count(DISTINCT sha256(text)) > 1")
def q_identity_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    keyed = table(spark, sf, "documents").select(F.concat_ws(":", "lang", F.col("n_chars").cast("string")).alias("document_key"), identity.content_hash(F.col("text")).alias("h"))
    return quality.identity_conflicts(keyed, "document_key", "h")


_URL_SQL = r"""parts AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host,
    regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/{2,}', '/', 'g') AS path, string_split(regexp_extract(url, '\?([^#]*)', 1), '&') AS pairs FROM pages),
kept AS (SELECT page_id, scheme, host, CASE WHEN path IN ('', '/') THEN '/' ELSE regexp_replace(path, '/+$', '') END AS path,
    list_sort(list_filter(pairs, lambda p: p <> '' AND lower(split_part(p, '=', 1)) NOT IN ('fbclid', 'gclid', 'mc_cid', 'mc_eid', 'utm_campaign', 'utm_content', 'utm_medium', 'utm_source', 'utm_term'))) AS pairs FROM parts),
canon AS (SELECT page_id, CASE WHEN scheme IN ('http', 'https') AND host <> '' THEN scheme || '://' || host || path || CASE WHEN len(pairs) > 0 THEN '?' || array_to_string(pairs, '&') ELSE '' END ELSE '' END AS canonical_url FROM kept)"""


@register("q_canonical_url", f"WITH {_URL_SQL} SELECT page_id, canonical_url FROM canon")
def q_canonical_url(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", identity.canonical_url(F.col("url")).alias("canonical_url"))


@register(
    "q_url_ids",
    f"""WITH {_URL_SQL} SELECT p.page_id, 'fed_' || left(sha256(CASE WHEN canonical_url <> '' THEN canonical_url ELSE 'content:' || sha256(html) END), 24) AS document_id FROM canon JOIN pages p USING (page_id)""",
)
def q_url_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", identity.document_id(identity.canonical_url(F.col("url")), identity.content_hash(F.col("html"))).alias("document_id"))


_CLEAN_SQL = r"""cl AS (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  text, '([\pL\pN_])-[\s]*\n[\s]*([\pL\pN_])', '\1\2', 'g'), '[ \t]+\n', E'\n', 'g'), '\n{3,}', E'\n\n', 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '[ \t]{2,}', ' ', 'g'), '^\s+|\s+$', '', 'g') AS cleaned FROM documents)"""


@register("q_clean_text", f"WITH {_CLEAN_SQL} SELECT doc_id, sha256(cleaned) AS cleaned_sha256 FROM cl")
def q_clean_text(spark: SparkSession, sf: str) -> DataFrame:
    cleaned, _ = text.clean(F.col("text"), resolve=False)
    return table(spark, sf, "documents").select("doc_id", F.sha2(cleaned, 256).alias("cleaned_sha256"))


@register(
    "q_clean_diagnostics",
    f"""WITH {_CLEAN_SQL} SELECT doc_id, length(text) AS raw_text_length, length(cleaned) AS cleaned_text_length, greatest(length(text) - length(cleaned), 0) AS characters_removed,
  round(coalesce(greatest(length(text) - length(cleaned), 0) / nullif(length(text), 0), 0), 6) AS removal_ratio FROM cl""",
)
def q_clean_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    cleaned, _ = text.clean(F.col("text"), resolve=False)
    out = table(spark, sf, "documents").select("doc_id", "text", cleaned.alias("cleaned"))
    return rounded(out.select("doc_id", *(c.alias(n) for n, c in text.diagnostics(F.col("text"), F.col("cleaned")).items())), "removal_ratio")


@register("q_clean_pages")
def q_clean_pages(spark: SparkSession, sf: str) -> DataFrame:
    """With entities resolved and forms composed, which SQL has no function for."""
    cleaned, rules = text.clean(F.col("html"))
    return table(spark, sf, "pages").select("page_id", F.sha2(cleaned, 256).alias("cleaned_sha256"), F.array_join(rules, ",").alias("rules"))


@register(
    "q_validity_errors",
    """SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 7 = 0 THEN 'invalid_url' END, CASE WHEN lower(trim(source)) NOT IN ('src0', 'src1', 'src2') THEN 'invalid_document_type' END,
  CASE WHEN try_strptime(CASE WHEN doc_id % 5 = 0 THEN '1999-13-01' ELSE '1999-12-01' END, '%Y-%m-%d') IS NULL THEN 'invalid_date' END, CASE WHEN n_chars < 200 THEN 'empty_text' END) AS validation_errors FROM documents""",
)
def q_validity_errors(spark: SparkSession, sf: str) -> DataFrame:
    date = ingest.strict_date(F.when(F.col("doc_id") % 5 == 0, "1999-13-01").otherwise("1999-12-01"))
    url = F.when(F.col("doc_id") % 7 == 0, "").otherwise("http://a/")
    cleaned = F.when(F.col("n_chars") < 200, "").otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", ingest.document_errors(url, ingest.category(F.col("source")), date, cleaned, ("src0", "src1", "src2")).alias("validation_errors"))


@register(
    "q_usability",
    """SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 11 = 0 THEN 'invalid_date' END, CASE WHEN v IS NULL THEN 'missing_value' WHEN v < 0 THEN 'negative_value' END) AS exclusion_reason
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN -o_totalprice ELSE o_totalprice END AS v FROM orders)""",
)
def q_usability(spark: SparkSession, sf: str) -> DataFrame:
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    raw = F.when(key % 13 == 0, "n/a").when(key % 17 == 0, F.concat(F.lit("-"), price.cast("string"))).otherwise(price.cast("string"))
    date = ingest.mixed_date(F.when(key % 11 == 0, "no date").when(key % 2 == 0, "3/4/1999").otherwise("1999-03-04"))
    return table(spark, sf, "orders").select("o_orderkey", ingest.exclusion(date, ingest.number(raw)).alias("exclusion_reason"))


@register(
    "q_quality_metrics",
    """WITH h AS (SELECT sha256(text) AS h, count(*) AS n FROM documents GROUP BY 1) SELECT (SELECT count(*) FROM documents) AS input_rows, (SELECT count(*) FROM h) AS distinct_contents,
  (SELECT count(*) FROM h WHERE n > 1) AS duplicate_groups, (SELECT coalesce(CAST(sum(n) AS BIGINT), 0) FROM h WHERE n > 1) AS duplicate_rows, (SELECT max(n_chars) FROM documents) AS longest,
  (SELECT count(*) FROM documents WHERE contains(text, 'Ã')) AS possible_artefacts""",
)
def q_quality_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.quality_metrics(table(spark, sf, "documents"), identity.content_hash(F.col("text")), F.col("n_chars"), {"possible_artefacts": F.contains("text", F.lit("Ã"))})


@register(
    "q_quality_issues",
    """WITH b AS (SELECT 'short_text' AS code, doc_id FROM documents WHERE n_chars < 300 UNION ALL SELECT 'foreign_language', doc_id FROM documents WHERE lang <> 'en'),
r AS (SELECT code, doc_id, row_number() OVER (PARTITION BY code ORDER BY doc_id) AS r FROM b)
SELECT code, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FILTER (r <= 5) AS examples FROM r GROUP BY code""",
)
def q_quality_issues(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    short = quality.issue(docs, "short_text", "warning", F.col("n_chars") < 300, F.col("doc_id"), "doc_id")
    foreign = quality.issue(docs, "foreign_language", "info", F.col("lang") != "en", F.col("doc_id"), "doc_id")
    return short.unionByName(foreign).select("code", "n", F.array_join("examples", ",").alias("examples"))


@register("q_value_counts", "SELECT string_agg(lang || '=' || n, ',' ORDER BY lang) AS counts FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)")
def q_value_counts(spark: SparkSession, sf: str) -> DataFrame:
    counts = quality.as_map(quality.value_counts(table(spark, sf, "documents"), "lang"), "lang")
    return counts.select(F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("counts"))


_STOP_SQL = r"string_split(regexp_replace(trim(text, E' \n\t\r'), '([.!?])\s+', E'\\1\x01', 'g'), E'\x01')"


@register("q_sentences_stop", f"SELECT doc_id, CAST(len(s) AS INTEGER) AS sentences, sha256(array_to_string(s, '|')) AS sha FROM (SELECT doc_id, list_filter(list_transform({_STOP_SQL}, lambda x: trim(x, E' \\n\\t\\r')), lambda x: x <> '') AS s FROM documents)")
def q_sentences_stop(spark: SparkSession, sf: str) -> DataFrame:
    s = text.sentences_by_stop(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(s).alias("sentences"), F.sha2(F.array_join(s, "|"), 256).alias("sha"))


_LINE_SQL = r"""string_split(regexp_replace(regexp_replace(regexp_replace(text, '[\t\r ]+', ' ', 'g'), '([.!?])\s+([A-Z0-9"“''])', E'\\1\x01\\2', 'g'), '\n+', E'\x01', 'g'), E'\x01')"""


@register("q_sentences_line", f"SELECT doc_id, CAST(len(s) AS INTEGER) AS sentences, sha256(array_to_string(s, '|')) AS sha FROM (SELECT doc_id, list_filter(list_transform({_LINE_SQL}, lambda x: trim(x, E' \\n\\t\\r')), lambda x: x <> '') AS s FROM documents)")
def q_sentences_line(spark: SparkSession, sf: str) -> DataFrame:
    s = text.sentences_by_line(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(s).alias("sentences"), F.sha2(F.array_join(s, "|"), 256).alias("sha"))


@register("q_paragraphs", "SELECT doc_id, CAST(len(p) AS INTEGER) AS paragraphs, sha256(array_to_string(p, '|')) AS sha FROM (SELECT doc_id, list_filter(list_transform(string_split(replace(text, E'\\n', E'\\n\\n'), E'\\n\\n'), lambda x: trim(x, E' \\n\\t\\r')), lambda x: x <> '') AS p FROM documents)")
def q_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    """The texts have single line breaks, so each is doubled first."""
    p = text.paragraphs(F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")))
    return table(spark, sf, "documents").select("doc_id", F.size(p).alias("paragraphs"), F.sha2(F.array_join(p, "|"), 256).alias("sha"))


_WINDOWS_SQL = r"""WITH t AS (SELECT doc_id, string_split_regex(trim(text, E' \n\t\r'), '\s+') AS w FROM documents)
SELECT doc_id, CAST(i // 110 AS INTEGER) AS chunk, CAST(len(list_slice(w, i + 1, i + 126)) AS INTEGER) AS tokens, sha256(array_to_string(list_slice(w, i + 1, i + 126), ' ')) AS sha
FROM t, unnest(range(0, greatest(len(w) - 16 - 1, 0) + 1, 110)) AS r(i)"""


@register("q_token_windows", _WINDOWS_SQL)
def q_token_windows(spark: SparkSession, sf: str) -> DataFrame:
    w = F.split(F.regexp_replace("text", r"^[ \n\t\r]+|[ \n\t\r]+$", ""), r"\s+")
    chunks = table(spark, sf, "documents").select("doc_id", F.posexplode(text.token_windows(w, 128, 16)).alias("chunk", "x"))
    return chunks.select("doc_id", "chunk", F.size("x").alias("tokens"), F.sha2(F.array_join("x", " "), 256).alias("sha"))


@register("q_table_windows", _WINDOWS_SQL)
def q_table_windows(spark: SparkSession, sf: str) -> DataFrame:
    """The same windows by a table function from SQL."""
    tables.register(spark)
    w = F.split(F.regexp_replace("text", r"^[ \n\t\r]+|[ \n\t\r]+$", ""), r"\s+")
    docs = table(spark, sf, "documents").select("doc_id", w.alias("x"))
    cut = spark.sql("SELECT * FROM token_windows(TABLE(SELECT * FROM {docs}) PARTITION BY (doc_id), 'x', 128, 16)", docs=docs)
    return cut.select("doc_id", F.col("window").alias("chunk"), F.size("x").alias("tokens"), F.sha2(F.array_join("x", " "), 256).alias("sha"))


@register("q_paced_calls", """SELECT doc_id, CASE WHEN text IS NULL OR doc_id % 35 = 0 THEN 'error' ELSE 'success' END AS status, CAST(CASE WHEN text IS NULL OR doc_id % 35 = 0 THEN 3 WHEN doc_id % 5 = 0 THEN 2 ELSE 1 END AS INTEGER) AS attempts FROM documents""")
def q_paced_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Every document through an offline provider that fails now and then, 6,000 calls a simulated minute."""
    told = F.concat_ws(" ", F.col("doc_id").cast("string"), F.length("text").cast("string"))
    work = table(spark, sf, "documents").select("doc_id", F.when(F.col("text").isNotNull(), told).alias("told"))
    done = pacing.called(work, "doc_id", "told", _Flaky(), pacing.Plan(6000.0, lanes=32), pacing.simulated_time)
    return done.select("doc_id", F.when(F.col("payload").isNull(), "error").otherwise("success").alias("status"), "attempts")


class _Flaky:
    """Fails for every fifth document's first call, and for every thirty-fifth's always."""

    def __init__(self) -> None:
        self.asked: str | None = None

    def __call__(self, text: str | None) -> dict:
        number = int(text.split()[0])
        first, self.asked = self.asked != text, text
        if number % 35 == 0 or (number % 5 == 0 and first):
            raise ConnectionError("busy")
        return {"length": int(text.split()[1])}


_UP, _DOWN = (r"\bof the\b", r"\bthe (?:and|on)\b"), (r"\bin (?:the|of)\b", r"\bwith\b")


#: Words of the invented prose that turn a phrase around, as the operator's own don't occur in it.
_TURN = ("and", "wh", "is")


def _stance_sql() -> str:
    """Each sentence and pattern: the first match at word limits, unless one of the last four words before it turns it."""
    word, side = r"[\pL\pN_]", r"[^\pL\pN_]"
    sides = []
    for patterns in (_UP, _DOWN):
        found = []
        for p in patterns:
            bare = p.replace(r"\b", "")
            hit = f"regexp_matches(x, '(?i)(?:^|{side})(?:{bare})(?:$|{side})')"
            before = f"regexp_extract(x, '(?is)^(.*?(?:^|{side}))(?:{bare})(?:$|{side})', 1)"
            turned = f"list_has_any(list_slice(list_reverse(regexp_extract_all(lower({before}), '(?:{word}|'')+')), 1, 4), {list(_TURN)})"
            found.append(f"CASE WHEN {hit} AND NOT {turned} THEN 1 ELSE 0 END")
        sides.append(f"list_transform(s, lambda x: {' + '.join(found)})")
    return (
        f"WITH t AS (SELECT doc_id, list_filter(list_transform({_STOP_SQL}, lambda x: trim(x, E' \\n\\t\\r')), lambda x: x <> '') AS s FROM documents), m AS (SELECT doc_id, {sides[0]} AS u, {sides[1]} AS d FROM t), "
        "c AS (SELECT doc_id, coalesce(list_sum(u), 0)::INTEGER AS up, coalesce(list_sum(d), 0)::INTEGER AS down, len(list_filter(list_zip(u, d), lambda p: p[1] + p[2] > 0))::INTEGER AS evidence FROM m) "
        "SELECT doc_id, CASE WHEN up > 0 AND down > 0 THEN 'neutral_or_mixed' WHEN up > 0 THEN 'hawkish' WHEN down > 0 THEN 'dovish' ELSE 'insufficient_evidence' END AS stance, up, down, evidence FROM c"
    )


@register("q_stance_rules", _stance_sql())
def q_stance_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Phrases and negations of the invented prose stand for a lexicon."""
    s = stance.stance(F.col("text"), _UP, _DOWN, negations=_TURN)
    out = table(spark, sf, "documents").select("doc_id", s.alias("s"))
    return out.select("doc_id", "s.stance", F.size("s.hawkish_matches").alias("up"), F.size("s.dovish_matches").alias("down"), F.size("s.evidence").alias("evidence"))


@register(
    "q_stance_flags",
    r"""SELECT doc_id, CASE WHEN up AND down THEN 'neutral_or_mixed' WHEN up THEN 'hawkish' WHEN down THEN 'dovish' ELSE 'insufficient_evidence' END AS stance
FROM (SELECT doc_id, len(list_filter(s, lambda x: regexp_matches(x, '(?i)\bworthless'))) > 0 AS up, len(list_filter(s, lambda x: regexp_matches(x, '(?i)\bstupid'))) > 0 AS down FROM (SELECT doc_id, """
    + _STOP_SQL
    + " AS s FROM documents))",
)
def q_stance_flags(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", stance.stance(F.col("text"), (r"\bworthless",), (r"\bstupid",))["stance"].alias("stance"))


_TERMS = {"inflation_outlook": ("the of",), "labor_market_outlook": ("in the",), "economic_growth_outlook": ("and of",), "key_risk": ("with",), "policy_rationale": ("from",), "hawkish": ("idiot",), "dovish": ("clown",)}


def _extracted(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", "text", stance.extract(F.col("text"), _TERMS).alias("x"))


_PICK_SQL = ", ".join(f"list_filter(s, lambda x: {' OR '.join(f"contains(lower(x), '{t}')" for t in terms)}) AS {field}" for field, terms in _TERMS.items())


@register(
    "q_mock_extract",
    r"WITH q AS (SELECT conv_id, turn, list_filter(list_transform(" + _LINE_SQL + rf""", lambda x: trim(x, E' \n\t\r')), lambda x: x <> '') AS s FROM conversations), f AS (SELECT conv_id, turn, {_PICK_SQL} FROM q),
e AS (SELECT *, len(list_distinct([hawkish[1], dovish[1]])) + (len(inflation_outlook) > 0)::INT + (len(labor_market_outlook) > 0)::INT + (len(economic_growth_outlook) > 0)::INT + len(list_distinct(key_risk[1:3])) + len(list_distinct(policy_rationale[1:3])) AS evidence FROM f)
SELECT conv_id, turn, CASE WHEN len(hawkish) > 0 AND len(dovish) > 0 THEN 'neutral_or_mixed' WHEN len(hawkish) > 0 THEN 'hawkish' WHEN len(dovish) > 0 THEN 'dovish' ELSE 'insufficient_evidence' END AS policy_stance,
  inflation_outlook[1] AS inflation_outlook, CAST(len(key_risk[1:3]) AS INTEGER) AS risks, CAST(evidence AS INTEGER) AS evidence, evidence = 0 AS abstained FROM e""",
)
def q_mock_extract(spark: SparkSession, sf: str) -> DataFrame:
    return _extracted(spark, sf).select("conv_id", "turn", "x.policy_stance", "x.inflation_outlook", F.size("x.key_risks").alias("risks"), F.size("x.supporting_evidence").alias("evidence"), "x.abstained")


@register(
    "q_mock_outlook",
    r"SELECT conv_id, turn, list_filter(s, lambda x: contains(lower(x), 'the of'))[1] AS inflation_outlook FROM (SELECT conv_id, turn, list_filter(list_transform(" + _LINE_SQL + r", lambda x: trim(x, E' \n\t\r')), lambda x: x <> '') AS s FROM conversations)",
)
def q_mock_outlook(spark: SparkSession, sf: str) -> DataFrame:
    return _extracted(spark, sf).select("conv_id", "turn", "x.inflation_outlook")


@register("q_grounding", "SELECT doc_id, n_chars % 2 = 0 AND length(trim(text)) > 0 AND NOT contains(text, 'is not said') AS ungrounded FROM documents")
def q_grounding(spark: SparkSession, sf: str) -> DataFrame:
    """Every second document is quoted with a piece of itself, the others with words that it lacks."""
    quote = F.when((F.col("n_chars") % 2 == 0) & (F.length(F.trim("text")) > 0), F.lit("is not said")).otherwise(F.substring("text", 3, 40))
    quoted = table(spark, sf, "documents").select("doc_id", "text", F.array(F.struct(F.lit("key_risk").alias("field"), quote.alias("quote"))).alias("evidence"))
    return quoted.select("doc_id", (F.size(stance.ungrounded(F.col("evidence"), F.col("text"))) > 0).alias("ungrounded"))


def _item(**other: str) -> str:
    """An evidence item in JSON with some of its values replaced, or left out if empty."""
    own = {"field": '"key_risk"', "quote": '"as it says"', "claim_type": '"explicit"', "explanation": '"It does."'} | other
    return "{" + ",".join(f'"{k}":{v}' for k, v in own.items() if v) + "}"


#: What is wrong with a payload, and the JSON of the values that make it so; an empty one is left out. Each is put into a
#: sound extraction of the row.
_WRONG: tuple[tuple[str, dict[str, str]], ...] = (
    ("", {}), ("missing_keys", {"uncertainties": ""}), ("unexpected_keys", {"extra": "1"}), ("schema_version", {"schema_version": '"0.9"'}), ("schema_version", {"schema_version": "1.0"}),
    ("policy_stance", {"policy_stance": '"moderate"'}), ("policy_stance", {"policy_stance": "null"}), ("abstained", {"abstained": '"false"'}), ("abstained", {"abstained": "0"}),
    *((f"not_text_{f}", {f: "[1]"}) for f in stance.OPTIONAL_TEXT), *((f"blank_{f}", {f: '" \\t"'}) for f in stance.OPTIONAL_TEXT),
    ("list_key_risks", {"key_risks": '"one"'}), ("list_key_risks", {"key_risks": '["one",2]'}), ("list_policy_rationale", {"policy_rationale": '["", "two"]'}), ("list_uncertainties", {"uncertainties": "[null]"}),
    ("evidence_list", {"supporting_evidence": _item()}), ("evidence_item", {"supporting_evidence": '["as it says"]'}), ("evidence_item", {"supporting_evidence": f"[{_item()},{_item(quote='')}]"}),
    ("evidence_item", {"supporting_evidence": f"[{_item(page='3')}]"}), ("evidence_text", {"supporting_evidence": f"[{_item(quote='5')}]"}), ("evidence_text", {"supporting_evidence": f"[{_item(explanation='null')}]"}),
    ("evidence_field", {"supporting_evidence": f"[{_item(field='"mood"')}]"}), ("evidence_claim_type", {"supporting_evidence": f"[{_item(claim_type='"guess"')}]"}),
    ("abstained_with_stance", {"abstained": "true", "supporting_evidence": "[]"}), ("claim_without_evidence", {"supporting_evidence": "[]"}), ("not_an_object", {}),
    ("missing_keys,unexpected_keys,policy_stance", {"key_risks": "", "risks": "[]", "policy_stance": '"up"'}),
)
_CASE = f"(conv_id * 7 + turn) % {len(_WRONG)}"


@register("q_schema_audit", f"SELECT conv_id, turn, [{', '.join(repr(codes) for codes, _ in _WRONG)}][{_CASE} + 1] AS errors FROM conversations")
def q_schema_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Extractions of all turns, all but a few of them spoilt: every code occurs, alone and with others."""
    sound = {k: F.coalesce(F.to_json(F.struct(F.col(f"x.{k}").alias("v")), {"ignoreNullFields": "false"}), F.lit("")) for k in stance.EXTRACTION_KEYS}
    sound = {k: F.substring(v, F.lit(6), F.length(v) - 6) for k, v in sound.items()}  # {"v":...}
    # Spoilt ones make a claim with evidence, whatever the row says, so that nothing else is wrong with them.
    claim = {"policy_stance": F.lit('"hawkish"'), "supporting_evidence": F.lit(f"[{_item()}]"), "abstained": F.lit("false")}

    def payload(values: dict[str, str]) -> Column:
        own = sound | (claim if values else {}) | {k: F.lit(v) if v else None for k, v in values.items()}
        parts = [F.concat(F.lit(f'"{k}":'), v) for k, v in own.items() if v is not None]
        return F.concat(F.lit("{"), F.array_join(F.array(*parts), ","), F.lit("}"))

    case = F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(len(_WRONG)))
    text = F.lit("[]")
    for i, (codes, values) in enumerate(_WRONG):
        if codes != "not_an_object":
            text = F.when(case == i, payload(values)).otherwise(text)
    return _extracted(spark, sf).select("conv_id", "turn", F.array_join(stance.audit(text), ",").alias("errors"))


@register(
    "q_cache_reuse",
    f"""WITH {DOCS_SQL} SELECT document_id, doc_id % 2 = 0 AND doc_id % 10 <> 4 AND doc_id % 12 <> 6 AS reused FROM docs""",
)
def q_cache_reuse(spark: SparkSession, sf: str) -> DataFrame:
    """Every second document is in the cache, some with an error and some of an older schema."""
    docs = documents(spark, sf)
    work = cache.keyed(docs, "mock", "rules", "1")
    key = F.col("document_id").substr(4, 8).cast("int")
    held = work.where(key % 2 == 0).select(
        *(c for c in work.columns if c != "text"), F.when(key % 10 == 4, "error").otherwise("success").alias("status"),
        F.when(key % 12 == 6, "0.9").otherwise(stance.SCHEMA_VERSION).alias("schema_version"), F.lit("2024-01-01").alias("generated_at"),
    )
    return cache.probe(work, held).select("document_id", "reused")


@register("q_source_rows", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS source_row FROM documents")
def q_source_rows(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.numbered(table(spark, sf, "documents").select("doc_id"), "doc_id")
