"""Rule-based stance with negation, structured extraction, its audit and its grounding."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import let
from .text import sentences_by_line, sentences_by_stop

# Phrases of either stance, and the words that turn a phrase that follows them around.
HAWKISH = (
    r"\braise(?:d|s|ing)? (?:the )?(?:target )?(?:rate|range)",
    r"\btighten(?:ed|ing)? (?:monetary )?policy",
    r"\binflation(?:ary)? (?:pressure|risk)s? remain(?:s)? elevated",
    r"\bupside risks? to inflation",
    r"\brestrictive (?:stance|policy)",
)
DOVISH = (
    r"\blower(?:ed|s|ing)? (?:the )?(?:target )?(?:rate|range)",
    r"\beas(?:e|ed|ing) (?:the )?(?:stance of )?(?:monetary )?policy",
    r"\bdownside risks? to (?:employment|growth|the economy)",
    r"\baccommodative (?:stance|policy)",
    r"\bsupport (?:maximum )?employment",
)
NEGATIONS = ("not", "no", "never", "without")
#: Words before a phrase among which a negation counts.
NEAR = 4

STANCES = ("hawkish", "dovish", "neutral_or_mixed", "insufficient_evidence")


def _matches(sentence: Column, patterns: tuple[str, ...], near: int, negations: tuple[str, ...]) -> Column:
    """The first match of each pattern, unless a negation stands among the words just before it."""

    def one(pattern: str) -> Column:
        pattern = f"(?iU){pattern}"
        found = F.regexp_extract(sentence, f"({pattern})", 1)
        before = F.regexp_extract_all(F.lower(F.substring(sentence, F.lit(1), F.regexp_instr(sentence, F.lit(pattern)) - 1)), F.lit(r"(?U)[\w']+"), F.lit(0))
        nearby = F.slice(before, F.greatest(F.size(before) - near + 1, F.lit(1)), F.lit(near))
        negated = F.arrays_overlap(nearby, F.array(*map(F.lit, negations)))
        return F.when((found != "") & ~negated, found)

    return F.array_compact(F.array(*map(one, patterns)))


def stance(text: Column, hawkish: tuple[str, ...] = HAWKISH, dovish: tuple[str, ...] = DOVISH, near: int = NEAR, negations: tuple[str, ...] = NEGATIONS) -> Column:
    """struct(stance, hawkish_matches, dovish_matches, evidence): evidence are the sentences that matched."""
    text, any_ = F.coalesce(text, F.lit("")), F.lit("(?iU)(?:" + "|".join((*hawkish, *dovish)) + ")")
    none = F.expr("cast(array() as array<struct<sentence:string,up:array<string>,down:array<string>>>)")

    def read(s: Column) -> Column:
        return F.struct(s.alias("sentence"), _matches(s, hawkish, near, negations).alias("up"), _matches(s, dovish, near, negations).alias("down"))

    def told(found: Column) -> Column:
        up, down = F.flatten(F.transform(found, lambda r: r["up"])), F.flatten(F.transform(found, lambda r: r["down"]))
        quotes = F.transform(F.filter(found, lambda r: (F.size(r["up"]) > 0) | (F.size(r["down"]) > 0)), lambda r: r["sentence"])
        return F.struct(_decide(F.size(up) > 0, F.size(down) > 0).alias("stance"), up.alias("hawkish_matches"), down.alias("dovish_matches"), quotes.alias("evidence"))

    # Each sentence is read once, and only sentences and texts that hold any phrase are.
    some = F.when(F.regexp_like(text, any_), F.transform(F.filter(sentences_by_stop(text), lambda s: F.regexp_like(s, any_)), read)).otherwise(none)
    return let(some, told)


def _decide(up: Column, down: Column) -> Column:
    return F.when(up & down, "neutral_or_mixed").when(up, "hawkish").when(down, "dovish").otherwise("insufficient_evidence")


# Terms that the offline extraction looks for, and its contract.
SCHEMA_VERSION = "1.0"
TERMS = {
    "inflation_outlook": ("inflation", "price stability", "prices"),
    "labor_market_outlook": ("employment", "labor market", "unemployment"),
    "economic_growth_outlook": ("economic activity", "growth", "gdp"),
    "key_risk": ("risk",),
    "policy_rationale": ("because", "in light of", "to achieve"),
    "hawkish": ("raise the target", "tighten", "restrictive", "inflation remains elevated"),
    "dovish": ("lower the target", "easing", "accommodative", "downside risks to employment"),
}
EVIDENCE_FIELDS = ("policy_stance", "inflation_outlook", "labor_market_outlook", "economic_growth_outlook", "key_risk", "policy_rationale")
CLAIM_TYPES = ("explicit", "inference")
MIXED_NOTE = "Both hawkish and dovish language is present."
NOTHING_NOTE = "No supported policy signals were identified."
EXPLANATION = "The passage explicitly supports {}."

EVIDENCE_TYPE = "array<struct<field:string,quote:string,claim_type:string,explanation:string>>"
EXTRACTION_TYPE = (
    "struct<schema_version:string,policy_stance:string,inflation_outlook:string,labor_market_outlook:string,economic_growth_outlook:string,"
    f"key_risks:array<string>,policy_rationale:array<string>,supporting_evidence:{EVIDENCE_TYPE},uncertainties:array<string>,abstained:boolean>"
)
EXTRACTION_KEYS = ("schema_version", "policy_stance", "inflation_outlook", "labor_market_outlook", "economic_growth_outlook", "key_risks", "policy_rationale", "supporting_evidence", "uncertainties", "abstained")
OPTIONAL_TEXT = ("inflation_outlook", "labor_market_outlook", "economic_growth_outlook")
TEXT_LISTS = ("key_risks", "policy_rationale", "uncertainties")
EVIDENCE_KEYS = ("field", "quote", "claim_type", "explanation")


def extract(text: Column, terms: dict[str, tuple[str, ...]] = TERMS, most: int = 3) -> Column:
    """Offline structured extraction: sentences that hold certain terms, as fields with quoted evidence."""
    singles = (*OPTIONAL_TEXT, "hawkish", "dovish")

    def quoted(sentences: Column) -> Column:
        def holding(field: str) -> Column:
            return F.filter(sentences, lambda s: F.exists(F.array(*map(F.lit, terms[field])), lambda t: F.contains(F.lower(s), t)))

        several = (F.slice(holding(f), 1, most).alias(f) for f in ("key_risk", "policy_rationale"))
        return F.struct(*(F.get(holding(f), 0).alias(f) for f in singles), *several)

    found = let(sentences_by_line(F.coalesce(text, F.lit(""))), quoted)
    return let(found, lambda q: _extraction({f: q[f] for f in singles}, q["key_risk"], q["policy_rationale"]))


def _extraction(first: dict[str, Column], risks: Column, reasons: Column) -> Column:
    up, down = first["hawkish"], first["dovish"]

    def told(field: str, quotes: Column) -> Column:
        why = F.lit(EXPLANATION.format(field.replace("_", " ")))
        return F.transform(F.array_compact(quotes), lambda q: F.struct(F.lit(field).alias("field"), q.alias("quote"), F.lit("explicit").alias("claim_type"), why.alias("explanation")))

    evidence = F.array_distinct(F.concat(
        told("policy_stance", F.array(up, down)), *(told(f, F.array(first[f])) for f in OPTIONAL_TEXT), told("key_risk", risks), told("policy_rationale", reasons),
    ))
    some = F.size(evidence) > 0
    notes = F.when(up.isNotNull() & down.isNotNull(), F.array(F.lit(MIXED_NOTE))).when(some, F.array().cast("array<string>")).otherwise(F.array(F.lit(NOTHING_NOTE)))
    return F.struct(
        F.lit(SCHEMA_VERSION).alias("schema_version"), _decide(up.isNotNull(), down.isNotNull()).alias("policy_stance"), *(first[f].alias(f) for f in OPTIONAL_TEXT),
        risks.alias("key_risks"), reasons.alias("policy_rationale"), evidence.alias("supporting_evidence"), notes.alias("uncertainties"), (~some).alias("abstained"),
    )


def audit(payload: Column) -> Column:
    """Codes of everything that is wrong with an extraction in JSON; none for a sound one.

    Values are looked at with the types that they have in the JSON (VARIANT), never cast: a number is no text and a text
    no boolean, in lists and evidence items too. A key that is missing is told once, as such.
    """
    return let(F.try_parse_json(payload), lambda v: let(_parts(v), _codes))


def _kind(v: Column) -> Column:
    """STRING, BOOLEAN, VOID (a JSON null), ARRAY<...>, OBJECT<...> or a number's type; null where there is nothing."""
    return F.schema_of_variant(v)


def _text(v: Column) -> Column:
    """A value that is text, else null."""
    return F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _said(text: Column) -> Column:
    """Is this a text with something in it?"""
    return F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _items(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "array<variant>")


def _parts(v: Column) -> Column:
    """What the checks look at, each taken out of the document once."""
    at = {k: F.try_variant_get(v, f"$.{k}", "variant") for k in EXTRACTION_KEYS}
    texts = [F.struct(_kind(at[k]).alias("kind"), _text(at[k]).alias("text")).alias(k) for k in ("schema_version", "policy_stance", *OPTIONAL_TEXT)]
    lists = [F.struct(_kind(at[k]).alias("kind"), F.transform(_items(v, k), lambda x: _said(_text(x))).alias("said")).alias(k) for k in TEXT_LISTS]

    def item(e: Column) -> Column:
        own = F.try_variant_get(e, "$", "map<string,variant>")
        return F.struct(F.map_keys(own).alias("keys"), *(_text(F.try_variant_get(e, f"$.{k}", "variant")).alias(k) for k in EVIDENCE_KEYS))

    evidence = F.struct(_kind(at["supporting_evidence"]).alias("kind"), F.transform(_items(v, "supporting_evidence"), item).alias("items")).alias("supporting_evidence")
    abstained = F.when(_kind(at["abstained"]) == "BOOLEAN", F.try_variant_get(v, "$.abstained", "boolean")).alias("abstained")
    return F.struct(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")).alias("keys"), *texts, *lists, evidence, _kind(at["abstained"]).isNotNull().alias("abstains"), abstained)


def _codes(x: Column) -> Column:
    keys, expected = x["keys"], F.array(*map(F.lit, EXTRACTION_KEYS))
    code = lambda cond, name: F.when(F.coalesce(cond, F.lit(False)), F.lit(name))
    there = lambda k: x[k]["kind"].isNotNull()
    stance, evidence = _bare(x["policy_stance"]["text"]), x["supporting_evidence"]["items"]
    wanted = F.array(*map(F.lit, EVIDENCE_KEYS))

    def odd(e: Column) -> Column:
        return e["keys"].isNull() | (F.size(F.array_except(wanted, e["keys"])) + F.size(F.array_except(e["keys"], wanted)) > 0)

    def other(field: str, allowed: tuple[str, ...]) -> Column:
        return F.exists(evidence, lambda e: _said(e[field]) & ~_bare(e[field]).isin(*allowed))

    return F.array_compact(F.array(
        code(keys.isNull(), "not_an_object"),
        code(F.size(F.array_except(expected, keys)) > 0, "missing_keys"), code(F.size(F.array_except(keys, expected)) > 0, "unexpected_keys"),
        code(there("schema_version") & ~F.coalesce(_bare(x["schema_version"]["text"]) == SCHEMA_VERSION, F.lit(False)), "schema_version"),
        code(there("policy_stance") & ~F.coalesce(stance.isin(*STANCES), F.lit(False)), "policy_stance"),
        code(x["abstains"] & x["abstained"].isNull(), "abstained"),
        *(code(there(f) & ~x[f]["kind"].isin("STRING", "VOID"), f"not_text_{f}") for f in OPTIONAL_TEXT),
        *(code((x[f]["kind"] == "STRING") & ~_said(x[f]["text"]), f"blank_{f}") for f in OPTIONAL_TEXT),
        *(code(there(f) & (x[f]["said"].isNull() | F.exists(x[f]["said"], lambda s: ~s)), f"list_{f}") for f in TEXT_LISTS),
        code(there("supporting_evidence") & evidence.isNull(), "evidence_list"), code(F.exists(evidence, odd), "evidence_item"),
        code(F.exists(evidence, lambda e: ~odd(e) & ~reduce(and_, (_said(e[k]) for k in EVIDENCE_KEYS))), "evidence_text"),
        code(other("field", EVIDENCE_FIELDS), "evidence_field"), code(other("claim_type", CLAIM_TYPES), "evidence_claim_type"),
        code(x["abstained"] & (stance != "insufficient_evidence"), "abstained_with_stance"),
        code(~x["abstained"] & (F.size(evidence) == 0), "claim_without_evidence"),
    ))


def ungrounded(evidence: Column, source: Column) -> Column:
    """Quotes that are not in the source word for word."""
    return F.transform(F.filter(evidence, lambda e: ~F.contains(source, e["quote"])), lambda e: e["quote"])


def json_schema() -> dict:
    """The contract for a provider: closed objects, enumerations, nullable text."""
    text, texts = {"type": "string"}, {"type": "array", "items": {"type": "string"}}
    maybe = {"type": ["string", "null"]}
    item = {"field": {"type": "string", "enum": list(EVIDENCE_FIELDS)}, "quote": text, "claim_type": {"type": "string", "enum": list(CLAIM_TYPES)}, "explanation": text}
    fields = {
        "schema_version": {"type": "string", "enum": [SCHEMA_VERSION]}, "policy_stance": {"type": "string", "enum": list(STANCES)}, **{f: maybe for f in OPTIONAL_TEXT},
        "key_risks": texts, "policy_rationale": texts,
        "supporting_evidence": {"type": "array", "items": {"type": "object", "properties": item, "required": list(item), "additionalProperties": False}},
        "uncertainties": texts, "abstained": {"type": "boolean"},
    }
    return {"type": "object", "properties": fields, "required": list(fields), "additionalProperties": False}


def compared(status: Column, stance: Column, abstained: Column) -> Column:
    """An extraction's stance by the names of expert labels; null for failures, abstentions and no evidence."""
    none = ~status.eqNullSafe(F.lit("success")) | F.coalesce(abstained, F.lit(False)) | (stance == "insufficient_evidence")
    return F.when(~F.coalesce(none, F.lit(False)), F.when(stance == "neutral_or_mixed", "neutral").otherwise(stance))
