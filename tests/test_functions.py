from pyspark.sql import functions as F

from tidemark.functions import identity, probs, stance, text


def one(spark, expr, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(expr).first()[0]


def url(spark, u):
    return one(spark, identity.canonical_url(F.col("u")), u=u)


def test_canonical_urls(spark):
    assert url(spark, " HTTPS://User:pw@Example.COM:443//a//b/?utm_source=x&z=2&a=%7Eq+r*&&k#frag ") == "https://example.com/a/b?a=~q+r%2A&k=&z=2"
    assert url(spark, "http://h:8080") == "http://h:8080/"
    assert url(spark, "http://h:99999/") == "" and url(spark, "http://h:x/") == "" and url(spark, "ftp://h/") == "" and url(spark, "http:///p") == "" and url(spark, None) == ""


def test_ids_and_duplicates(spark):
    a = one(spark, identity.document_id(F.lit("http://h/"), F.lit("x")), x=1)
    b = one(spark, identity.document_id(F.lit(""), F.lit("x")), x=1)
    assert a.startswith("fed_") and len(a) == 28 and a != b
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "b")], "i int, k string")
    got = {r.i: (r.d, r.l) for r in identity.flag_copies(df, ("k",), ("i",), "d", "l").collect()}
    assert got == {1: (True, False), 2: (True, True), 3: (True, False), 4: (True, True), 5: (False, False)}


def test_cleaning_takes_whole_lines_only(spark):
    raw = "Staff Statements Appended to the Transcript\nThe Meeting of the Federal Open Market Committee was long.\nMeeting of the Federal Open Market Committee May 3-4, 2011\nconti-\n nued  here \t\n\n\n\nx&amp;y ﬁ\x07"
    df = spark.createDataFrame([(raw,), (None,), ("",)], "t string")
    cleaned, rules = text.clean(F.col("t"))
    rows = df.select(cleaned.alias("c"), rules.alias("r")).collect()
    assert rows[0].c == "The Meeting of the Federal Open Market Committee was long.\n\ncontinued here\n\nx&y fi"
    assert rows[0].r == ["staff_statements_heading", "meeting_heading"]
    assert rows[1].c == rows[2].c == "" and rows[1].r == []


def test_diagnostics_never_go_below_zero(spark):
    d = text.diagnostics(F.lit("ﬁ"), F.lit("fi"))
    assert spark.range(1).select(*(c.alias(k) for k, c in d.items())).first().asDict() == {"raw_text_length": 1, "cleaned_text_length": 2, "characters_removed": 0, "removal_ratio": 0.0}


def test_splitters(spark):
    t = "One. two? 3rd!  Four\nFive. Six"
    assert one(spark, text.sentences_by_stop(F.col("t")), t=t) == ["One.", "two?", "3rd!", "Four\nFive.", "Six"]
    assert one(spark, text.sentences_by_line(F.col("t")), t=t) == ["One. two?", "3rd!", "Four", "Five.", "Six"]
    assert one(spark, text.paragraphs(F.col("t")), t="a\r\n\r\nb\n \n\n c \n") == ["a", "b", "c"]


def test_token_windows(spark):
    df = spark.createDataFrame([(list(range(9)),), ([],)], "t array<int>")
    rows = [r[0] for r in df.select(text.token_windows(F.col("t"), 6, 1)).collect()]
    assert [len(w) for w in rows[0]] == [4, 4, 3] and rows[0][1][0] == rows[0][0][-1] and rows[1] is None


def test_softmax_and_ties(spark):
    p = one(spark, probs.softmax(F.array(F.lit(1000.0), F.lit(1000.0))), x=1)
    assert p == [0.5, 0.5]
    assert one(spark, probs.softmax(F.array(F.lit(float("nan")), F.lit(0.0))), x=1) is None
    v = F.array(F.lit(0.4), F.lit(0.4), F.lit(0.2))
    assert one(spark, probs.first_largest(v, ("a", "b", "c")), x=1) == "a" and one(spark, probs.sole_largest(v, ("a", "b", "c")), x=1) == probs.TIE
    assert one(spark, probs.is_distribution(v), x=1) and not one(spark, probs.is_distribution(F.array(F.lit(0.4), F.lit(0.4))), x=1)


def test_probability_json(spark):
    df = spark.createDataFrame([('{"b":0.5,"a":0.5}',), ('{"a":1}',), ("{",), ("",), (None,)], "j string")
    cols = probs.decode(F.col("j"), ("a", "b"))
    rows = df.select(cols["a"].alias("a"), probs.decode_lenient(F.col("j")).alias("m")).collect()
    assert [r.a for r in rows] == [0.5, None, None, None, None] and rows[3].m == rows[4].m == {}
    assert one(spark, probs.encode(F.create_map(F.lit("b"), F.lit(1.0), F.lit("a"), F.lit(0.5))), x=1) == '{"a":0.5,"b":1.0}'
    named = one(spark, probs.normalised_labels(F.create_map(F.lit("LABEL_0"), F.lit(0.25), F.lit("Dovish "), F.lit(0.75)), {"label_0": "dovish"}), x=1)
    assert named == {"dovish": 1.0}


def test_stance_rules_and_negation(spark):
    s = lambda t: one(spark, stance.stance(F.col("t")), t=t)
    assert s("The Committee decided to raise the target range. It was late.").stance == "hawkish"
    assert s("They did not raise the target range.").stance == "insufficient_evidence"
    assert s("Not for one long day did they raise the target range.").stance == "hawkish"  # more than four words before
    both = s("A restrictive stance now! An accommodative policy later?")
    assert both.stance == "neutral_or_mixed" and len(both.evidence) == 2
    assert s("").evidence == []


def test_extraction_audit_and_grounding(spark):
    t = "Inflation is high because of demand. We will raise the target now. Risk remains."
    x = spark.range(1).select(stance.extract(F.lit(t)).alias("x")).withColumn("t", F.lit(t))
    row = x.select("x.*", stance.audit(F.to_json("x", {"ignoreNullFields": "false"})).alias("errors"), stance.ungrounded(F.col("x")["supporting_evidence"], F.col("t")).alias("loose")).first()
    assert row.policy_stance == "hawkish" and not row.abstained and row.errors == [] and row.loose == []
    assert [e.field for e in row.supporting_evidence] == ["policy_stance", "inflation_outlook", "key_risk", "policy_rationale"]
    nothing = spark.range(1).select(stance.extract(F.lit("")).alias("x")).select("x.*").first()
    assert nothing.abstained and nothing.policy_stance == "insufficient_evidence" and nothing.uncertainties == [stance.NOTHING_NOTE]
    bad = [("[]", ["not_an_object"]), ("{", ["not_an_object"])]
    for payload, want in bad:
        assert one(spark, stance.audit(F.col("p")), p=payload)[0] == want[0]
    assert set(stance.json_schema()["required"]) == set(stance.EXTRACTION_KEYS)


def test_words_and_categories(spark):
    assert one(spark, text.words(F.col("t"), ("the",)), t="The Rate, of-growth 2001 is") == ["rate", "growth", "2001"]
    groups = {"One": ("a", "b", "c"), "Two": ("a", "b", "d")}
    pick = lambda t: one(spark, text.best_category(text.label_tokens(F.col("t")), groups, "Other"), t=t)
    assert pick("A b!") == "One" and pick("d b a") == "Two" and pick("x") == "Other" and pick("") == "Other"
