"""Every query with an oracle gives the oracle's rows on the small tables, and every other what plain Python gives."""

import hashlib
import html
import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.plans import catalogue, queries_stats

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    return round(v, 4) + 0.0 if isinstance(v, float) else v


@pytest.fixture(scope="module")
def con(sf_small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_small}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_oracle(spark, con, sf_small, name):
    df = catalogue.queries()[name](spark, sf_small)
    cols = sorted(df.columns)
    found = con.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = sorted(repr([norm(r[names.index(c)]) for c in cols]) for r in found.fetchall())
    assert sorted(repr([norm(r[c]) for c in cols]) for r in df.collect()) == want


def found(spark, sf, name):
    return catalogue.queries()[name](spark, sf).collect()


def rows_of(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet").collect()


def test_every_query_without_an_oracle_is_held_against_python():
    own = {"q_clean_pages", "q_stratified_sample", "q_topics_lda", "q_model_windows", "q_nested_models", "q_crisis_sensitivity", "q_model_diagnostics", "q_training_run", "q_topic_clusters", "q_topic_words"}
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) == own


def test_clean_pages(spark, sf_small):
    got = {r.page_id: (r.cleaned_sha256, r.rules) for r in found(spark, sf_small, "q_clean_pages")}
    for r in rows_of(spark, sf_small, "pages"):
        t = unicodedata.normalize("NFKC", html.unescape(r.html or ""))
        t = t.replace("\ufeff", "").replace("ï»¿", "")
        for pattern, put in ((r"(\w)-\s*\n\s*(\w)", r"\1\2"), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n"), (r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""), (r"[ \t]{2,}", " ")):
            t = re.sub(pattern, put, t)
        assert got.pop(r.page_id) == (hashlib.sha256(t.strip().encode()).hexdigest(), "")
    assert got == {}


def test_stratified_sample(spark, sf_small):
    rows, labels = found(spark, sf_small, "q_stratified_sample"), {r.doc_id: r.quality for r in rows_of(spark, sf_small, "labels")}
    most = Counter(labels.values())
    assert Counter(r.label for r in rows) == {k: min(30, n) for k, n in most.items()} and len({r.doc_id for r in rows}) == len(rows)
    assert all(labels[r.doc_id] == r.label for r in rows) and sorted(rows) == sorted(found(spark, sf_small, "q_stratified_sample"))


def test_topics_lda(spark, sf_small):
    rows = found(spark, sf_small, "q_topics_lda")
    words = {r.doc_id: set(re.findall("[a-z]{3,}", r.text.lower())) for r in rows_of(spark, sf_small, "documents") if r.text is not None}
    shared = {w for w, n in Counter(w for own in words.values() for w in own).items() if n > 1}
    assert {r.doc_id for r in rows} == set(words) and len({r.topic for r in rows}) > 1
    # A document without a word of the vocabulary is of the first topic, with no weight.
    assert all(r.topic in range(4) and (0.25 <= r.topic_weight <= 1 or ((r.topic, r.topic_weight) == (0, 0.0) and not words[r.doc_id] & shared)) for r in rows)


def test_model_windows(spark, sf_small):
    labels = ("hawkish", "dovish", "neutral")
    got = {r.key: (r.status, r.label, r.chunk_count, r.token_count) for r in found(spark, sf_small, "q_model_windows")}
    for r in rows_of(spark, sf_small, "conversations"):
        ids = [zlib.crc32(w.encode()) % 30000 for w in re.split(r"[ \t\n\x0b\f\r]+", r.text or "")]
        windows = [ids[i : i + 64] for i in range(0, max(len(ids) - 8 - 1, 0) + 1, 56)]
        total = np.zeros(3)
        for w in windows:
            e = np.exp([(zlib.crc32(f"{k}:{sum(w)}:{len(w)}".encode()) % 2000) / 1000 - 1 for k in labels])
            total += e / e.sum() * len(w)
        assert got.pop(f"{r.conv_id}-{r.turn}") == ("success", labels[int(total.argmax())], len(windows), sum(map(len, windows)))
    assert got == {}


def fitted(sample, terms, y):
    """Names, coefficients, HC3 errors, adjusted R², residuals and design by plain linear algebra; the first era is the base."""
    eras = sorted({r.era for r in sample})[1:] if "era" in terms else []
    x = np.array([[1.0, *(float(r.era == e) for e in eras), *(float(r[t]) for t in terms if t != "era")] for r in sample])
    out = np.array([float(r[y]) for r in sample])
    inverse = inverse_of(x)
    beta = np.linalg.lstsq(x, out, rcond=None)[0]
    e = out - x @ beta
    h = np.einsum("ij,jk,ik->i", x, inverse, x)
    hc3 = inverse @ ((x * (e / (1 - h))[:, None]).T @ (x * (e / (1 - h))[:, None])) @ inverse
    adjusted = 1 - (e @ e) / ((out - out.mean()) ** 2).sum() * (len(out) - 1) / (len(out) - x.shape[1])
    return ["Intercept", *(f"era[T.{v}]" for v in eras), *(t for t in terms if t != "era")], beta, np.sqrt(np.diag(hc3)), adjusted, e, x


def inverse_of(x):
    """Of the cross products, by way of the triangle of x, whose condition is not squared."""
    back = np.linalg.inv(np.linalg.qr(x, mode="r"))
    return back @ back.T


def near(a, b, share=1e-5):
    return abs(a - b) <= share * max(1.0, abs(b))


def test_nested_models(spark, sf_small):
    sample = sorted(queries_stats._sample(spark, sf_small).collect(), key=lambda r: r.event_date)
    rows = defaultdict(list)
    for r in found(spark, sf_small, "q_nested_models"):
        rows[r.outcome, r.model].append(r)
    terms = ["era", "prior_value", "pre_change_1d"]
    for model, more in (("baseline", []), ("external", ["pre_price_1d"]), ("memory", ["pre_change_5d"])):
        terms += more
        for y in ("change_1d", "change_5d"):
            names, beta, se, adjusted, e, x = fitted(sample, terms, y)
            if y == "change_5d":
                u = x * e[:, None]
                middle = u.T @ u + sum((1 - k / 6) * (u[k:].T @ u[:-k] + u[:-k].T @ u[k:]) for k in range(1, 6))
                inverse = inverse_of(x)
                se = np.sqrt(np.diag(inverse @ middle @ inverse))
            got = rows[y, model]
            assert [r.term for r in got] == names
            assert all(near(r.coefficient, b) and near(r.std_error, s, 1e-4) and near(r.adjusted_r_squared, adjusted) for r, b, s in zip(got, beta, se, strict=True))
            assert all(math.isnan(r.block_p) == (model == "baseline") for r in got)


def test_crisis_sensitivity(spark, sf_small):
    sample = [r for r in queries_stats._sample(spark, sf_small).collect() if not 2007 <= r.event_date.year + 10 <= 2009]
    terms = ["prior_value", "pre_change_1d"]
    got = {r.model: (r.nobs, r.adjusted_r_squared) for r in found(spark, sf_small, "q_crisis_sensitivity")}
    for model, more in (("baseline", []), ("external", ["pre_price_1d"]), ("memory", ["pre_change_5d"])):
        terms += more
        assert got[model][0] == len(sample) and near(got[model][1], fitted(sample, terms, "change_1d")[3])


def test_model_diagnostics(spark, sf_small):
    sample = sorted(queries_stats._sample(spark, sf_small).collect(), key=lambda r: r.event_date)
    *_, e, x = fitted(sample, ["prior_value", "pre_change_1d", "pre_price_1d"], "change_1d")
    n, k = x.shape
    h = np.einsum("ij,jk,ik->i", x, inverse_of(x), x)
    cook = e**2 * h / (k * (e @ e) / (n - k) * (1 - h) ** 2)
    m2, m3, m4 = ((e**p).mean() for p in (2, 3, 4))
    want = {"rmse": math.sqrt(m2), "durbin_watson": ((e[1:] - e[:-1]) ** 2).sum() / (e @ e), "skew": m3 / m2**1.5, "kurtosis": m4 / m2**2, "jarque_bera": n / 6 * (m3**2 / m2**3 + (m4 / m2**2 - 3) ** 2 / 4)}
    want |= {"max_cook": cook.max(), "influential": float((cook > 4 / n).sum()), "condition_number": np.linalg.cond(x)}
    for i, t in enumerate(("prior_value", "pre_change_1d", "pre_price_1d"), 1):
        others = np.delete(x, i, axis=1)
        rest = x[:, i] - others @ np.linalg.lstsq(others, x[:, i], rcond=None)[0]
        want[f"vif_{t}"] = ((x[:, i] - x[:, i].mean()) ** 2).sum() / (rest @ rest)
    got = {r.measure: r.value for r in found(spark, sf_small, "q_model_diagnostics")}
    assert all(near(got[m], v, 1e-4) for m, v in want.items())


def test_training_run(spark, sf_small):
    rows = sorted(found(spark, sf_small, "q_training_run"))
    assert [r.epoch for r in rows] == [1, 2, 3] and rows[2].loss < rows[0].loss
    assert [r.epoch for r in rows if r.best] == [max(rows, key=lambda r: (r.macro_f1, -r.epoch)).epoch]
    assert all(0 <= r.macro_f1 <= 1 and 0.5 < r.accuracy <= 1 for r in rows)


def test_topics_of_embeddings(spark, sf_small):
    """Members and words of topics; the tree itself is held against plain Python elsewhere."""
    topics = {r.vec_id: r.topic for r in found(spark, sf_small, "q_topic_clusters")}
    assert set(topics) == {r.vec_id for r in rows_of(spark, sf_small, "embeddings")}
    sizes = Counter(t for t in topics.values() if t is not None)
    assert sizes and all(n >= 8 and topics[t] == t for t, n in sizes.items())
    words = defaultdict(Counter)
    for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", F.lower("text").alias("t")).collect():
        if topics.get(r.doc_id) is not None:
            words[topics[r.doc_id]].update(w for w in re.sub("[^a-z0-9]+", " ", r.t or "").split() if len(w) > 2 and w not in ("the", "and", "der"))
    total, mean = sum(words.values(), Counter()), np.mean([sum(c.values()) for c in words.values()])
    got = defaultdict(list)
    for r in sorted(found(spark, sf_small, "q_topic_words"), key=lambda r: r["rank"]):
        got[r.topic].append((r.term, round(r.weight, 6)))
    for t, c in words.items():
        weight = {w: round(n / sum(c.values()) * math.log1p(mean / total[w]), 9) for w, n in c.items()}
        assert got[t] == [(w, round(weight[w], 6)) for w in sorted(weight, key=lambda w: (-weight[w], w))[:10]]
