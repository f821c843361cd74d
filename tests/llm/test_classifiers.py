import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality_qda, toxicity_fm
from tidemark.llm.features import NAMES, text_statistics
from tidemark.llm.queries import queries

from .conftest import ODD


@pytest.mark.parametrize("name, label, least", [("op1_toxicity_machine", "toxic", 0.9), ("op10_quality_discriminant", "quality", 0.97)])
def test_held_out_accuracy(spark, name, label, least):
    sf = "/root/testdata/sf0.1"
    rows = queries()[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 500 and np.mean([r.predicted == r[label] for r in rows]) >= least
    assert all(0 <= r.score <= 1 for r in rows)


@pytest.mark.parametrize("score", [quality_qda.score, toxicity_fm.score])
def test_odd_rows_and_labels(spark, odd, empty, score):
    label = "toxic"
    labels = spark.createDataFrame([(i, i % 2, None, "x") for i in range(1, 12)] + [(3, None, 1, "x"), (99, 1, 1, "x"), (4, 0, 0, "x")], "doc_id long, toxic int, quality int, text string")
    rows = score(odd, labels, label).collect()
    assert sorted(r.doc_id for r in rows) == sorted(i for i, _ in ODD) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 7}) == 1
    only_ones = labels.where("toxic = 1")
    assert all(r.score > 0.5 for r in score(odd, only_ones, label).collect())
    assert all(r.score == 0.5 for r in score(odd, labels.limit(0), label).collect())
    assert score(empty, labels, label).collect() == []


def test_keep_good_keeps_columns(spark, odd):
    labels = spark.createDataFrame([(i, int(i > 7)) for i in range(1, 12)], "doc_id long, quality int")
    kept = quality_qda.keep_good(odd, labels, 0.0)
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_discriminant_equals_the_densities():
    r = np.random.default_rng(0)
    d = quality_qda.D
    x = [r.normal(size=(400, d)) @ r.normal(size=(d, d)) * 0.3 + k for k in (0, 1)]
    m = np.array([np.concatenate(([len(a)], a.sum(axis=0), (a.T @ a).ravel())) for a in x])
    model = quality_qda.fit(m, shrink=0.0, diagonal=0.0, temper=1.0)
    q = r.normal(size=(20, d))
    own = max(0.0, 2 * d / 400)
    covariances = [np.cov(a.T, bias=True) for a in x]
    pooled = (covariances[0] + covariances[1]) / 2 + 1e-4 * np.eye(d)
    logs = []
    for a, c in zip(x, covariances, strict=True):
        c = (1 - own) * c + own * pooled
        z = q - a.mean(axis=0)
        logs.append(-0.5 * (np.einsum("ij,jk,ik->i", z, np.linalg.inv(c), z) + np.linalg.slogdet(c)[1]))
    np.testing.assert_allclose(model.scores(q), 1 / (1 + np.exp(logs[0] - logs[1])), rtol=1e-6, atol=1e-9)


def test_statistics_have_their_names():
    assert {len(text_statistics(t)) for _, t in ODD} == {len(NAMES)} and np.isfinite([text_statistics(t) for _, t in ODD]).all()


def test_machine_learns_a_pair_that_no_term_tells(spark):
    """Two terms that are harmful together and harmless alone."""
    r = np.random.default_rng(2)
    a, b = r.random(3000) < 0.5, r.random(3000) < 0.5
    y = (a ^ b).astype(float)
    y = np.where(r.random(3000) < 0.02, 1 - y, y)
    words = [f"{'insult' if p else 'praise'} {'group' if q else 'person'} w{i % 97} v{i % 53}" for i, (p, q) in enumerate(zip(a, b, strict=True))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(words)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(t)) for i, t in enumerate(y)], "doc_id long, toxic int")
    scored = toxicity_fm.score(docs, labels, "toxic", F.col("doc_id") % 5 != 0).where("doc_id % 5 = 0").collect()
    assert np.mean([(r.score > 0.5) == (a[r.doc_id] ^ b[r.doc_id]) for r in scored]) > 0.9
    plain = 0.3 * np.arange(4)
    v = r.normal(size=(4, 8))
    machine = toxicity_fm.Machine(np.arange(4), 0.1, plain, v)
    got = machine.odds(np.array([0, 2, 3, 1]), np.array([0, 0, 0, 1]), 2)
    want = 0.1 + plain[[0, 2, 3]].sum() + sum(v[i] @ v[j] for i, j in ((0, 2), (0, 3), (2, 3)))
    np.testing.assert_allclose(got, [want, 0.1 + plain[1]])


def test_a_labelled_id_on_very_many_rows_is_learnt_from_a_bounded_sample(spark, monkeypatch):
    """One doc_id on 60,000 rows, all different, and another on 40,000 equal ones."""
    many = spark.range(60_000).selectExpr("0L as doc_id", "concat('insult number', id) as text")
    equal = spark.range(40_000).selectExpr("1L as doc_id", "'plain words again' as text")
    others = spark.range(2, 102).selectExpr("id as doc_id", "concat(if(id % 2 = 0, 'insult here ', 'kind words '), id) as text")
    docs = many.unionByName(equal).unionByName(others)
    labels = spark.range(102).selectExpr("id as doc_id", "cast(id % 2 = 0 as int) as toxic")
    seen = []
    fit = toxicity_fm.fit
    monkeypatch.setattr(toxicity_fm, "fit", lambda columns, common, rows, y, **more: seen.append((len(rows), float(y.sum()), [r.tolist() for r in rows])) or fit(columns, common, rows, y, **more))
    for parts in (3, 7):
        toxicity_fm.train(docs.repartition(parts), labels, sample=500)
    assert seen[0] == seen[1] and 400 <= seen[0][0] <= 501 and seen[0][1] > 0
    toxicity_fm.train(equal.unionByName(others), labels, sample=500)
    assert seen[2][0] == 101  # of equal rows one
