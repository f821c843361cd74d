import re
from collections import Counter

import numpy as np

from tidemark.operators import lda, topics


def plain(beta, words, alpha):
    """A document's topics by plain steps, and how many."""
    ids, n = list(words), np.array(list(words.values()), float)
    gamma, steps = np.ones(beta.shape[1]), 0
    while True:
        theta = lda.exp_digamma(gamma)
        new, steps = theta * (beta[ids].T @ (n / (beta[ids] @ theta))) + alpha, steps + 1
        if np.abs(new - gamma).mean() < 1e-6:
            return new, steps
        gamma = new


def drawn(rng, n, terms):
    return [Counter(rng.integers(0, terms, int(size)).tolist()) for size in rng.integers(0, 120, n)]


def laid(docs):
    return np.cumsum([0, *map(len, docs)]), np.array([w for d in docs for w in d], np.int32), np.array([c for d in docs for c in d.values()], np.int32)


def test_digamma():
    x = np.array([0.01, 0.25, 1.0, 2.5, 40.0, 1e6])
    with_steps = sum(-1 / (x + i) for i in range(400)) + np.log(x + 400) - 0.5 / (x + 400) - 1 / (12 * (x + 400) ** 2)
    assert np.allclose(lda.exp_digamma(x), np.exp(with_steps), rtol=1e-9)


def test_fitted_documents_are_at_their_fixed_points_after_few_steps(monkeypatch):
    """Topics that are nearly alike, as at the start: plain steps creep."""
    rng = np.random.default_rng(3)
    docs, beta = drawn(rng, 60, 400), rng.gamma(100, 0.01, (400, 4)) / 400
    seen, formula = [], lda.exp_digamma
    monkeypatch.setattr(lda, "exp_digamma", lambda x: seen.append(len(x)) or formula(x))
    monkeypatch.setattr(lda, "CHANGE", 1e-6)
    gammas, sums = lda.fit(beta, *laid(docs), 0.25)
    monkeypatch.undo()
    taken, at, want = sum(seen), 0, np.zeros_like(beta)
    for d, gamma in zip(docs, gammas, strict=True):
        if not d:
            assert not gamma.any()
            continue
        own, steps = plain(beta, d, 0.25)
        at += steps
        again = lda.exp_digamma(gamma)
        ids, n = list(d), np.array(list(d.values()), float)
        # A step from where it stands changes nothing, and the words are as likely as there.
        assert np.abs(again * (beta[ids].T @ (n / (beta[ids] @ again))) + 0.25 - gamma).mean() < 1e-5
        assert abs(gamma.sum() - 1 - n.sum()) < 1e-4 and abs(own.sum() - gamma.sum()) < 1e-4
        want[ids] += np.outer(n / (beta[ids] @ again), np.ones(4)) * again
    assert np.allclose(sums, want) and taken * 3 < at


def test_blocks_and_shards_change_no_topic(spark, sf_small, monkeypatch):
    """Many blocks and shards give what one loop over all documents gives."""
    monkeypatch.setattr(lda, "BLOCK", 3000)
    monkeypatch.setattr(lda, "SHARD", 700)
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").where("doc_id < 120 and text is not null").repartition(3)
    stored = lda.kept(lda.blocks(docs, "text", ("doc_id",)), "blocks")
    numbered, size = lda.vocabulary(stored, 2, 0.95)
    place = {r.term: (r.shard, r.pos) for r in numbered.collect()}
    assert stored.count() > 3 and len({s for s, _ in place.values()}) > 2
    stop = set(lda.StopWordsRemover.loadDefaultStopWords("english"))
    texts = {r.doc_id: Counter(w for w in re.findall("[a-z]{3,}", r.text.lower()) if w not in stop) for r in docs.collect()}
    seen = Counter(w for d in texts.values() for w in d)
    terms = sorted(w for w, n in seen.items() if 2 <= n <= 0.95 * len(texts))
    assert set(terms) == set(place) and size == len(terms)
    first = {s: np.random.default_rng([7, s]).gamma(100, 0.01, (sum(x == s for x, _ in place.values()), 3)) for s in {s for s, _ in place.values()}}
    weights, at = np.array([first[place[t][0]][place[t][1]] for t in terms]), {t: i for i, t in enumerate(terms)}
    own = {k: Counter({at[w]: n for w, n in d.items() if w in at}) for k, d in texts.items()}
    for _ in range(2):
        beta = lda.exp_digamma(weights) / lda.exp_digamma(weights.sum(axis=0))
        weights = 1 / 3 + lda.fit(beta, *laid(own.values()), 1 / 3)[1] * beta
    model, assigned, leading = topics.lda(docs, "text", 3, terms=4, seed=7, iterations=2, keep=("doc_id",))
    found = model.stages[-1].topicsMatrix().toArray()
    # Sums are added in another order, and a document between two topics may settle with either.
    assert np.abs(found - weights).sum() < 0.01 * weights.sum() and np.allclose(found.sum(axis=1), weights.sum(axis=1), rtol=1e-5)
    weights = found
    beta = lda.exp_digamma(weights) / lda.exp_digamma(weights.sum(axis=0))
    gammas = lda.fit(beta, *laid(own.values()), 1 / 3)[0]
    want = {k: (int(g.argmax()), g.max() / max(g.sum(), 1e-9)) for k, g in zip(own, gammas, strict=True)}

    def same(rows):
        return {r.doc_id for r in rows} == set(want) and sum(r.topic == want[r.doc_id][0] and abs(r.topic_weight - want[r.doc_id][1]) < 1e-3 for r in rows) > 0.95 * len(want)

    assert assigned.columns == ["doc_id", "topic", "topic_weight"]
    assert same(assigned.collect())
    again = model.transform(docs.select("text", "doc_id"))
    assert again.columns == ["text", "doc_id", "topic", "topic_weight"] and same(again.collect())
    shares = weights / weights.sum(axis=0)
    for r in leading.collect():
        assert abs(r.weight - np.sort(shares[:, r.topic])[-r["rank"]]) < 1e-6 and abs(shares[at[r.term], r.topic] - r.weight) < 1e-6
