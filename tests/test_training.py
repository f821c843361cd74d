"""The training loop: gradients, resumption, the best epoch, odd rows."""

import random
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import training

S = training.Settings(("no", "yes", "maybe"), features=256, batches=3)


def texts(n):
    r = random.Random(2)
    out = []
    for i in range(n):
        label = r.choice(S.labels)
        own = {"no": ["never", "bad"], "yes": ["always", "good"], "maybe": ["perhaps", "unsure"]}[label]
        out.append((i, " ".join(r.choice(own + ["word", "other", "thing"]) for _ in range(r.randrange(1, 12))), label))
    return [*out, (n, None, "yes"), (n + 1, "", "no"), (n + 2, "never " * 5000, "no"), (n + 3, "good", "unknown"), (n + 4, "good", None), (None, "good", "yes")]


@pytest.fixture(scope="module")
def examples(spark):
    df = spark.createDataFrame(texts(400), "id long, text string, label string")
    return training.prepared(df, "id", "text", "label", S)


def test_prepared_rows(examples):
    rows = examples.collect()
    assert len(rows) == 403 and {r.split for r in rows} == {"train", "validation"}
    for i in range(3):
        own = [r for r in rows if r.label == i]
        assert sum(r.split == "validation" for r in own) == round(0.2 * len(own))


def test_gradient_equals_differences_of_the_loss(spark, examples):
    r = np.random.default_rng(0)
    state = training.State.new(S)
    state.weights = r.normal(size=state.weights.shape) * 0.1
    rows = examples.where("split = 'train'")
    gradient, loss, n = training._summed(rows, state)
    assert n == rows.count() and gradient.shape == state.weights.shape
    for at in [(256, 1), (256, 0), *((int(i), 2) for i in np.argsort(-np.abs(gradient[:, 2]))[:2])]:
        state.weights[at] += 1e-5
        up = training._summed(rows, state)[1]
        state.weights[at] -= 2e-5
        down = training._summed(rows, state)[1]
        state.weights[at] += 1e-5
        assert abs((up - down) / 2e-5 - gradient[at]) < 1e-6


def test_many_partial_sums_are_added_in_a_tree(spark, examples, monkeypatch):
    state = training.State.new(S)
    want = training._summed(examples, state)
    monkeypatch.setattr(training, "FAN", 2)
    got = training._summed(examples.repartition(13), state)
    assert np.allclose(got[0], want[0]) and abs(got[1] - want[1]) < 1e-12 and got[2] == want[2]


def test_a_resumed_run_equals_an_unbroken_one(spark, examples, tmp_path):
    whole, broken = f"file://{tmp_path}/whole", f"file://{tmp_path}/broken"
    want = sorted(map(tuple, training.train(examples, whole, S, 4).collect()))
    training.train(examples, broken, S, 2)
    # Lost in the middle of an epoch: nothing of it is in the folder but what its writer had not committed.
    (tmp_path / "broken" / "_temporary").mkdir(exist_ok=True)
    assert sorted(map(tuple, training.train(examples, broken, S, 4).collect())) == want
    assert training.best(spark, broken, S).dump() == training.best(spark, whole, S).dump()
    assert [r[0] for r in want] == [1, 2, 3, 4] and sum(r[4] for r in want) == 1
    best = max(want, key=lambda r: (r[3], -r[0]))
    assert best[4] and best[3] > 0.8 and want[3][1] < want[0][1]
    # Another run's settings know nothing of these epochs.
    assert training.history(spark, whole, training.Settings(S.labels, features=128)).collect() == []
    shutil.rmtree(tmp_path / "whole")
    with pytest.raises(ValueError):
        training.best(spark, whole, S)


def test_no_rows(spark, tmp_path):
    df = spark.createDataFrame([], "id long, text string, label string")
    rows = training.train(training.prepared(df, "id", "text", "label", S), f"file://{tmp_path}/none", S, 1).collect()
    assert [(r.epoch, r.accuracy, r.macro_f1) for r in rows] == [(1, 0.0, 0.0)]


def test_predictions_of_new_texts(spark, examples, tmp_path):
    folder = f"file://{tmp_path}/m"
    training.train(examples, folder, S, 3)
    df = spark.createDataFrame([(1, "always good", "yes"), (2, "never bad", "no"), (3, "perhaps unsure", "maybe")], "id long, text string, label string")
    got = training.predictions(training.prepared(df, "id", "text", "label", S), training.best(spark, folder, S), S)
    assert got.where(F.col("truth") == F.col("guess")).count() == 3
