"""Least squares by orthogonal factors: ill-conditioned and collinear designs, many factors, odd rows."""

import numpy as np
import pytest

from tidemark.stats import ols, qr


@pytest.fixture(scope="module")
def design():
    r = np.random.default_rng(4)
    x = r.normal(size=(500, 3)) * [1, 100, 0.01] + [5, 0, 3]
    return x, x @ [2.0, -0.03, 40.0] + 7 + r.normal(size=500)


def frame(spark, x, y, parts=8):
    return spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)], ", ".join([*(f"x{i} double" for i in range(x.shape[1])), "y double"])).repartition(parts)


def test_a_fit_equals_lapack_whatever_the_tree(spark, design, monkeypatch):
    x, y = design
    full = np.column_stack([np.ones(500), x])
    beta, rest, rank, _ = np.linalg.lstsq(full, y, rcond=None)
    for fan, parts in ((64, 3), (2, 13), (3, 30)):
        monkeypatch.setattr(qr, "FAN", fan)
        df = frame(spark, x, y, parts)
        f = ols.fit(df, ols.design(df, ("x0", "x1", "x2")), "y")
        assert np.allclose(f.beta, beta, rtol=1e-10) and abs(f.ssr - rest[0]) < 1e-8 * rest[0] and (f.n, f.dof, f.dropped) == (500, 496, [])
        assert np.allclose(f.inverse, np.linalg.inv(full.T @ full), rtol=1e-8)
        assert abs(f.tss - ((y - y.mean()) ** 2).sum()) < 1e-8 * f.tss


def test_a_design_that_cross_products_cannot_tell(spark, design):
    """Its condition is 1e10: squared, nothing of the difference is left."""
    x, y = design
    x = np.column_stack([x[:, 0], x[:, 0] + 1e-9 * x[:, 1] / 100])
    df = frame(spark, x, y)
    f = ols.fit(df, ols.design(df, ("x0", "x1")), "y")
    full = np.column_stack([np.ones(500), x])
    beta = np.linalg.lstsq(full, y, rcond=None)[0]
    assert f.dropped == [] and f.condition > 1e9
    assert abs(f.beta[1] + f.beta[2] - beta[1] - beta[2]) < 1e-5 and abs(f.beta[2] / beta[2] - 1) < 1e-4
    assert np.linalg.cond(full.T @ full) > 1e15


def test_collinear_terms_are_dropped_in_order(spark, design):
    x, y = design
    wide = np.column_stack([x[:, 0], 3 * x[:, 0] - 2, x[:, 1], np.full(500, 4.0), x[:, 2], x[:, 1] + x[:, 2], np.zeros(500)])
    df = frame(spark, wide, y)
    f = ols.fit(df, ols.design(df, tuple(f"x{i}" for i in range(7))), "y")
    assert f.names == ["Intercept", "x0", "x2", "x4"] and f.dropped == ["x1", "x3", "x5", "x6"] and f.dof == 496
    assert np.allclose(f.beta, np.linalg.lstsq(np.column_stack([np.ones(500), x]), y, rcond=None)[0], rtol=1e-9)
    assert [t for t, *_ in f.anova({"all": ("x0", "x2", "x4"), "none": ("x1",)})] == ["all", "none"]
    models = ols.hierarchy(df, ("x0",), [("twin", ("x1",)), ("more", ("x2", "x4"))], None, "y", 1, "y")
    assert [len(m["coefficients"]) for m in models] == [2, 2, 4] and "block_f" not in models[1] and models[2]["block_df"] == 2


def test_rows_that_lack_a_value_and_few_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, None), (None, 1.0), (float("nan"), 1.0), (float("inf"), 1.0), (4.0, 9.0)], "x double, y double")
    f = ols.fit(df, ols.design(df, ("x",)), "y")
    assert f.n == 3 and np.allclose(f.beta, np.polyfit([1, 2, 4], [2, 4, 9], 1)[::-1])
    r, n = qr.factor(df.where("x = 1"), ols.design(df, ("x",))[1], df["y"])
    assert n == 1 and qr.Solution(r, 1, 2).kept == [0]
    assert qr.factor(df.where("x > 99"), ols.design(df, ("x",))[1], df["y"])[1] == 0
