"""Least squares: Spark folds all rows into one triangular factor, the driver solves the k x k system.

Nothing of the size of the data leaves Spark: leverages, residuals, the middle of robust covariances
and the diagnostics are aggregates of expressions over rows. Lagged terms (HAC, Durbin-Watson)
need the rows in order, range by range of it.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..operators.ordered import Ordered
from . import dist, qr


def design(df: DataFrame, numbers: tuple[str, ...], factor: str | None = None) -> tuple[list[str], list[Column]]:
    """Names and expressions of the columns: intercept, treatment-coded factor (the first sorted level is
    the reference), numbers."""
    names, cols = ["Intercept"], [F.lit(1.0)]
    if factor:
        levels = [r[0] for r in df.select(factor).distinct().orderBy(factor).collect()]
        for lv in levels[1:]:
            names.append(f"{factor}[T.{lv}]")
            cols.append((F.col(factor) == F.lit(lv)).cast("double"))
    return names + list(numbers), cols + [F.col(c).cast("double") for c in numbers]


def varying(df: DataFrame, numbers: tuple[str, ...]) -> tuple[str, ...]:
    """Terms with more than one value."""
    if not numbers:
        return ()
    n = df.agg(*(F.count_distinct(c).alias(c) for c in numbers)).first()
    return tuple(c for c in numbers if n[c] > 1)


def gram(df: DataFrame, cols: list[Column], y: str) -> tuple[np.ndarray, np.ndarray, float, int, float]:
    """X'X, X'y, y'y, number of rows and sum of y in one pass."""
    k = len(cols)
    v = F.col(y).cast("double")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = df.agg(*(F.sum(cols[i] * cols[j]) for i, j in pairs), *(F.sum(c * v) for c in cols), F.sum(v * v), F.count(F.lit(1)), F.sum(v)).first()
    xx = np.zeros((k, k))
    for (i, j), s in zip(pairs, row[: len(pairs)], strict=True):
        xx[i, j] = xx[j, i] = s
    m = len(pairs)
    return xx, np.array(row[m : m + k], float), float(row[m + k]), int(row[m + k + 1]), float(row[m + k + 2])


class Fit:
    """A fitted model with everything that needs no further look at the rows. Terms that those before them explain are
    in ``dropped``, and in nothing else."""

    def __init__(self, names: list[str], cols: list[Column], y: str, r: np.ndarray, n: int):
        told = qr.Solution(r, n, len(names))
        self.names, self.cols = ([x[i] for i in told.kept] for x in (names, cols))
        self.dropped = [x for i, x in enumerate(names) if i not in told.kept]
        self.y, self.n = y, n
        self.beta, self.inverse, self.ssr = told.beta, told.inverse, told.ssr
        self.xx = r[:, told.kept].T @ r[:, told.kept]
        self.condition = told.condition()
        mean = r[:, 0] * (r[:, 0] @ r[:, -1]) / (r[:, 0] @ r[:, 0])  # the intercept comes first
        self.tss = float(np.sum((r[:, -1] - mean) ** 2))

    @property
    def k(self) -> int:
        return len(self.beta)

    @property
    def dof(self) -> int:
        return self.n - self.k

    def summary(self) -> dict[str, float]:
        r2 = 1 - self.ssr / self.tss
        like = -self.n / 2 * (math.log(2 * math.pi) + math.log(self.ssr / self.n) + 1)
        rank = self.n - self.dof
        return {
            "nobs": self.n, "r_squared": r2, "adjusted_r_squared": 1 - (1 - r2) * (self.n - 1) / self.dof,
            "aic": -2 * like + 2 * rank, "bic": -2 * like + rank * math.log(self.n),
        }

    def with_rows(self, df: DataFrame) -> DataFrame:
        """Rows with residual and leverage, as expressions."""
        fitted = sum((float(b) * c for b, c in zip(self.beta[1:], self.cols[1:], strict=True)), float(self.beta[0]) * self.cols[0])
        lever = sum((float(self.inverse[i, j]) * self.cols[i] * self.cols[j] for i in range(self.k) for j in range(self.k)), F.lit(0.0))
        return df.withColumn("residual", F.col(self.y).cast("double") - fitted).withColumn("leverage", lever)

    def _sandwich(self, middle: np.ndarray) -> np.ndarray:
        return self.inverse @ middle @ self.inverse

    def _products(self, df: DataFrame, weight: Column, cols: list[Column]) -> np.ndarray:
        pairs = [(i, j) for i in range(self.k) for j in range(i, self.k)]
        row = df.agg(*(F.sum(cols[i] * cols[j] * weight) for i, j in pairs)).first()
        out = np.zeros((self.k, self.k))
        for (i, j), s in zip(pairs, row, strict=True):
            out[i, j] = out[j, i] = s
        return out

    def plain(self) -> np.ndarray:
        return self.inverse * self.ssr / self.dof

    def hc3(self, df: DataFrame) -> np.ndarray:
        e, h = F.col("residual"), F.col("leverage")
        names = [f"__x{i}" for i in range(self.k)]
        # Kept as columns, or every sum would hold the whole expression of the leverage.
        rows = self.with_rows(df).select(*(c.alias(n) for c, n in zip(self.cols, names, strict=True)), (e * e / ((1 - h) * (1 - h))).alias("__w")).persist()
        middle = self._products(rows, F.col("__w"), [F.col(n) for n in names])
        rows.unpersist()
        return self._sandwich(middle)

    def hac(self, df: DataFrame, lags: int, order: str) -> np.ndarray:
        """Bartlett weights over ``lags`` rows in order, without a small-sample correction."""
        rows = self.with_rows(df)
        names = [f"__u{i}" for i in range(self.k)]
        rows = rows.select(order, *((c * F.col("residual")).alias(n) for c, n in zip(self.cols, names, strict=True)))

        # The lags of a row enter a sum with their weights, so one column stands for all of them: the middle
        # is the sum of u (u/2 + weighted lags)' and its transpose.
        def behind(w: WindowSpec) -> dict[str, Column]:
            return {f"{n}_b": sum(((1 - lag / (lags + 1)) * F.coalesce(F.lag(n, lag).over(w), F.lit(0.0)) for lag in range(1, lags + 1)), F.col(n) / 2) for n in names}

        lagged = Ordered(rows, order).window(lags, behind)
        pairs = [(i, j) for i in range(self.k) for j in range(self.k)]
        row = lagged.agg(*(F.sum(F.col(names[i]) * F.col(f"{names[j]}_b")) for i, j in pairs)).first()
        half = np.array(row, float).reshape(self.k, self.k)
        return self._sandwich(half + half.T)

    def table(self, covariance: np.ndarray) -> list[tuple]:
        """(term, coefficient, std_error, statistic, p_value, ci_lower, ci_upper)"""
        wide = dist.t_quantile(0.05, self.dof)
        out = []
        for name, b, v in zip(self.names, self.beta, np.diag(covariance), strict=True):
            se = math.sqrt(max(v, 0.0))
            b = float(b)
            t = b / se if se else math.nan
            out.append((name, b, se, t, dist.t_two_sided(t, self.dof), b - wide * se, b + wide * se))
        return out

    def wald(self, covariance: np.ndarray, terms: tuple[str, ...]) -> tuple[float, float, int]:
        """F statistic, p-value and number of restrictions that the named terms are all zero."""
        at = [self.names.index(t) for t in terms]
        b, v = self.beta[at], covariance[np.ix_(at, at)]
        f = float(b @ np.linalg.solve(v, b)) / len(at)
        return f, dist.f_upper(f, len(at), self.dof), len(at)

    def standardised(self, df: DataFrame) -> dict[str, float]:
        """Coefficients in standard deviations of term and outcome; the intercept has none."""
        row = df.agg(F.stddev_samp(F.col(self.y).cast("double")), *(F.stddev_samp(c) for c in self.cols[1:])).first()
        return {name: float(b) * s / row[0] if row[0] else math.nan for name, b, s in zip(self.names[1:], self.beta[1:], row[1:], strict=True)}

    def anova(self, blocks: dict[str, tuple[str, ...]] | None = None) -> list[tuple[str, float, int, float, float]]:
        """(term, sum of squares, degrees of freedom, F, p) of each term, or block of terms, given all others."""
        out = []
        for name, terms in (blocks or {t: (t,) for t in self.names[1:]}).items():
            tested = tuple(t for t in terms if t in self.names)
            f, p, k = self.wald(self.plain(), tested) if tested else (math.nan, math.nan, 0)
            out.append((name, f * k * self.ssr / self.dof, k, f, p))
        return out

    def vif(self) -> dict[str, float]:
        """1 / (1 - R^2) of each term on the others, from the centred cross products; NaN if singular."""
        mean = self.xx[0] / self.n
        centred = self.xx[1:, 1:] - self.n * np.outer(mean[1:], mean[1:])
        try:
            inverse = np.linalg.inv(centred)
        except np.linalg.LinAlgError:
            return dict.fromkeys(self.names[1:], math.nan)
        return dict(zip(self.names[1:], (np.diag(inverse) * np.diag(centred)).tolist(), strict=True))

    def cook(self, df: DataFrame) -> DataFrame:
        """Rows with Cook's distance."""
        s2 = self.ssr / self.dof
        e, h = F.col("residual"), F.col("leverage")
        return self.with_rows(df).withColumn("cook", e * e * h / (self.k * s2 * (1 - h) * (1 - h)))

    def influence(self, df: DataFrame) -> dict[str, float]:
        row = self.cook(df).agg(F.max("cook"), F.count_if(F.col("cook") > 4 / self.n)).first()
        return {"max_cook": row[0], "influential": row[1]}

    def diagnostics(self, df: DataFrame, order: str) -> dict[str, float]:
        rows = self.with_rows(df)
        # Only residuals in order are needed for the lag.
        step = Ordered(rows.select(F.col(order).alias("__order"), "residual"), "__order").window(1, lambda w: {"__before": F.lag("residual").over(w)})
        e = F.col("residual")
        r = step.agg(F.sum(e * e), F.sum((e - F.col("__before")) ** 2), F.avg(e), F.avg(e**2), F.avg(e**3), F.avg(e**4)).first()
        m1, m2, m3, m4 = r[2], r[3], r[4], r[5]
        var = m2 - m1 * m1
        skew = (m3 - 3 * m1 * m2 + 2 * m1**3) / var**1.5
        kurtosis = (m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * m1**4) / var**2
        jb = self.n / 6 * (skew**2 + (kurtosis - 3) ** 2 / 4)
        squares = rows.withColumn("__e2", e * e)
        aux = fit(squares, (self.names, self.cols), "__e2")
        bp = self.n * (1 - aux.ssr / aux.tss)
        return {
            "rmse": math.sqrt(self.ssr / self.n), "durbin_watson": r[1] / r[0], "jarque_bera": jb, "jarque_bera_p": dist.chi2_upper(jb, 2), "skew": skew, "kurtosis": kurtosis,
            "breusch_pagan": bp, "breusch_pagan_p": dist.chi2_upper(bp, self.n - self.dof - 1), "condition_number": self.condition,
        }


def fit(df: DataFrame, terms: tuple[list[str], list[Column]], y: str) -> Fit:
    names, cols = terms
    return Fit(names, cols, y, *qr.factor(df, cols, F.col(y)))


def hierarchy(df: DataFrame, baseline: tuple[str, ...], blocks: list[tuple[str, tuple[str, ...]]], factor: str | None, y: str, horizon: int, order: str) -> list[dict]:
    """Nested models, each with one block more, from one pass: the leading columns of the widest model's factor are
    the others'. Covariance is HC3 for one session and HAC for longer horizons."""
    every = baseline + tuple(t for _, b in blocks for t in b)
    names, cols = design(df, every, factor)
    r, n = qr.factor(df, cols, F.col(y))
    out, taken, last = [], len(names) - len(every) + len(baseline), None
    for name, terms in [("baseline", ()), *blocks]:
        taken += len(terms)
        f = Fit(names[:taken], cols[:taken], y, np.column_stack((r[:, :taken], r[:, -1])), n)
        v = f.hc3(df) if horizon == 1 else f.hac(df, horizon, order)
        row = {"model": name, **f.summary(), "coefficients": f.table(v)}
        if tested := tuple(t for t in terms if t in f.names):
            row |= dict(zip(("block_f", "block_p", "block_df"), f.wald(v, tested), strict=True))
        if last:
            row |= {f"delta_{m}": row[m] - last[m] for m in ("adjusted_r_squared", "aic", "bic")}
        out.append(row)
        last = row
    return out
