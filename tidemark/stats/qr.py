"""Least squares by an orthogonal factor: conditions stay as they are, where cross products square them.

Each task folds its rows, batch by batch, into the triangular factor R of its part of ``[X | y]``; factors are merged
``FAN`` at a time until ``FAN`` or fewer are left for the driver, each (k + 1) x (k + 1) numbers whatever the rows. A column that
the columns before it explain but for ``TOLERANCE`` of its length is dropped: it has no coefficient, and the rank says so.
The leading block of R is the factor of the leading columns, so nested models need no other pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import kept

FAN = 64
TOLERANCE = 1e-11

_FACTOR = "part long, n long, r binary"


def _fold(r: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The triangle of what R stood for and more rows; its diagonal is not negative, so that it is the same whatever the
    order of merging, but for rounding."""
    out = np.linalg.qr(np.vstack((r, rows)), mode="r")
    if len(out) < out.shape[1]:
        out = np.vstack((out, np.zeros((out.shape[1] - len(out), out.shape[1]))))
    return out * np.where(np.diag(out) < 0, -1.0, 1.0)[:, None]


def _factor(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r, n = np.zeros((width, width)), 0
        for b in batches:
            if b.num_rows:
                r, n = _fold(r, np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns])), n + b.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([n], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["part", "n", "r"])

    return run


def _merged(rows: list[bytes], width: int) -> np.ndarray:
    r = np.zeros((width, width))
    for own in rows:
        r = _fold(r, np.frombuffer(own, np.float64).reshape(width, width))
    return r


def _merge(width: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        r = _merged(table.column("r").to_pylist(), width)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([sum(table.column("n").to_pylist())], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})

    return run


def factor(df: DataFrame, cols: list[Column], y: Column) -> tuple[np.ndarray, int]:
    """R of ``[X | y]`` and the number of rows. Rows with a null, NaN or infinite value take no part."""
    width = len(cols) + 1
    rows = df.select(*(c.cast("double").alias(f"c{i}") for i, c in enumerate([*cols, y])))
    for i in range(width):
        c = F.col(f"c{i}")
        rows = rows.where(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    parts = kept(rows.mapInArrow(_factor(width), _FACTOR), "factors")
    while parts.count() > FAN:
        parts = kept(parts.groupBy(F.floor(F.col("part") / FAN).alias("to")).applyInArrow(_merge(width), _FACTOR), "factors")
    last = sorted(parts.collect())  # FAN at most
    return _merged([r["r"] for r in last], width), sum(r["n"] for r in last)


@dataclass
class Solution:
    """What a factor of ``[X | y]`` says about the first ``k`` columns."""

    r: np.ndarray
    n: int
    k: int
    kept: list[int] = field(init=False)
    beta: np.ndarray = field(init=False)
    inverse: np.ndarray = field(init=False)
    ssr: float = field(init=False)

    def __post_init__(self) -> None:
        x, y = self.r[:, : self.k], self.r[:, -1]
        self.kept = []
        basis: list[np.ndarray] = []
        for j in range(self.k):
            v = x[:, j].copy()
            for _ in range(2):  # once more, as rounding leaves something of the others
                for q in basis:
                    v -= (q @ v) * q
            size = np.linalg.norm(v)
            if size > TOLERANCE * np.linalg.norm(x[:, j]) and size > 0:
                basis.append(v / size)
                self.kept.append(j)
        q, t = np.linalg.qr(x[:, self.kept])
        self.beta = np.linalg.solve(t, q.T @ y) if self.kept else np.empty(0)
        back = np.linalg.solve(t, np.eye(len(self.kept))) if self.kept else np.empty((0, 0))
        self.inverse = back @ back.T
        self.ssr = float(np.sum((y - x[:, self.kept] @ self.beta) ** 2))

    @property
    def rank(self) -> int:
        return len(self.kept)

    def condition(self) -> float:
        """Of the kept columns; the largest by the smallest singular value."""
        values = np.linalg.svd(self.r[:, self.kept], compute_uv=False)
        return float(values[0] / values[-1])
