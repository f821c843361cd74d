"""Binding of values in column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once for a row, though the body's lambdas name it often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
