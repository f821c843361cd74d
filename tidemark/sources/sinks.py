"""Sinks: distributed tables by Spark's commit protocol, small reports by write and rename."""

from __future__ import annotations

import json
import math
import os
import tempfile

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(df: DataFrame, path: str, form: str = "parquet", by: tuple[str, ...] = ()) -> None:
    """Parquet, CSV, JSON lines or text; partly written output is never seen under the final name."""
    writer = df.write.mode("overwrite")
    if by:
        writer = writer.partitionBy(*by)
    if form == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.format(form).save(path)


def records(df: DataFrame, path: str) -> None:
    """JSON lines whose keys are sorted, at the top and in structs; nulls are written."""
    df.select(*(F.col(f"`{c}`") for c in sorted(df.columns))).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def pair(first: tuple[str, str], second: tuple[str, str]) -> None:
    """Two small files (path, content), both written before either gets its name."""
    temps = []
    try:
        for path, content in (first, second):
            temps.append(_beside(path, content))
    except BaseException:
        for t in temps:
            os.unlink(t)
        raise
    for t, (path, _) in zip(temps, (first, second), strict=True):
        os.replace(t, path)


def model(fitted: PipelineModel, path: str, provenance: dict) -> None:
    """A fitted pipeline and, beside it, what it was made of."""
    fitted.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    spark.createDataFrame([(json.dumps(_plain(provenance), sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/provenance")


def _plain(x: object) -> object:
    if isinstance(x, float) and not math.isfinite(x):
        return None
    if isinstance(x, dict):
        return {str(k): _plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [_plain(v) for v in x]
    return x


def text(path: str, content: str) -> None:
    """A small file on the driver, written beside its place and renamed."""
    os.replace(_beside(path, content), path)


def _beside(path: str, content: str) -> str:
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    fd, temp = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            f.write(content)
    except BaseException:
        os.unlink(temp)
        raise
    return temp


def report(path: str, value: dict) -> None:
    """JSON with sorted keys; numbers that are not finite become null."""
    text(path, json.dumps(_plain(value), indent=2, sort_keys=True, default=str) + "\n")
