"""Model backends as Arrow UDFs: anything that turns token ids into logits can be plugged in."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identity import require_pair
from ..functions.probs import first_largest, softmax
from ..functions.text import token_windows
from .aggregate import by_paragraph, weighted


class Tokenizer(Protocol):
    """``name`` is the checkpoint, which must be the model's."""

    name: str

    def __call__(self, text: str) -> list[int]: ...


def tokens_udf(make: Callable[[], Tokenizer], model: str):
    """Text to ids by a tokenizer of the model's own checkpoint; null and empty texts have none."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = make()
        require_pair(tokenizer.name, model)
        for texts in parts:
            yield texts.map(lambda t: list(tokenizer(t)) if t else [])

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<int>")


class LogitBackend(Protocol):
    labels: tuple[str, ...]

    def __call__(self, ids: list[list[int]]) -> list[list[float]]: ...


class HashedLogits:
    """A deterministic stand-in for a model, with the same contract."""

    def __init__(self, labels: tuple[str, ...]):
        self.labels = labels

    def __call__(self, ids: list[list[int]]) -> list[list[float]]:
        return [[(zlib.crc32(f"{k}:{sum(x)}:{len(x)}".encode()) % 2000) / 1000 - 1 for k in self.labels] for x in ids]


def check_labels(backend: LogitBackend, expected: tuple[str, ...]) -> None:
    if set(backend.labels) != set(expected):
        raise ValueError(f"the model's labels are {sorted(backend.labels)}, not {sorted(expected)}")


def logits_udf(make: Callable[[], LogitBackend], batch: int = 8):
    """``make`` is called once a task; a batch that fails gives null logits, so its rows become error rows."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for ids in parts:
            rows: list[list[float] | None] = []
            for at in range(0, len(ids), batch):
                own = [list(map(int, x)) for x in ids.iloc[at : at + batch]]
                try:
                    rows += model(own)
                except Exception:  # noqa: BLE001 - rows are tried one by one so that only the bad ones fail
                    for x in own:
                        try:
                            rows += model([x])
                        except Exception:  # noqa: BLE001
                            rows.append(None)
            yield pd.Series(rows)

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<double>")


AGGREGATIONS = ("document_length_weighted", "document_mean", "paragraph_mean")


def classify(
    docs: DataFrame, key: str, tokens: str, make: Callable[[], LogitBackend], labels: tuple[str, ...], max_length: int = 512, stride: int = 64, aggregation: str = AGGREGATIONS[0], paragraph: str | None = None,
) -> DataFrame:
    """Windows of every document through the model; error rows stay. Windows weigh as many tokens as they hold, or
    the same, or make up paragraphs (rows of ``docs`` with the same key, told apart by ``paragraph``) that weigh
    the same."""
    if aggregation not in AGGREGATIONS or (aggregation == "paragraph_mean") != (paragraph is not None):
        raise ValueError(f"no such aggregation: {aggregation}")
    unit = (paragraph,) if paragraph else ()
    chunks = docs.select(key, *unit, F.explode_outer(token_windows(F.col(tokens), max_length, stride)).alias("ids"))
    # Nondeterministic keeps the optimiser from calling the model twice for one row.
    raw = chunks.withColumn("logits", logits_udf(make).asNondeterministic()(F.coalesce("ids", F.array().cast("array<int>"))))
    scored = raw.withColumn("p", softmax(F.col("logits")))
    good = scored.where("ids is not null and p is not null").withColumn("n", F.size("ids"))
    if paragraph:
        mean = by_paragraph(good, key, paragraph, "p", len(labels), "n")
    else:
        mean = weighted(good, (key,), "p", len(labels), "n" if aggregation == AGGREGATIONS[0] else None)
        if aggregation == "document_mean":
            mean = mean.drop("token_count").join(good.groupBy(key).agg(F.sum("n").alias("token_count")), key)
    failed = scored.groupBy(key).agg(F.count_if(F.col("ids").isNull() | F.col("p").isNull()).alias("failed"))
    out = failed.join(mean, key, "left")
    status = F.when(F.col("failed") > 0, "error").otherwise("success")
    return out.select(key, status.alias("status"), F.when(status == "success", F.col("probabilities")).alias("probabilities"), F.when(status == "success", first_largest(F.col("probabilities"), labels)).alias("label"), "chunk_count", "token_count")
