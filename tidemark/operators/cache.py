"""Incremental extraction: what a cache holds is used again, the rest is computed, errors are caught by row."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stance import SCHEMA_VERSION, audit, extract, ungrounded, EXTRACTION_TYPE
from ..sources.files import CACHE_KEY, latest

REUSABLE = ("success", "invalid_evidence")


def keyed(docs: DataFrame, provider: str, model: str, prompt_version: str) -> DataFrame:
    return docs.select(
        "document_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("source_sha256"), F.lit(provider).alias("provider"), F.lit(model).alias("model_id"),
        F.lit(prompt_version).alias("prompt_version"),
    )


def probe(work: DataFrame, cache: DataFrame, schema_version: str = SCHEMA_VERSION) -> DataFrame:
    """Work with ``reused``: its latest record has the same key and schema version and a status to keep."""
    usable = latest(cache).where((F.col("schema_version") == schema_version) & F.col("status").isin(*REUSABLE)).select(*CACHE_KEY, F.lit(True).alias("__hit"))
    return work.join(usable, list(CACHE_KEY), "left").withColumn("reused", F.coalesce("__hit", F.lit(False))).drop("__hit")


def offline(work: DataFrame) -> DataFrame:
    """Extractions by rule, as expressions: result, audit codes and quotes that the source doesn't hold."""
    out = work.withColumn("result", extract(F.col("text")))
    loose = ungrounded(F.col("result")["supporting_evidence"], F.col("text"))
    return out.withColumn("unsupported_evidence", F.coalesce(loose, F.array().cast("array<string>"))).withColumn("schema_errors", audit(F.to_json("result", {"ignoreNullFields": "false"}))).withColumn(
        "status", _status(F.col("schema_errors"), F.col("unsupported_evidence"))
    )


def _status(errors: Column, loose: Column) -> Column:
    return F.when(F.size(errors) > 0, "error").when(F.size(loose) > 0, "invalid_evidence").otherwise("success")


def by_provider(work: DataFrame, call: Callable[[str], dict], attempts: int = 3, pause: float = 0.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Extractions by an injected provider. A call that fails is tried anew with doubling waits of at most
    30 seconds; a row that fails for good becomes an error row, never a failed task."""
    schema = "document_id string, source_sha256 string, provider string, model_id string, prompt_version string, text string, payload string, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            payloads, errors = [], []
            for t in df["text"]:
                payload, error = None, None
                for k in range(attempts):
                    try:
                        payload, error = json.dumps(call(t)), None
                        break
                    except Exception as e:  # noqa: BLE001 - any failure of a provider belongs to its row
                        error = f"{type(e).__name__}: {e}"
                        if k + 1 < attempts:
                            sleep(min(30.0, 5.0 * 2**k))
                payloads.append(payload)
                errors.append(error)
                if pause:
                    sleep(pause)
            yield df.assign(payload=payloads, error=errors)[[c.split()[0] for c in schema.split(", ")]]

    cols = ["document_id", "source_sha256", "provider", "model_id", "prompt_version", "text"]
    raw = work.select(*cols).mapInPandas(run, schema)
    parsed = raw.withColumn("schema_errors", F.when(F.col("payload").isNotNull(), audit(F.col("payload"))).otherwise(F.array(F.lit("provider_failed"))))
    sound = F.size("schema_errors") == 0
    parsed = parsed.withColumn("result", F.when(sound, F.from_json("payload", EXTRACTION_TYPE)))
    loose = F.coalesce(ungrounded(F.col("result")["supporting_evidence"], F.col("text")), F.array().cast("array<string>"))
    return parsed.withColumn("unsupported_evidence", loose).withColumn("status", _status(F.col("schema_errors"), F.col("unsupported_evidence"))).drop("payload")


def merged(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """The cache with new records added; nothing that is there is lost when a run ends early."""
    return cache.unionByName(fresh, allowMissingColumns=True)
