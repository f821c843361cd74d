"""The extraction cache as a stream with state: one answer for each key, retries by timers, restarts without repeats.

A request asks for a document's extraction. Its key (document and hash of its text) has a state: done, waiting for a
retry, or failed. What is done is told as reused; what waits is not asked for twice; what has no state is sent to the
provider. A call that fails registers a timer, later each time up to a cap; when the watermark passes it the call is made
again, and after the last attempt the key has failed and its error is a row. A later request for a failed key begins anew.

Times are those of the requests, so a run is the same however fast it is. State and timers are in the checkpoint: a query that is
started again on it goes on where it was, and rows that a sink has committed don't come again.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

KEY = ("document_id", "source_sha256")
REQUESTS = "document_id string, source_sha256 string, text string, asked_at timestamp"
ANSWERS = "document_id string, source_sha256 string, outcome string, attempts int, payload string, error string"
_STATE = "status string, attempts int, text string"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Extraction(StatefulProcessor):
    """One key's requests and timers. ``call`` gets a text and the number of the attempt and returns what JSON can hold;
    any failure is the row's."""

    def __init__(self, call: Callable[[str | None, int], object], attempts: int = 3, wait: int = 300, longest: int = 3600):
        self.call, self.most, self.wait, self.longest = call, attempts, wait, longest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("request", _STATE)

    def _row(self, key: Any, outcome: str, attempts: int, payload: str | None = None, error: str | None = None) -> pd.DataFrame:
        return pd.DataFrame([(*key, outcome, attempts, payload, error)], columns=[c.split()[0] for c in ANSWERS.split(", ")])

    def _try(self, key: Any, text: str | None, before: int, now: int) -> Iterator[pd.DataFrame]:
        try:
            payload = json.dumps(self.call(text, before + 1), ensure_ascii=False, sort_keys=True)
        except Exception as e:  # noqa: BLE001 - any failure of a provider belongs to its row
            if before + 1 >= self.most:
                self.state.update(("failed", before + 1, None))
                yield self._row(key, "error", before + 1, error=f"{type(e).__name__}: {e}")
            else:
                self.state.update(("waiting", before + 1, text))
                self.handle.registerTimer(now + 1000 * min(self.longest, self.wait * 2**before))
            return
        self.state.update(("done", before + 1, None))
        yield self._row(key, "success", before + 1, payload)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for batch in rows:
            for text, asked in zip(batch["text"], batch["asked_at"], strict=True):
                status, attempts, _ = self.state.get() if self.state.exists() else (None, 0, None)
                if status == "done":
                    yield self._row(key, "reused", attempts)
                elif status != "waiting":
                    yield from self._try(key, None if pd.isna(text) else text, 0, int(pd.Timestamp(asked).timestamp() * 1000))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        status, attempts, text = self.state.get() if self.state.exists() else (None, 0, None)
        if status == "waiting":
            yield from self._try(key, text, attempts, expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the requests in a folder's Parquet files."""
    return spark.readStream.schema(REQUESTS).parquet(folder)


def answers(asked: DataFrame, call: Callable[[str | None, int], object], attempts: int = 3, wait: int = 300, late: str = "0 seconds") -> DataFrame:
    """ANSWERS for a stream of requests; timers wait for the watermark, ``late`` behind the latest request."""
    asked.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    keyed = asked.withWatermark("asked_at", late).groupBy(*KEY)
    return keyed.transformWithStateInPandas(Extraction(call, attempts, wait), ANSWERS, outputMode="append", timeMode="eventTime")


def run(asked: DataFrame, out: str, checkpoint: str, call: Callable[[str | None, int], object], attempts: int = 3, wait: int = 300) -> None:
    """Answers all requests that are there, into a folder of Parquet files; each row once, whatever is started again."""
    found = answers(asked, call, attempts, wait)
    query = found.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    query.awaitTermination()


def asked(docs: DataFrame, at: str) -> DataFrame:
    """Requests for documents (document_id, text) at one time."""
    return docs.select(F.col("document_id").cast("string"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("source_sha256"), "text", F.lit(at).cast("timestamp").alias("asked_at"))


def tick(spark: SparkSession, at: str) -> DataFrame:
    """A request that no document makes, which moves the watermark on."""
    return asked(spark.createDataFrame([("", "")], "document_id string, text string"), at)
