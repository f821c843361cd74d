"""Streaming forms: windowed counts with a watermark, and the extraction cache fed batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def daily(events: DataFrame, time: str = "ts", late: str = "2 days") -> DataFrame:
    """Events a day and type; on a stream a day is final once the watermark has passed it."""
    events = events.withColumn(time, F.col(time).cast("timestamp"))
    source = events.withWatermark(time, late) if events.isStreaming else events
    out = source.groupBy(F.window(time, "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.to_date("w.start").alias("day"), "event_type", "n")


def drain(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Runs a stream over all there is, handing each micro-batch to ``write``."""
    query = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return query


def extract_new(work: DataFrame, cache_path: str, compute: Callable[[DataFrame], DataFrame], probe: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Adds records to a cache for documents that it does not hold yet; a batch is added whole or not at all."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        held = spark.read.parquet(cache_path)
        todo = probe(batch, held).where("not reused").drop("reused")
        compute(todo).select(*held.columns).write.mode("append").parquet(cache_path)

    return drain(work, write, checkpoint, "append")
