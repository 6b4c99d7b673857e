"""Incremental synchronisation as a stream: files of API rows are merged batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from skein.operators.ingest import sync_threads, threads_from_api
from skein.sources.shared import written
from skein.sources.store import Store


def merge_batch(store: Store, repo_id: int, pulled_at: Callable[[int], str]) -> Callable[[DataFrame, int], None]:
    """Merges a micro-batch of (raw) into the store's threads: of several versions of a thread the last counts, by
    updated_at, then by place in the batch."""

    def merge(batch: DataFrame, number: int) -> None:
        new = written(threads_from_api(batch, repo_id, pulled_at(number), order=F.monotonically_increasing_id()), "batch")
        store.commit({"threads": sync_threads(store.table("threads"), new)})

    return merge


def stream_threads(spark: SparkSession, folder: str, store: Store, repo_id: int, checkpoint: str, pulled_at: Callable[[int], str]) -> StreamingQuery:
    """Follows a folder of text files with one JSON row a line, and stops when all are taken."""
    rows = spark.readStream.schema("value string").text(folder).withColumnRenamed("value", "raw")
    return rows.writeStream.foreachBatch(merge_batch(store, repo_id, pulled_at)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def kind_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Rows by kind and window of a stream (or table) of events, late rows within the watermark counted."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, window).alias("w"), F.col(kind).alias("kind")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "kind", "n")
