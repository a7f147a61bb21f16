"""Streams of file changes, lifecycle events and savings, as Structured Streaming queries.

Sources are any streaming DataFrames; sinks are tables written by ``foreachBatch`` with keyed, repeatable upserts.
Event times have to be TIMESTAMP; ``on_time`` casts and sets the watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import BUCKETS
from ..operators.tables import insert_or_ignore, replace_table, upsert


def on_time(events: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def debounced(changes: DataFrame, gap: str = "500 milliseconds", by: str = "root") -> DataFrame:
    """Distinct paths of each burst: events of a root closer than the gap. Works on streams and tables.

    A move counts for both of its paths (path, moved_to).
    """
    paths = F.explode(F.array_compact(F.array("path", "moved_to"))) if "moved_to" in changes.columns else F.col("path")
    own = changes.select(by, "ts", paths.alias("path"))
    return own.groupBy(F.session_window("ts", gap).alias("burst"), by).agg(F.sort_array(F.collect_set("path")).alias("paths"), F.count("*").alias("n_events"))


def distinct_events(events: DataFrame, keys: list[str]) -> DataFrame:
    """Each event once, however often it is delivered within the watermark."""
    return events.dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def savings(events: DataFrame) -> DataFrame:
    """Running totals by canonical bucket, for update or complete mode."""
    return events.where(F.col("bucket").isin(*BUCKETS)).groupBy("bucket").agg(F.sum("baseline").alias("baseline"), F.sum("served").alias("served"), F.count("*").alias("calls"))


def numbered(events: DataFrame) -> DataFrame:
    """(session_id, event_id, prompt_number): prompts of a session numbered as they arrive; state is one counter."""

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        for batch in batches:
            own = batch.sort_values("event_id")
            yield pd.DataFrame({"session_id": key[0], "event_id": own["event_id"].to_numpy(), "prompt_number": range(n + 1, n + 1 + len(own))})
            n += len(own)
        state.update((n,))

    return events.groupBy("session_id").applyInPandasWithState(run, "session_id string, event_id long, prompt_number long", "n long", "append", "NoTimeout")


def into_table(stream: DataFrame, path: str, keys: list[str], checkpoint: str, order: str | None = None, ignore: bool = False, each: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Writes micro-batches into a keyed table: later rows win, or with ``ignore`` earlier ones.

    A batch that is delivered again changes nothing, since its keys are there already.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        own = each(batch)
        try:
            old = spark.read.parquet(path)
        except Exception as missing:  # noqa: BLE001  the first batch
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            old = spark.createDataFrame([], own.schema)
        merged = old.unionByName(insert_or_ignore(old, own, keys)) if ignore else upsert(old, own, keys, order)
        replace_table(merged, path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def backfilled(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """Sessions with a row for every session that only events know, started at its first event."""
    seen = events.groupBy("session_id").agg(F.min("ts").alias("started"))
    return sessions.unionByName(seen.join(sessions.select("session_id"), "session_id", "left_anti"), allowMissingColumns=True)


def drained(queue: DataFrame, limit: int = 5) -> DataFrame:
    """The oldest waiting items of a queue (id, enqueued, attempts)."""
    return queue.orderBy("enqueued", "id").limit(limit)


def failed(items: DataFrame, error: str) -> DataFrame:
    """Items after a failed try."""
    return items.withColumn("attempts", F.col("attempts") + 1).withColumn("last_error", F.lit(error[:500]))
