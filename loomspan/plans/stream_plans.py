"""Queries that run streams over the events table to their end, against what SQL makes of the whole table.

The table is written once as files, with a last row far in the future, so that the watermark passes every timer.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.snapshots import Store
from ..sources import scratch
from ..streaming import sinks, stateful
from .base import ledger, query, t

FAR = "timestamp'2200-01-01'"


def _stream(spark: SparkSession, rows: DataFrame) -> DataFrame:
    folder = scratch.folder(spark, "source")
    rows.write.parquet(folder)
    return spark.readStream.schema(rows.schema).parquet(folder)


def _run(spark: SparkSession, stream: DataFrame) -> DataFrame:
    out, check = scratch.folder(spark, "out"), scratch.folder(spark, "check")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query(
    "prompt_stream",
    "WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS number FROM events WHERE event_type = 'view') "
    "SELECT user_id AS session_id, 'prompt' AS kind, number, event_id FROM n UNION ALL SELECT user_id, 'turn', number, NULL FROM n",
)
def prompt_stream(spark, sf):
    """Views as the prompts of a user's session: numbered, and each turn queued once when it is over."""
    rows = t(spark, sf, "events").where("event_type = 'view'").select(F.col("user_id").alias("session_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.lit(None).cast("bigint").alias("number"))
    last = spark.range(1).select(F.lit(-1).cast("bigint").alias("session_id"), F.lit(-1).cast("bigint").alias("event_id"), F.expr(FAR).alias("ts"), F.lit(None).cast("bigint").alias("number"))
    made = stateful.prompts(_stream(stateful.prepared(spark), rows.unionByName(last)).withWatermark("ts", "0 seconds"))
    return _run(spark, made).where("session_id >= 0")


MOST = 4


def _handled(payload: str, attempt: int) -> str:
    """Errors never go through; signups do at the third attempt; all else at once."""
    if payload == "error" or (payload == "signup" and attempt < 3):
        raise ValueError(f"{payload} refused at attempt {attempt}")
    return f"{payload} at attempt {attempt}"


@query(
    "queue_stream",
    f"SELECT event_id AS id, CASE event_type WHEN 'error' THEN 'dead' ELSE 'done' END AS state, CAST(CASE event_type WHEN 'error' THEN {MOST} WHEN 'signup' THEN 3 ELSE 1 END AS INTEGER) AS attempts, "
    "CASE event_type WHEN 'error' THEN NULL WHEN 'signup' THEN 'signup at attempt 3' ELSE event_type || ' at attempt 1' END AS result, "
    f"CASE event_type WHEN 'error' THEN 'error refused at attempt {MOST}' END AS error FROM events",
)
def queue_stream(spark, sf):
    """Events as the items of a work queue with retries and dead letters; every item comes twice."""
    rows = t(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("payload"), F.col("ts").cast("timestamp").alias("ts"))
    last = spark.range(1).select(F.lit(-1).cast("bigint").alias("id"), F.lit("last").alias("payload"), F.expr(FAR).alias("ts"))
    made = stateful.worked(_stream(stateful.prepared(spark), rows.unionByName(rows).unionByName(last)).withWatermark("ts", "0 seconds"), _handled, MOST, dt.timedelta(hours=1))
    return _run(spark, made).where("id >= 0")


@query("savings_stream", "SELECT bucket, CAST(sum(baseline) AS BIGINT) AS baseline, CAST(sum(served) AS BIGINT) AS served, count(*) AS calls FROM ledger WHERE bucket <> 'unknown' GROUP BY 1", ("ledger",))
def savings_stream(spark, sf):
    """The ledger as a stream of several micro-batches into a store of totals."""
    rows = ledger(spark, sf).select("bucket", "baseline", "served").repartition(3, "baseline")
    folder, store = scratch.folder(spark, "ledger"), scratch.folder(spark, "totals")
    rows.write.parquet(folder)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    sinks.rolled_up(stream, store, scratch.folder(spark, "check")).awaitTermination()
    return sinks.totals(Store(spark, store), "bucket string, baseline long, served long, calls long", ["bucket"])
