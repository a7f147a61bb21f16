"""Retention of memory tables in a store: expired rows move to archive tables, by months, in one version.

A table's buckets are the months of ``created`` (epoch seconds, UTC). A month that has expired as a whole moves by its name in the log
alone, nothing is read or written; only the month of the cutoff is divided. Table and archive change in the same version, so at
any time each row is in one of them, and a run with nothing to do publishes nothing.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .snapshots import Conflict, Snapshot, Store

#: Rows without a time are in a month of their own and never expire.
NO_MONTH = -1
DAY = 86_400


def month_of(created: Column) -> Column:
    """Months since the year 0, in UTC whatever the session's zone is."""
    at = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(created / DAY).cast("int"))
    return F.coalesce(F.year(at) * 12 + F.month(at) - 1, F.lit(NO_MONTH))


def _month(seconds: int) -> int:
    at = dt.datetime(1970, 1, 1) + dt.timedelta(seconds=seconds)
    return at.year * 12 + at.month - 1


def add(db: Store, table: str, rows: DataFrame, tries: int = 5) -> Snapshot:
    """Appends rows with a column ``created`` to a table; another writer's version in between is no hindrance."""
    parts = db.write(table, rows, month_of(F.col("created")))
    for k in range(tries):
        try:
            return db.publish(db.snapshot(), append={table: parts})
        except Conflict:
            if k == tries - 1:
                raise
    raise ValueError("tries has to be positive")


def archive_of(table: str) -> str:
    return f"archived {table}"


def prune(db: Store, schemas: dict[str, str], as_of: int, days: dict[str, int], archive: bool = True) -> dict[str, int]:
    """Moves rows older than each table's ``days`` to its archive, or drops them; returns how many rows went from each table."""
    now = db.snapshot()
    replace, append, counts = {}, {}, {}
    for table, n in days.items():
        cutoff = as_of - n * DAY
        edge = _month(cutoff)
        whole = [(m, p) for m, p in now.parts.get(table, ()) if m is not None and m != NO_MONTH and m < edge]
        gone = db.read(now, table, schemas[table], {m for m, _ in whole}).count() if whole else 0
        last = db.read(now, table, schemas[table], {edge})
        old = last.where(F.col("created") < cutoff)
        n_old = old.count()
        counts[table] = gone + n_old
        if not counts[table]:
            continue
        kept = db.write(table, last.where(F.col("created") >= cutoff), month_of(F.col("created"))) if n_old else []
        replace[table] = ({m for m, _ in whole} | ({edge} if n_old else set()), kept)
        if archive:
            moved = db.write(archive_of(table), old, month_of(F.col("created"))) if n_old else []
            append[archive_of(table)] = [*whole, *moved]
    if any(counts.values()):
        db.publish(now, replace, append, {"pruned as of": as_of})
    return counts


def scheduled(spark: SparkSession, job: Callable[[], object], every: str = "1 day", checkpoint: str | None = None) -> StreamingQuery:
    """Runs ``job`` once a trigger, as a stream of ticks that Spark restarts, shows and stops like any other."""
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    writer = ticks.writeStream.foreachBatch(lambda batch, number: job() and None).trigger(processingTime=every)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
