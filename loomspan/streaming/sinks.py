"""Exactly-once sinks: a micro-batch's rows and its number are published in one version of a store.

``snapshots.Store`` names the data and the last batch of each stream in one file, so a batch that is delivered again, after
a failure at whatever step, finds its number there and changes nothing; another writer's version makes it read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.snapshots import Conflict, Snapshot, Store, bucket_of
from ..operators.tables import insert_or_ignore, upsert
from .events import savings

#: So many parts of a rollup are read side by side before they are put together.
PARTS = 16


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)


def _published(db: Store, name: str, batch: int, change: Callable[[Snapshot], tuple[dict, dict]], tries: int = 5) -> bool:
    """Publishes replace and append parts of ``change`` for a batch of the stream ``name``; false if it was there."""
    for k in range(tries):
        now = db.snapshot()
        if now.facts.get(f"batch of {name}", -1) >= batch:
            return False
        replace, append = change(now)
        try:
            db.publish(now, replace, append, {f"batch of {name}": batch})
            return True
        except Conflict:
            if k == tries - 1:
                raise
    return False


def write_totals(db: Store, totals: DataFrame, batch: int, keys: list[str], name: str = "rollup") -> bool:
    """Takes the totals of a batch (keys and sums as of then): only what the batch changed is written."""
    own = totals.withColumn("batch", F.lit(batch).cast("bigint"))

    def change(now: Snapshot) -> tuple[dict, dict]:
        if len(now.folders(name)) < PARTS:
            return {}, {name: db.write(name, own.coalesce(1))}
        whole = db.read(now, name, _ddl(own)).unionByName(own)
        return {name: (None, db.write(name, _last(whole, keys).coalesce(1)))}, {}

    return _published(db, name, batch, change)


def _last(rows: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("x")).select(*keys, "x.*")


def totals(db: Store, schema: str, keys: list[str], name: str = "rollup", version: int | None = None) -> DataFrame:
    """The totals of a rollup: of each key those of the last batch that changed it."""
    return _last(db.read(db.snapshot(version), name, f"{schema}, batch long"), keys).drop("batch")


def rolled_up(events: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Keeps the savings by canonical bucket (``events.savings``) in a store; state and sink are both by bucket."""
    db = Store(events.sparkSession, store)

    def write(batch: DataFrame, number: int) -> None:
        write_totals(db, batch, number, ["bucket"])

    return savings(events).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_rows(db: Store, table: str, rows: DataFrame, batch: int, keys: list[str], order: str | None = None, ignore: bool = False, buckets: int = 64) -> bool:
    """Takes the rows of a batch into a keyed table: later rows win, or with ``ignore`` earlier ones. Only touched buckets are written."""
    by = lambda n: bucket_of(F.struct(*keys), n)

    def change(now: Snapshot) -> tuple[dict, dict]:
        n = now.facts.get(f"buckets of {table}", buckets)
        touched = sorted(r[0] for r in rows.select(by(n).alias("b")).distinct().collect())  # as many as there are buckets at most
        old = db.read(now, table, _ddl(rows), touched)
        merged = old.unionByName(insert_or_ignore(old, rows, keys)) if ignore else upsert(old, rows, keys, order)
        return {table: (touched, db.write(table, merged, by(n)))}, {}

    return _published(db, table, batch, change)


def into_store(stream: DataFrame, store: str, table: str, keys: list[str], checkpoint: str, order: str | None = None, ignore: bool = False, each: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Writes micro-batches into a keyed table of a store, each batch once."""
    db = Store(stream.sparkSession, store)

    def write(batch: DataFrame, number: int) -> None:
        write_rows(db, table, each(batch), number, keys, order, ignore)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
