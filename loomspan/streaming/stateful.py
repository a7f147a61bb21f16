"""Streams with state of their own: prompts numbered with their turns queued, and a work queue with retries.

Both keep their state by ``applyInPandasWithState`` for groups of many keys, since a call of Python costs more than what is done for a key: the state of a
group comes to Python and goes back with the group's rows, with one timeout in event time a group, and results in append mode. Which items of the queue are
known is kept by Spark's own ``dropDuplicates``. State, timeouts and source offsets are committed together for a micro-batch, so a
batch that is run again after a failure gives the same rows and the same state. ``prepared`` puts the state into RocksDB.

Event time is the only clock: what is due is what the watermark has passed, so results do not depend on when a stream runs. Rows
later than the watermark are dropped by Spark before they get here.
"""

from __future__ import annotations

import datetime as dt
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Groups that sessions and items are dealt into. A group's state is read and written whole when one of its keys has a row or is due, so
#: many millions of sessions or waiting items want more. Part of the state: a stream that goes on needs the number that it started with.
GROUPS = 1024
NONE = (1 << 63) - 1  # stands for null, so that whole numbers stay whole in pandas


def prepared(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark


def _whole(number: Column) -> Column:
    return F.coalesce(number.cast("bigint"), F.lit(NONE))


def _added(known: list[list[int]], n: int) -> bool:
    """Puts n into sorted, disjoint ranges [first, last]; False if it is there."""
    i = bisect_right(known, [n, n])  # ranges before i start at n or earlier
    if i and known[i - 1][1] >= n or i < len(known) and known[i][0] == n:
        return False
    before, after = i > 0 and known[i - 1][1] == n - 1, i < len(known) and known[i][0] == n + 1
    if before and after:
        known[i - 1][1] = known.pop(i)[1]
    elif before:
        known[i - 1][1] = n
    elif after:
        known[i][0] = n
    else:
        known.insert(i, [n, n])
    return True


def _prompted(idle_ms: int):
    """State of a session: the greatest prompt number, the turns queued up to, its last prompt's time and the ranges of the numbers that there are."""

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now, out = state.getCurrentWatermarkMs(), []
        sessions = {own: (number, queued, seen, known) for own, number, queued, seen, known in (state.get[0] if state.exists else [])}
        if not state.hasTimedOut:
            rows = pd.concat(list(batches)).sort_values(["session_id", "at", "event"])  # a group's prompts of one micro-batch
            for session, own in groupby(zip(rows["session_id"], rows["at"], rows["event"], rows["number"]), key=lambda x: x[0]):
                number, queued, seen, known = sessions.get(session, (0, 0, 0, []))
                known = [list(x) for x in known]
                for _, at, event, given in own:
                    n = number + 1 if pd.isna(given) else int(given)
                    if _added(known, n):
                        out.append((session, "prompt", n, None if event == NONE else event))
                    if n - 1 > queued:  # the turn before is over
                        out += [(session, "turn", k, None) for k in range(queued + 1, n)]
                        queued = n - 1
                    number, seen = max(number, n), seen if at == NONE else max(seen, at // 1000)
                sessions[session] = number, queued, seen, known
        ends = []
        for session, (number, queued, seen, known) in sessions.items():
            if queued < number and seen + idle_ms <= now:
                out += [(session, "turn", k, None) for k in range(queued + 1, number + 1)]
                sessions[session] = number, number, seen, known
            elif queued < number:
                ends.append(seen + idle_ms)
        state.update(([(session, *own) for session, own in sessions.items()],))
        if ends:
            state.setTimeoutTimestamp(min(ends))
        yield pd.DataFrame(out, columns=["session_id", "kind", "number", "event_id"], dtype=object)  # numbers beside nulls stay whole

    return run


def prompts(events: DataFrame, idle: dt.timedelta = dt.timedelta(minutes=30), groups: int = GROUPS) -> DataFrame:
    """(session_id, kind, number, event_id): prompts with their numbers, and each turn once when it is over.

    events: session_id, event_id, ts with a watermark, number (null: the next one). A number that is there already gives no
    second prompt. A turn is over when a later prompt comes, or when the watermark passes the session's last prompt by ``idle``.
    Events without a session are refused. Prompts of a session are taken by time within a micro-batch, and micro-batches as they come.
    """
    kind = events.schema["session_id"].dataType.simpleString()
    own = events.where("session_id is not null").select(F.pmod(F.xxhash64("session_id"), F.lit(groups)).alias("group"), "session_id", "ts", "number", _whole(F.unix_micros("ts")).alias("at"), _whole(F.col("event_id")).alias("event"))
    return own.groupBy("group").applyInPandasWithState(
        _prompted(int(idle.total_seconds() * 1000)), f"session_id {kind}, kind string, number long, event_id long", f"sessions array<struct<session_id: {kind}, number: bigint, queued: bigint, seen: bigint, known: array<array<bigint>>>>", "append", "EventTimeTimeout"
    )


def prompts_of_table(events: DataFrame) -> DataFrame:
    """What ``prompts`` gives in the end, for a table whose numbers are all null."""
    from pyspark.sql import Window

    own = events.withColumn("number", F.row_number().over(Window.partitionBy("session_id").orderBy("ts", "event_id")).cast("bigint"))
    turns = own.select("session_id", F.lit("turn").alias("kind"), "number", F.lit(None).cast("bigint").alias("event_id"))
    return own.select("session_id", F.lit("prompt").alias("kind"), "number", "event_id").unionByName(turns)


def _firsts(own: pd.DataFrame) -> pd.DataFrame:
    """The earliest row of each item, of rows of one micro-batch."""
    if own["id"].is_unique:
        return own
    return own.assign(known=own["payload"].fillna("")).sort_values(["id", "at", "known"]).drop_duplicates("id").drop(columns="known")


def _queued(work: Callable[[str, int], str], most: int, backoff_ms: int):
    """State of a group: its items that wait for their next try. Every row that comes is a new item."""

    def tried(item, payload, attempts: int, due: int, now: int) -> tuple[tuple | None, tuple | None]:
        """What came of it, or the item as it waits."""
        while True:
            try:
                result = work(payload, attempts + 1)
            except Exception as error:  # noqa: BLE001  a failed item must not end the stream
                attempts += 1
                if attempts >= most:
                    return (item, "dead", attempts, None, str(error)[:500]), None
                due += backoff_ms << (attempts - 1)
                if due > now:
                    return None, (item, payload, attempts, due)
                continue  # the watermark has passed the next try already
            return (item, "done", attempts + 1, result, None), None

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now, waiting, out = state.getCurrentWatermarkMs(), [], []
        todo = []
        for item, payload, attempts, due in state.get[0] if state.exists else []:
            (todo if due <= now else waiting).append((item, payload, attempts, due))
        if not state.hasTimedOut:
            for part in batches:
                todo += [(item, payload, 0, 0 if at == NONE else at // 1000) for item, payload, at in zip(part["id"], part["payload"], part["at"])]
        for one in todo:
            made, waits = tried(*one, now)
            (waiting if made is None else out).append(waits if made is None else made)
        if waiting:
            state.update((waiting,))
            state.setTimeoutTimestamp(min(x[3] for x in waiting))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["id", "state", "attempts", "result", "error"], dtype=object)

    return run


def worked(items: DataFrame, work: Callable[[str, int], str], most: int = 5, backoff: dt.timedelta = dt.timedelta(seconds=10), groups: int = GROUPS) -> DataFrame:
    """(id, state, attempts, result, error): each item of a queue once, when it is done or dead.

    items: id (rows without one are refused), payload, ts with a watermark; an id that comes again is the same item. ``work(payload, attempt)`` gives a text or
    raises. An item that fails waits for ``backoff``, twice as long each time, and is dead after ``most`` attempts. An item is held
    by the one task that has its key in a micro-batch, which is its lease: it ends with the batch, and what a lost
    task has tried counts only if its batch was committed. So ``work`` may be called again for the same attempt and has to be
    repeatable; results come once. All due items of a micro-batch are worked side by side, whatever their order.
    """
    kind = items.schema["id"].dataType.simpleString()
    own = items.where("id is not null").select(F.pmod(F.xxhash64("id"), F.lit(groups)).alias("group"), "id", "payload", "ts", _whole(F.unix_micros("ts")).alias("at"))
    kept = own.dropDuplicates(["group", "id", "ts", "payload", "at"])  # what is late goes here, before its id is known
    first = kept.groupBy("group").applyInPandas(_firsts, kept.schema)  # with the watermark's mark on ts, which is part of the schema
    return first.dropDuplicates(["id"]).groupBy("group").applyInPandasWithState(
        _queued(work, most, int(backoff.total_seconds() * 1000)), f"id {kind}, state string, attempts int, result string, error string", f"waiting array<struct<id: {kind}, payload: string, attempts: int, due: bigint>>", "append", "EventTimeTimeout"
    )
