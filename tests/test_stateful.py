"""Stateful streams and exactly-once sinks, with restarts and replays."""

import datetime as dt
import random

from pyspark.sql import functions as F

from loomspan.operators.snapshots import Store
from loomspan.streaming import events, sinks, stateful

START = dt.datetime(2024, 1, 1)
PROMPT = "session_id string, event_id long, ts timestamp, number long"
ITEM = "id string, payload string, ts timestamp"


def after(minutes):
    return START + dt.timedelta(minutes=minutes)


def put(spark, folder, schema, rows):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def ran(spark, stream, out, check):
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)


def test_prompts_are_numbered_and_turns_queued_once(spark, tmp_path):
    stateful.prepared(spark)
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    made = lambda: stateful.prompts(spark.readStream.schema(PROMPT).parquet(src).withWatermark("ts", "0 seconds"), dt.timedelta(minutes=30))
    put(spark, src, PROMPT, [("a", 2, after(1), None), ("a", 1, after(0), None), ("b", 3, after(2), None), ("c", 4, after(3), 5)])
    ran(spark, made(), out, check)
    rows = lambda: {(r.session_id, r.kind, r.number, r.event_id) for r in spark.read.parquet(out).collect()}
    first = {("a", "prompt", 1, 1), ("a", "prompt", 2, 2), ("a", "turn", 1, None), ("b", "prompt", 1, 3), ("c", "prompt", 5, 4), *[("c", "turn", k, None) for k in range(1, 5)]}
    assert rows() == first
    # Restarted from its checkpoint: numbers go on, a known number is no second prompt, and b is idle.
    put(spark, src, PROMPT, [("a", 5, after(20), None), ("c", 6, after(20), 5), ("z", 9, after(40), None)])
    ran(spark, made(), out, check)
    assert rows() == {*first, ("a", "prompt", 3, 5), ("a", "turn", 2, None), ("b", "turn", 1, None), ("z", "prompt", 1, 9)}
    put(spark, src, PROMPT, [("b", 7, after(41), None), ("y", 8, after(500), None)])
    ran(spark, made(), out, check)
    now = [tuple(r) for r in spark.read.parquet(out).select("session_id", "kind", "number", "event_id").collect()]
    assert len(now) == len(set(now))
    turns = sorted((s, n) for s, k, n, _ in now if k == "turn")
    assert turns == [("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 2), ("c", 1), ("c", 2), ("c", 3), ("c", 4), ("c", 5), ("z", 1)]
    assert ("b", "prompt", 2, 7) in now


def faulty(payload, attempt):
    if payload == "never" or (payload == "third" and attempt < 3):
        raise ValueError(f"no {payload} at {attempt}")
    return f"{payload} at {attempt}"


def test_queue_retries_and_dead_letters(spark, tmp_path):
    stateful.prepared(spark)
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    made = lambda: stateful.worked(spark.readStream.schema(ITEM).parquet(src).withWatermark("ts", "0 seconds"), faulty, most=4, backoff=dt.timedelta(minutes=10))
    rows = lambda: {(r.id, r.state, r.attempts, r.result, r.error) for r in spark.read.parquet(out).collect()}
    put(spark, src, ITEM, [("x", "fine", after(0)), ("x", "fine", after(0)), ("y", "third", after(0)), ("z", "never", after(1))])
    ran(spark, made(), out, check)
    done = {("x", "done", 1, "fine at 1", None)}
    assert rows() == done
    put(spark, src, ITEM, [("w", "fine", after(15))])  # the second tries are due, the third are not
    ran(spark, made(), out, check)
    done |= {("w", "done", 1, "fine at 1", None)}
    assert rows() == done
    put(spark, src, ITEM, [("x", "fine", after(40)), ("y", "third", after(40))])  # both are known; third tries are due
    ran(spark, made(), out, check)
    done |= {("y", "done", 3, "third at 3", None)}
    assert rows() == done
    put(spark, src, ITEM, [("v", "fine", after(500))])
    ran(spark, made(), out, check)
    done |= {("v", "done", 1, "fine at 1", None), ("z", "dead", 4, None, "no never at 4")}
    assert rows() == done and spark.read.parquet(out).count() == len(done)


def held(spark, stream, out, check):
    """Runs a stream and gives the most rows of state that its operator of groups held."""
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return max(o.numRowsTotal for p in q.recentProgress for o in p.stateOperators if o.operatorName != "dedupe")


def test_items_share_groups_and_late_ones_may_come_again(spark, tmp_path):
    stateful.prepared(spark)
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    made = lambda: stateful.worked(spark.readStream.schema(ITEM).parquet(src).withWatermark("ts", "0 seconds"), faulty, 4, dt.timedelta(minutes=10), groups=8)
    rows = lambda: {(r.id, r.state, r.attempts, r.result) for r in spark.read.parquet(out).collect()}
    kinds = ["fine", "third", "never"]
    own = [(str(i), kinds[i % 3], after(1)) for i in range(300)]
    put(spark, src, ITEM, [*own, *own, ("0", "never", after(3)), ("1", None, after(2)), ("n", "third", None), (None, "fine", after(1))])
    assert 0 < held(spark, made(), out, check) <= 8  # 200 items wait in 8 groups
    done = {(str(i), "done", 1, "fine at 1") for i in range(0, 300, 3)} | {("n", "done", 3, "third at 3")}
    assert rows() == done  # the earliest of an item counts; one without a time is due at once
    put(spark, src, ITEM, [("late", "fine", after(0)), ("w", "fine", after(500))])
    held(spark, made(), out, check)
    done |= {("w", "done", 1, "fine at 1")} | {(str(i), "done", 3, "third at 3") for i in range(1, 300, 3)} | {(str(i), "dead", 4, None) for i in range(2, 300, 3)}
    assert rows() == done
    put(spark, src, ITEM, [("late", "fine", after(600)), ("2", "fine", after(600))])
    held(spark, made(), out, check)
    done |= {("late", "done", 1, "fine at 1")}
    assert rows() == done and spark.read.parquet(out).count() == len(done)


def test_sessions_share_groups(spark, tmp_path):
    stateful.prepared(spark)
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    made = lambda: stateful.prompts(spark.readStream.schema(PROMPT).parquet(src).withWatermark("ts", "0 seconds"), dt.timedelta(minutes=30), groups=8)
    own = [(f"s{i % 200}", (1 << 60) + i, after(i % 7), None) for i in range(900)] + [("none", None, after(1), None), ("none", 7, None, None)]
    put(spark, src, PROMPT, own)
    assert held(spark, made(), out, check) <= 8
    put(spark, src, PROMPT, [("far", 1, after(900), None)])
    held(spark, made(), out, check)
    table = spark.createDataFrame(own, PROMPT).withColumn("ts", F.coalesce("ts", F.lit(after(5_000))))
    want = sorted(tuple(r) for r in stateful.prompts_of_table(table).select("session_id", "kind", "number", F.coalesce("event_id", F.lit(-1))).collect())
    got = sorted(tuple(r) for r in spark.read.parquet(out).where("session_id <> 'far'").select("session_id", "kind", "number", F.coalesce("event_id", F.lit(-1))).collect())
    assert got == want


def test_ranges_of_numbers_equal_a_set():
    r = random.Random(5)
    for _ in range(200):
        ranges, known = [], set()
        for n in (r.randrange(30) for _ in range(40)):
            assert stateful._added(ranges, n) == (n not in known)
            known.add(n)
            assert {k for a, b in ranges for k in range(a, b + 1)} == known
            assert all(b + 1 < c for (_, b), (c, _) in zip(ranges, ranges[1:]))


LEDGER = "bucket string, baseline long, served long"


def test_rollup_takes_each_batch_once(spark, tmp_path):
    src, store = str(tmp_path / "src"), str(tmp_path / "store")
    for k in range(3):
        put(spark, src, LEDGER, [("retrieval", 10 + k, 4), ("grammar", 5, 1), ("odd", 1, 1)][: 3 - k])
    stream = lambda: spark.readStream.schema(LEDGER).option("maxFilesPerTrigger", 1).parquet(src)
    sinks.rolled_up(stream(), store, str(tmp_path / "c")).awaitTermination()
    db = Store(spark, store)
    got = lambda v=None: sorted(tuple(r) for r in sinks.totals(db, "bucket string, baseline long, served long, calls long", ["bucket"], version=v).collect())
    want = sorted(tuple(r) for r in events.savings(spark.read.schema(LEDGER).parquet(src)).collect())
    assert got() == want == [("grammar", 10, 2, 2), ("retrieval", 33, 12, 3)]
    n = db.snapshot().version
    again = spark.createDataFrame([("retrieval", 999, 9, 9)], "bucket string, baseline long, served long, calls long")
    assert not sinks.write_totals(db, again, 2, ["bucket"]) and got() == want and db.snapshot().version == n  # a replay
    for k in range(3, 3 + sinks.PARTS):
        assert sinks.write_totals(db, again.withColumn("baseline", F.lit(1000 + k).cast("long")), k, ["bucket"])
    assert len(db.snapshot().folders("rollup")) <= sinks.PARTS and got() == [("grammar", 10, 2, 2), ("retrieval", 1002 + sinks.PARTS, 9, 9)]


def test_rows_are_kept_by_key_and_batch(spark, tmp_path, monkeypatch):
    db = Store(spark, str(tmp_path / "s"))
    schema = "k int, v string"
    rows = lambda *x: spark.createDataFrame(list(x), schema)
    held = lambda: sorted(tuple(r) for r in db.read(db.snapshot(), "t", schema).collect())
    assert sinks.write_rows(db, "t", rows(*[(i, "a") for i in range(9)]), 0, ["k"])
    before = set(db.snapshot().folders("t"))
    assert sinks.write_rows(db, "t", rows((3, "b"), (20, "b")), 1, ["k"])
    assert held() == sorted([(i, "a") for i in range(9) if i != 3] + [(3, "b"), (20, "b")])
    assert 1 <= len(before - set(db.snapshot().folders("t"))) <= 2  # other buckets are as they were
    assert not sinks.write_rows(db, "t", rows((3, "c")), 1, ["k"]) and (3, "b") in held()
    assert sinks.write_rows(db, "t", rows((3, "d"), (21, "d")), 2, ["k"], ignore=True) and {(3, "b"), (21, "d")} <= set(held())
    real = Store.publish

    def loses(self, base, *args):  # another writer comes first, once
        monkeypatch.setattr(Store, "publish", real)
        real(self, base, None, None, {"other": 1})
        return real(self, base, *args)

    monkeypatch.setattr(Store, "publish", loses)
    assert sinks.write_rows(db, "t", rows((60, "mine")), 3, ["k"]) and (60, "mine") in held() and db.snapshot().facts["other"] == 1
