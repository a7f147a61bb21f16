"""Streams over files, run to the end of what is there."""

import datetime as dt

from pyspark.sql import functions as F

from loomspan.streaming import events


def at(s, us=0):
    return dt.datetime(2024, 1, 1, 0, 0, s, us)


def test_debounced_batches(spark):
    rows = spark.createDataFrame([("r", at(1), "a", None), ("r", at(1, 300_000), "b", "c"), ("r", at(5), "a", None)], "root string, ts timestamp, path string, moved_to string")
    assert sorted(tuple(r.paths) for r in events.debounced(rows).collect()) == [("a",), ("a", "b", "c")]


def test_stream_into_table_is_repeatable(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    spark.createDataFrame([("s", 1, "a"), ("s", 1, "a"), ("s", 2, "b")], "session_id string, n int, v string").write.parquet(src)
    stream = lambda: spark.readStream.schema("session_id string, n int, v string").parquet(src)
    events.into_table(stream(), out, ["session_id", "n"], check, ignore=True).awaitTermination()
    events.into_table(stream(), out, ["session_id", "n"], check + "2", ignore=True).awaitTermination()
    assert spark.read.parquet(out).count() == 2
    spark.createDataFrame([("s", 2, "new")], "session_id string, n int, v string").write.mode("append").parquet(src)
    events.into_table(stream().where("v = 'new'"), out, ["session_id", "n"], check + "3").awaitTermination()
    assert {(r.n, r.v) for r in spark.read.parquet(out).collect()} == {(1, "a"), (2, "new")}


def test_numbering_state(spark, tmp_path):
    src = str(tmp_path / "src")
    rows = [("s", i) for i in range(1, 5)] + [("t", 9)]
    spark.createDataFrame(rows, "session_id string, event_id long").write.parquet(src)
    stream = spark.readStream.schema("session_id string, event_id long").option("maxFilesPerTrigger", 1).parquet(src)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q = events.numbered(stream).writeStream.format("memory").queryName("numbered").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("numbered").groupBy("session_id").agg(F.sort_array(F.collect_list("prompt_number")).alias("n")).collect()
    assert {r.session_id: r.n for r in got} == {"s": [1, 2, 3, 4], "t": [1]}


def test_savings_stream_and_dedup(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.createDataFrame([("retrieval", 10, 4, at(1), 1), ("retrieval", 10, 4, at(1), 1), ("odd", 1, 1, at(2), 2)], "bucket string, baseline long, served long, ts timestamp, id long").write.parquet(src)
    stream = events.on_time(spark.readStream.schema("bucket string, baseline long, served long, ts timestamp, id long").parquet(src))
    q = events.savings(events.distinct_events(stream, ["id"])).writeStream.format("memory").queryName("saved").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.bucket, r.baseline, r.calls) for r in spark.table("saved").collect()] == [("retrieval", 10, 1)]


def test_backfill_and_queue(spark):
    sessions = spark.createDataFrame([("a", 1)], "session_id string, started long")
    rows = spark.createDataFrame([("a", 5), ("b", 7), ("b", 6)], "session_id string, ts long")
    assert {(r.session_id, r.started) for r in events.backfilled(sessions, rows).collect()} == {("a", 1), ("b", 6)}
    queue = spark.createDataFrame([(i, 10 - i, 0) for i in range(8)], "id int, enqueued int, attempts int")
    assert [r.id for r in events.drained(queue).collect()] == [7, 6, 5, 4, 3]
    assert {(r.attempts, len(r.last_error)) for r in events.failed(queue, "x" * 900).collect()} == {(1, 500)}
