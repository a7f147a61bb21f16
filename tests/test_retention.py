"""Rows move to archives by months, once."""

import datetime as dt
import time

from loomspan.operators import retention
from loomspan.operators.snapshots import Store

SCHEMA = "id int, created long, v string"
NOW = int(dt.datetime(2024, 7, 15, tzinfo=dt.timezone.utc).timestamp())


def test_expired_rows_move_once_and_none_is_lost(spark, tmp_path):
    db = Store(spark, str(tmp_path / "s"))
    day = retention.DAY
    rows = [(i, NOW - i * 9 * day, "x") for i in range(60)] + [(100, None, "no time"), (101, NOW - 180 * day, "at the cutoff"), (102, NOW - 180 * day - 1, "before it")]
    retention.add(db, "turns", spark.createDataFrame(rows, SCHEMA))
    retention.add(db, "decisions", spark.createDataFrame(rows[:5], SCHEMA))
    held = lambda table, v=None: {r.id for r in db.read(db.snapshot(v), table, SCHEMA).collect()}
    before, days, schemas = db.snapshot(), {"turns": 180, "decisions": 365}, {"turns": SCHEMA, "decisions": SCHEMA}
    assert len(held("turns")) == 63
    done = retention.prune(db, schemas, NOW, days)
    old = {i for i, at, _ in rows if at is not None and at < NOW - 180 * day}
    after = db.snapshot()
    assert done == {"turns": len(old), "decisions": 0} and 102 in old and 101 not in old
    assert held("archived turns") == old and held("turns") == {i for i, _, _ in rows} - old and after.version == before.version + 1
    moved = set(after.folders("archived turns")) & set(before.folders("turns"))
    assert len(moved) >= 8 and len(set(after.folders("archived turns")) - moved) == 1  # months move by name, one is divided
    assert retention.prune(db, schemas, NOW, days) == {"turns": 0, "decisions": 0} and db.snapshot().version == after.version
    later = retention.prune(db, schemas, NOW + 100 * day, days, archive=False)
    assert later["turns"] > 0 and held("archived turns") == old and held("turns", before.version) == {i for i, _, _ in rows}


def test_a_job_runs_at_each_trigger(spark, tmp_path):
    ran = []
    q = retention.scheduled(spark, lambda: ran.append(1), "1 second", str(tmp_path / "c"))
    until = time.time() + 60
    while len(ran) < 2 and time.time() < until:
        time.sleep(0.2)
    q.stop()
    assert len(ran) >= 2
