"""What sessions leave: recorded, recalled, drilled into, and moved to archives."""

import pytest

from loomspan.api import ContextEngine
from loomspan.config import SETTINGS

NOW = SETTINGS.as_of


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    own = ContextEngine(spark, str(tmp_path_factory.mktemp("store")))
    own.record_decisions(spark.createDataFrame([("Use JWT tokens", "they are stateless", "s1"), ("Keep Redis", "it is fast", None)], "decision string, reason string, session_id string"))
    own.record_areas(spark.createDataFrame([("auth.py", "checks the tokens")], "file_path string, description string"))
    own.remember("turns", spark.createDataFrame([("s1", n, f"Turn {n} about caches", NOW - 400 * 86_400 if n == 1 else NOW - 60 * n) for n in range(1, 5)], "session_id string, prompt_number long, summary string, created long"))
    own.remember("events", spark.createDataFrame([(7, "s1", 2, "Read", '{"file_path": "a"}', "out"), (8, "s1", 2, "Bash", "", None), (9, "s2", 1, "Bash", "", None)], "id long, session_id string, prompt_number long, tool_name string, raw_input string, raw_output string"))
    return own


def test_records_need_their_words(engine, spark):
    with pytest.raises(ValueError, match="decision and reason"):
        engine.record_decisions(spark.createDataFrame([("x", " ")], "decision string, reason string"))
    assert engine.remembered("decisions").count() == 2 and {r.source for r in engine.remembered("decisions").collect()} == {"manual"}


def test_timeline_and_event(engine):
    rows = [(r.prompt_number, r.summary, r.events) for r in engine.timeline("s1", 3).collect()]
    assert rows == [(1, "Turn 1 about caches", None), (2, "Turn 2 about caches", [7, 8]), (3, "Turn 3 about caches", None)]
    assert engine.timeline("nobody").count() == 0 and engine.event(7).first().raw_output == "out"


def test_recall_reads_all_that_is_remembered(engine, spark):
    topics = spark.createDataFrame([(1, "JWT tokens"), (2, "about caches")], "query_id long, topic string")
    got = {r.query_id: r.text for r in engine.recall_all(topics).collect()}
    assert "[decision] Use JWT tokens because they are stateless · just now · → session_timeline(s1)" in got[1] and "Turn 3" in got[2]


def test_prune_moves_old_turns_once(engine):
    assert engine.prune() == {"turns": 1, "decisions": 0, "areas": 0} and engine.prune() == {"turns": 0, "decisions": 0, "areas": 0}
    assert engine.remembered("turns").count() == 3 and engine.remembered("turns", archived=True).first().prompt_number == 1


def test_status_and_level(engine):
    assert engine.index_status().first()[:] == (0, 0, 0, 0, 0, 0)
    engine.set_level("max")
    assert engine.level() == "max"
    with pytest.raises(ValueError):
        engine.set_level("loud")
