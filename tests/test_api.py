"""The engine end to end on a small project, and the texts that it shows."""

import subprocess

import pytest
from pyspark.sql import functions as F

from loomspan.api import ContextEngine
from loomspan.operators import compress, present
from loomspan.sources import files, store

AUTH = "import util\n\nclass UserAuth:\n    def check_token(self, token):\n        return util.decode(token)\n"
UTIL = "def decode(text):\n    return text[::-1]\n\ndef encode(text):\n    return text\n"


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    (root / "auth.py").write_text(AUTH)
    (root / "util.py").write_text(UTIL)
    (root / "README.md").write_text("A project about tokens.\n")
    own = ContextEngine(spark, str(tmp_path_factory.mktemp("store")))
    own.root = root
    own.first = own.index(str(root))
    return own


def test_index_is_incremental(engine):
    assert (engine.first.new, engine.first.chunks, engine.first.hits) == (3, 5, 0)
    again = engine.index(str(engine.root))
    assert (again.new, again.changed, again.unchanged, again.chunks) == (0, 0, 3, 0)
    (engine.root / "util.py").write_text(UTIL + "\ndef third():\n    return 3\n")
    (engine.root / "README.md").unlink()
    done = engine.index(str(engine.root))
    assert (done.changed, done.deleted, done.chunks, done.hits) == (1, 1, 3, 2)
    assert {r.file_path for r in engine.table("manifest").collect()} == {"auth.py", "util.py"}
    assert {r.file_path for r in engine.table("chunks").collect()} == {"auth.py", "util.py"}
    assert {(r.source_id, r.target_id) for r in engine.table("edges").where("edge_type = 'imports'").collect()} == {("file_auth.py", "module_util")}


def test_search_and_lookup(engine, spark):
    queries = spark.createDataFrame([(1, "check_token"), (2, "decode text")], "query_id long, text string")
    first = {r.query_id: r.file_path for r in engine.ranked(queries, 3).where("rank = 0").collect()}
    assert first == {1: "auth.py", 2: "util.py"}
    text = {r.query_id: r.text for r in engine.search(queries, 2, max_tokens=12).collect()}
    assert text[1].startswith("[auth.py:") and "expand_chunk" in text[1]
    one = engine.table("chunks").where("chunk_type = 'class'").first()
    assert engine.chunk(one.id).first().content.startswith("class UserAuth")
    assert engine.related(one.id).count() == 0 and {r.id for r in engine.related(one.id, direction="in").collect()} == {"file_auth.py"}


def test_recall(engine, spark):
    items = spark.createDataFrame([(1, "[decision] Use the JWT tokens because they are stateless · 5m ago"), (2, "Cache rows in Redis"), (3, "Use JWT tokens because they are stateless")], "id long, text string")
    topics = spark.createDataFrame([(1, "what about the JWT tokens"), (2, "edis")], "query_id long, topic string")
    got = {r.query_id: r.text for r in engine.recall(topics, items).collect()}
    assert got[1].count("JWT") == 1 and "5m ago" in got[1] and got[2] == "- Cache rows in Redis"


def test_compression_levels(spark):
    rows = spark.createDataFrame([("a", "x" * 400, "module", 0.9, [1.0]), ("b", "def f(alpha):\n    return 1\n", "function", 0.1, [1.0]), ("c", "y" * 900, "doc", 0.1, None)], "id string, content string, chunk_type string, confidence_score double, embedding array<double>")
    cache = spark.createDataFrame([("b", "standard", "cached!")], "chunk_id string, level string, compressed string")
    got = {r.id: (r.origin, len(r.compressed_content)) for r in compress.compressed(rows, "standard", cache).collect()}
    assert got == {"a": ("short", 303), "b": ("cached", 7), "c": ("short", 303)}
    assert {r.id: r.origin for r in compress.compressed(rows, "full").collect()} == {"a": "passed", "b": "short", "c": "passed"}
    told = compress.compressed(rows, "standard", None, lambda prompt, text: "f takes alpha" if "def" in text else "nothing")
    assert {r.id: r.origin for r in told.collect()} == {"a": "summary", "b": "summary", "c": "summary"}
    assert {r.chunk_id for r in compress.cache_rows(told, "standard").collect()} == {"a", "b", "c"}
    lossy = compress.compressed(rows.where("id = 'b'"), "standard", None, lambda prompt, text: "gone").first()
    assert lossy.origin == "short" and lossy.compressed_content == "def f(alpha):\n    return 1\n"


def test_overview(spark):
    rows = spark.createDataFrame([(1, "b.py", "text b", None, 0.9, 0), (2, "a.py", "text a", "short a", 0.85, 1), (3, "c.py", "z" * 300, "", 0.6, 2), (4, "d.py", "low", None, 0.1, 3)], "id long, file_path string, content string, compressed_content string, confidence_score double, rank int")
    text = present.overview(rows, "demo", ["abc first"], ["use x"], ["Branch: main"]).first().text
    assert text.index("**a.py:**\n- short a") < text.index("**b.py:**\n- text b") and "- [c.py] " + "z" * 150 in text and "low" not in text
    assert text.startswith("## Project: demo\n`4 chunks indexed`") and "- abc first" in text and "  Branch: main" in text and "- use x" in text
    assert present.overview(rows, "demo", max_tokens=10).first().text.endswith("[Context truncated to fit token limit]")
    assert "No indexed context" in present.overview(rows.limit(0), "demo").first().text
    both = present.merged_searches(rows.select("id", "rank"), rows.select("id", "rank").unionByName(spark.createDataFrame([(9, 0)], "id long, rank int")))
    assert {(r.list, r.id) for r in both.where("list = 1").collect()} == {(1, 9)}


def test_resume_and_status(spark):
    sessions = spark.createDataFrame([(1, "then", "old"), (2, None, "new config"), (3, None, "")], "started long, ended string, rollup string")
    made = spark.createDataFrame([(i, i, f"d{i}", "r" * 300, "auto" if i == 6 else "manual", "s" if i == 6 else None) for i in range(7)], "id long, created long, decision string, reason string, source string, session_id string")
    text = present.resume(sessions, made).first().text
    assert "(in progress):\n  new configuration" in text and text.count("  - d") == 5 and "d6 — " + "r" * 200 + "… _[auto]_ (session: `s`)" in text and "d1" not in text
    stats = spark.createDataFrame([(2, 1000, 200, 4000), (2, 1000, 200, 0), (0, 0, 0, 0)], "queries long, raw long, served long, full_file long")
    got = [r.text for r in present.status(stats, 15.0).collect()]
    assert got[0] == "Token savings (2 queries): 4,000 full-file baseline → 200 served (95% saved, $0.06)" and "1,000 raw" in got[1] and "waiting" in got[2]


def test_git_folder(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.email=a@b.c", "-c", "user.name=Ann", *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    (tmp_path / "x.py").write_text("1")
    run("add", "x.py")
    run("commit", "-qm", "Add x")
    (tmp_path / "x.py").write_text("2")
    (tmp_path / "y.py").write_text("2")
    state = files.working_state(str(tmp_path))
    assert state["state"] == ["Branch: main", "Modified (unstaged):", "  M\tx.py", "Untracked files: 1"] and state["files"] == ["x.py"]
    log, names = files.git_log(spark, str(tmp_path))
    own = files.commits(log)
    assert own.first().subject == "Add x" and files.commit_edges(own, files.changed_files(names)).first().target_id == "file_x.py"
    assert files.working_state("/nonexistent")["state"] == []


def test_json_in_and_out(spark):
    got = store.ingested(spark, '{"chunks": [{"id": "a", "content": "x", "embedding": [1.0]}], "nodes": []}')
    assert got["chunks"].first().id == "a" and got["edges"].count() == 0
    one = spark.createDataFrame([(1,)], "n int")
    assert {(r.kind, r.value) for r in store.exported_state(one, one, one).collect()} == {(k, '{"n":1}') for k in ("stats", "manifest", "sessions")}
    assert present.is_tool_file is not None and spark.range(1).select(present.is_tool_file(F.lit(".cursor/x")), present.watched(F.lit("a/.git/x"), [".git"])).first()[:] == (True, False)
