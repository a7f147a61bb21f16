"""Operators on small tables with results worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from loomspan.operators import chunks, graph, ledger, memory, search, tables
from loomspan.sources import embed, files, store


@pytest.fixture(scope="module")
def vecs(spark):
    return spark.createDataFrame([(1, [0.1, 0.2, 0.3, 0.4], "math.py"), (2, [0.5, 0.6, 0.7, 0.8], "math.py"), (3, [0.1, 0.2, 0.3, 0.5], "b.py"), (4, None, "b.py")], "id long, embedding array<float>, file_path string")


def test_knn(spark, vecs):
    q = spark.createDataFrame([(7, [0.1, 0.2, 0.3, 0.4])], "query_id long, query array<float>")
    got = search.knn(q, vecs, 2).orderBy("rank").collect()
    assert [r.id for r in got] == [1, 3] and got[0].distance == 0.0 and got[1].distance == pytest.approx(0.1)
    assert [r.id for r in search.knn_postfiltered(q, vecs, 1, F.col("file_path") == "b.py").collect()] == [3]
    assert [r.id for r in search.knn(q, vecs, 5, where=F.col("file_path") == "b.py").collect()] == [3]


DOCS = [(1, "def calculate_tax(amount, rate): return amount * rate"), (2, "def process_payment(card, amount): charge the card"), (3, "class ShippingCalculator: calculates shipping costs"), (4, "")]


def test_full_text(spark):
    docs = spark.createDataFrame(DOCS, "id long, content string")
    q = spark.createDataFrame([(1, "calculate_tax"), (2, "payment amount"), (3, "process_payment card"), (4, '"quoted" a-b fn(x) col:val wild*card'), (5, "")], "query_id long, text string")
    phrase = {(r.query_id, r.id) for r in search.phrase_search(q, docs, 10).collect()}
    assert phrase == {(1, 1), (3, 2)}
    found = {(r.query_id, r.id): r.score for r in search.or_search(q, docs, 10).collect()}
    assert (2, 1) in found and (2, 2) in found and found[2, 2] > found[2, 1] and not any(k == 5 for k, _ in found)


def test_bm25_closed_form(spark):
    n, df, tf, length, mean = 4.0, 1.0, 2.0, 9.0, 6.0
    row = spark.range(1).select(search.bm25(*(F.lit(x) for x in (tf, df, length, n, mean)))).first()[0]
    assert row == pytest.approx(math.log(3.5 / 1.5) * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 1.5)))
    assert spark.range(1).select(search.bm25(F.lit(1.0), F.lit(4.0), F.lit(6.0), F.lit(4.0), F.lit(6.0))).first()[0] == pytest.approx(1e-6)


def test_rrf_keeps_gaps_and_normalises(spark):
    v = spark.createDataFrame([(1, 10, 0, 0.5), (1, 11, 2, 0.6)], "query_id long, id long, rank int, distance double")
    x = spark.createDataFrame([(1, 11, 0), (1, 12, 1)], "query_id long, id long, rank int")
    got = {r.id: r for r in search.rrf(v, x, 1.5).collect()}
    assert got[10].rrf == pytest.approx(1 / 60) and got[11].rrf == pytest.approx(1 / 62 + 1.5 / 60) and got[12].rrf == pytest.approx(1.5 / 61)
    assert got[11].rrf_norm == 1.0 and got[12].distance is None


def test_capped_and_packed(spark):
    rows = spark.createDataFrame([(1, i, "a" if i < 5 else "b", 1.0 - i / 10) for i in range(8)], "query_id long, id long, file_path string, score double")
    assert [r.id for r in search.capped(rows, 5).orderBy("rank").collect()] == [0, 1, 2, 5, 6]
    sized = spark.createDataFrame([(1, 0, 0, 60, 30), (1, 1, 1, 50, 45), (1, 2, 2, 50, 20), (1, 3, 3, 20, None)], "query_id long, rank int, id long, tokens long, small_tokens long")
    got = [(r.id, r.used, r.taken) for r in search.packed(sized, 100).orderBy("rank").collect()]
    assert got == [(0, 60, True), (1, 0, False), (2, 20, True), (3, 20, True)]


def test_rank_lists_prefer_hints(spark):
    rows = spark.createDataFrame([(1, 0, 0, "k", "short"), (1, 1, 0, "k", "longer · 5m ago"), (1, 1, 1, "m", "other")], "query_id long, list int, rank int, key string, text string")
    got = search.rank_lists(rows).orderBy("rank").collect()
    assert [(r.key, r.text) for r in got] == [("k", "longer · 5m ago"), ("m", "other")] and got[0].score == pytest.approx(2 / 61, abs=1e-8)


@pytest.fixture(scope="module")
def code(spark):
    nodes = spark.createDataFrame([("file_math", "file", "math.py", "math.py"), ("add", "function", "add", "math.py"), ("mul", "function", "mul", "math.py"), ("file_util", "file", "util.py", "util.py")], "id string, node_type string, name string, file_path string")
    edges = spark.createDataFrame([("file_math", "add", "defines"), ("file_math", "mul", "defines"), ("add", "mul", "calls"), ("file_util", "file_math", "imports"), ("add", "nowhere", "calls")], "source_id string, target_id string, edge_type string")
    return nodes, edges


def test_graph(spark, code):
    nodes, edges = code
    ask = lambda *ids: spark.createDataFrame([(i,) for i in ids], "source_id string")
    ids = lambda df: {r.id for r in df.collect()}
    assert ids(graph.neighbours(edges, nodes, ask("file_math"))) == {"add", "mul"}
    assert ids(graph.neighbours(edges, nodes, ask("add"), "calls")) == {"mul"}
    assert ids(graph.neighbours(edges, nodes, ask("mul"), direction="in")) == {"file_math", "add"}
    assert graph.nodes_where(nodes, "math.py").count() == 3 and graph.nodes_where(nodes, node_type="function").count() == 2
    f = lambda *names: spark.createDataFrame([(n,) for n in names], "file_path string")
    assert [r.file_path for r in graph.related_files(edges, nodes, f("util.py")).collect()] == ["math.py"]
    assert graph.related_files(edges, nodes, f("math.py")).count() == 0
    left, links = graph.without_files(nodes, edges, f("math.py"))
    assert ids(left) == {"file_util"} and links.count() == 0


def test_expansion_is_new_and_scored(spark):
    nodes = spark.createDataFrame([("a", "file", "a", "a.py"), ("b", "file", "b", "b.py")], "id string, node_type string, name string, file_path string")
    edges = spark.createDataFrame([("a", "b", "calls")], "source_id string, target_id string, edge_type string")
    ranked = spark.createDataFrame([(1, 1, "a.py", 0)], "query_id long, id long, file_path string, rank int")
    near = spark.createDataFrame([(1, 1, "a.py", 0.1), (1, 2, "b.py", 0.2), (1, 3, "b.py", 1.5), (1, 4, "b.py", 0.4)], "query_id long, id long, file_path string, distance double")
    got = {r.id: r.score for r in graph.expand(ranked, edges, nodes, near).collect()}
    assert got == {2: pytest.approx(0.8 * 0.85), 4: pytest.approx(0.6 * 0.85)}


def test_code_graph_and_import_resolution(spark):
    own = spark.createDataFrame([("c1", "function", "pkg/a.py", "def f(x): pass")], "id string, chunk_type string, file_path string, content string").unionByName(spark.createDataFrame([("c2", "module", "util.py", "x")], "id string, chunk_type string, file_path string, content string"))
    imports = spark.createDataFrame([("pkg/a.py", "util")], "file_path string, module string")
    nodes, edges = graph.code_graph(own, imports)
    assert {r.name for r in nodes.where("node_type = 'function'").collect()} == {"def f"}
    assert graph.neighbours(edges, nodes, spark.createDataFrame([("file_pkg/a.py",)], "source_id string"), "imports").count() == 0
    linked = graph.resolved_imports(edges, nodes)
    assert {r.id for r in graph.neighbours(linked, nodes, spark.createDataFrame([("file_pkg/a.py",)], "source_id string"), "imports").collect()} == {"file_util.py"}


def test_manifest(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "file_path string, content_hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "file_path string, content_hash string")
    assert {r.file_path: r.status for r in tables.manifest_diff(old, new).collect()} == {"a": "unchanged", "b": "changed", "c": "deleted", "d": "new"}
    assert {r.status for r in tables.manifest_diff(old, new, full=True).where("file_path = 'a'").collect()} == {"changed"}


def test_upserts(spark):
    old = spark.createDataFrame([(1, "x", 1), (2, "y", 1)], "id int, v string, o int")
    new = spark.createDataFrame([(2, "z", 1), (2, "w", 2), (3, "n", 1)], "id int, v string, o int")
    assert {(r.id, r.v) for r in tables.upsert(old, new, ["id"], "o").collect()} == {(1, "x"), (2, "w"), (3, "n")}
    queue = spark.createDataFrame([("roll", None), ("roll", None), ("turn", 1)], "kind string, n int")
    assert tables.insert_or_ignore(queue.limit(0), queue, ["kind", "n"]).count() == 2
    assert tables.insert_or_ignore(queue, queue, ["kind", "n"]).count() == 0


def test_prune_without_live_rows_keeps_all(spark):
    cached = spark.createDataFrame([("a",), ("b",)], "h string")
    assert tables.prune(cached, cached.limit(0), "h").count() == 2
    assert tables.prune(cached, spark.createDataFrame([("a",)], "h string"), "h").count() == 1


def test_age_out(spark):
    p = spark.createDataFrame([(1, "in", "out", 5), (2, "in", None, 5), (3, "in", "out", 7)], "id long, raw_input string, raw_output string, size_bytes long")
    e = spark.createDataFrame([(1, 100), (2, 10)], "payload_id long, ts long")
    got = {r.id: (r.raw_input, r.raw_output, r.size_bytes, r.aged) for r in tables.age_out(p, e, F.lit(50)).collect()}
    assert got == {1: ("in", "out", 5, False), 2: ("", None, 0, True), 3: ("", None, 0, True)}


def test_retention(spark):
    now, day = 1_000 * 86_400, 86_400
    rows = spark.createDataFrame([("decision", now - 400 * day), ("decision", now - 10 * day), ("turn", now - 300 * day), ("decision", now - 300 * day)], "kind string, created long")
    got = [r.archived for r in tables.retention(rows, now, {"turn": 180, "decision": 365}).collect()]
    assert got == [True, False, True, False]


def test_ledger(spark):
    rows = spark.createDataFrame([("retrieval", 1000, 200, '{"level":"max"}'), ("retrieval", 500, 100, None), ("nonsense", 9, 9, "not json"), ("output_compression", 10, 5, '{"level":"max"}')], "bucket string, baseline long, served long, meta string")
    got = {r.bucket: (r.baseline, r.served, r.calls) for r in ledger.by_bucket(rows).collect()}
    assert got["retrieval"] == (1500, 300, 2) and got["grammar"] == (0, 0, 0) and len(got) == 7
    assert [(r.level, r.calls) for r in ledger.levels(rows).collect()] == [("max", 2)]
    row = ledger.line(rows, 15.0).first()
    assert (row.saved, row.pct, row.line) == (1200, 80, "1.2k tokens saved (80%) $0.02")
    assert ledger.report(rows, 1.0, 2.0).orderBy("place").first().bucket == "retrieval"


def test_evaluation_rules(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    ranked = spark.createDataFrame([(1, 5, 0), (1, 6, 1), (3, 9, 0)], "query_id long, id long, rank int")
    good = spark.createDataFrame([(1, 6), (3, 1)], "query_id long, id long")
    got = {r.query_id: (r.recall, r.precision, r.mrr) for r in ledger.recall_at_k(ranked, good, q, 2).collect()}
    assert got == {1: (1.0, 0.5, 0.5), 2: (1.0, 1.0, 1.0), 3: (0.0, 0.0, 0.0)}
    res = spark.createDataFrame([(1, "a"), (1, "b")], "query_id long, file string")
    want = spark.createDataFrame([(1, "a"), (2, "c")], "query_id long, file string")
    pr = {r.query_id: (r.precision, r.recall) for r in ledger.precision_recall(res, want, q).collect()}
    assert pr == {1: (0.5, 1.0), 2: (0.0, 0.0), 3: (0.0, 1.0)}


def test_chunks(spark):
    py = "import os\nfrom pathlib import Path\nclass A:\n    def f(self):\n        return 1\n\ndef g():\n    pass\n"
    js = "import React from 'react';\nimport x from '@s/p/q';\nfunction hi(a) {\n  return `}`;\n}\nclass B {\n  m(x) {\n    return 1;\n  }\n}\n"
    rows = spark.createDataFrame([("a.py", py, "python"), ("b.js", js, "javascript"), ("c.md", "# T\ntext\n", "markdown"), ("bad.py", "def (:", "python")], "file_path string, content string, language string")
    got = {(r.file_path, r.chunk_type, r.start_line, r.end_line) for r in chunks.chunks(rows).collect()}
    assert got == {("a.py", "class", 3, 5), ("a.py", "function", 4, 5), ("a.py", "function", 7, 8), ("b.js", "function", 3, 5), ("b.js", "class", 6, 10), ("b.js", "function", 7, 9), ("c.md", "module", 1, 2), ("bad.py", "module", 1, 1)}
    assert sorted((r.file_path, r.module) for r in chunks.imports(rows).collect()) == [("a.py", "os"), ("a.py", "pathlib"), ("b.js", "@s/p"), ("b.js", "react")]


def test_git_log(spark):
    sha = [c * 40 for c in "abc"]
    text = "".join(f"{s}\nAnn\n2024-01-0{i}\nAdd file{i}\nbody {i}\n\0" for i, s in enumerate(sha, 1)) + "broken\0zz\nA\nd\ns\0"
    got = files.commits(spark.createDataFrame([(text,)], "text string"))
    assert [(r.id, r.file_path, r.author, r.content) for r in got.orderBy("sha").collect()][0] == ("commit_aaaaaaa", "git:aaaaaaa", "Ann", "Add file1\n\nbody 1") and got.count() == 3
    lines = [sha[0], "x.py", "", sha[1], "y.py", "z.py"]
    changed = files.changed_files(spark.createDataFrame(list(enumerate(lines)), "at int, line string"))
    assert {(r.sha[0], r.file_path) for r in changed.collect()} == {("a", "x.py"), ("b", "y.py"), ("b", "z.py")}
    assert files.commit_edges(got, changed).count() == 3


def test_project_scan(spark, tmp_path):
    for name, data in {"src/a.py": b"x = 1", "node_modules/b.js": b"1", "c.png": b"1", ".env": b"k", "bad.txt": b"\xff\xfe", "docs/d.md": "é".encode()}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {(r.file_path, r.language) for r in files.project_files(spark, str(tmp_path)).collect()}
    assert got == {("src/a.py", "python"), ("docs/d.md", "markdown")}
    assert [r.file_path for r in files.project_files(spark, str(tmp_path), target="docs").collect()] == ["docs/d.md"]
    with pytest.raises(ValueError):
        files.project_files(spark, str(tmp_path), target="../x")


def test_sessions_and_turns(spark):
    rows = spark.createDataFrame([("s", 0, "assistant", "hi"), ("s", 1, "user", "a"), ("s", 2, "assistant", "b"), ("s", 3, "user", "c")], "session_id string, at int, role string, text string")
    assert [r.prompt_number for r in memory.numbered_prompts(rows).orderBy("at").collect()] == [0, 1, 1, 2]
    prompts = spark.createDataFrame([("s", 1, "do it")], "session_id string, prompt_number long, prompt_text string")
    events = spark.createDataFrame([(2, "s", 1, "Read", 20), (1, "s", 1, "Bash", 10), (3, "s", 1, "Odd", 30), (4, "s", 1, "None", None)], "id long, session_id string, prompt_number long, tool_name string, payload_id long")
    payloads = spark.createDataFrame([(10, '{"command": "ls"}', " out "), (20, '{"x": 1, "y": 2, "z": 3}', None), (30, "not json", "")], "id long, raw_input string, raw_output string")
    assert memory.turn_texts(prompts, events, payloads).first().text == "User: do it\nBash command='ls'\nout\nRead ['x', 'y']\nOdd: not json\nNone"


def test_summary_keeps_order(spark):
    text = "Alpha beta gamma. Alpha beta delta! Zeta unrelated words here. Alpha gamma beta. Nothing in common."
    got = memory.summaries(spark.createDataFrame([(text,), ("Only one.",), (None,)], "text string")).collect()
    assert got[0].summary == "Alpha beta gamma. Alpha beta delta! Alpha gamma beta." and got[1].summary == "Only one." and got[2].summary == ""


def test_content_keys_collapse(spark):
    rows = spark.createDataFrame([("[decision] Adopt the JWT · 5m ago · → session_timeline(\"x\")",), ("Adopt JWT",)], "t string")
    keys = {r[0] for r in rows.select(memory.content_key(F.col("t"))).collect()}
    assert keys == {"Adopt JWT"}


def test_embedder_and_cache(spark):
    v = embed.hashed_vectors(["Add numbers", "add NUMBERS", ""])
    assert (v[0] == v[1]).all() and not v[2].any() and abs((v[0] ** 2).sum() - 1) < 1e-5
    rows = spark.createDataFrame([("a b",), ("c d",)], "text string")
    first = embed.cached(rows, spark.createDataFrame([], "content_hash string, embedding array<float>"), "text", "m")
    second = embed.cached(rows, first.where("text = 'a b'"), "text", "m")
    assert {r.text: r.hit for r in second.collect()} == {"a b": True, "c d": False}

    def picky(texts):
        if len(texts) > 1 or len(texts[0]) > 3:
            raise ValueError
        return embed.hashed_vectors(texts)

    assert embed.halving(picky)(["abcdef", "xy"]).shape == (2, embed.DIMENSIONS)


def test_store(spark, tmp_path):
    (tmp_path / "s1.json").write_text('{"id": "s1", "decisions": [{"decision": "d", "reason": "r", "timestamp": 5.0}]}')
    (tmp_path / "s2.json").write_text("{broken")
    rows = store.sessions(spark, str(tmp_path))
    assert [r.id for r in rows.collect()] == ["s1"]
    done = spark.createDataFrame([], "file string")
    moved = store.legacy_decisions(rows, done)
    assert [(r.decision, r.source, r.created) for r in moved.collect()] == [("d", "migrated", 5)]
    assert store.legacy_decisions(rows, moved.select("file")).count() == 0
    assert {r.file_path for r in store.manifest(spark, '{"schema_version": 2, "files": {"a": "1"}}').collect()} == {"a"}
    assert store.manifest(spark, "{nope").count() == 0 and store.manifest(spark, '{"a": "1"}').count() == 1
    table = store.prices(spark, {"new": (1.0, None)})
    got = {r.model: (r.input_rate, r.output_rate) for r in store.priced(spark.createDataFrame([("new",), ("who",)], "model string"), table).collect()}
    assert got == {"new": (1.0, 75.0), "who": (15.0, 75.0)}


def test_fusion_weights_by_query(spark):
    rows = [(q, i, i, 0.5) for q in (1, 2) for i in (0, 1)]
    near = spark.createDataFrame(rows, "query_id long, id long, rank int, distance double")
    found = spark.createDataFrame([(q, 1, 0) for q in (1, 2)], "query_id long, id long, rank int")
    weights = search.intent_weights(spark.createDataFrame([(1, "code_lookup")], "query_id long, intent string"))
    got = {(r.query_id, r.id): r.rrf for r in search.rrf(near, found, weights).collect()}
    assert math.isclose(got[1, 1], 1 / 61 + 1.5 / 60) and math.isclose(got[2, 1], 1 / 61 + 1 / 60) and got[1, 0] == got[2, 0] == 1 / 60


def test_scores_are_whole_sums_rounded_as_in_sql(spark):
    import random

    import duckdb

    r = random.Random(3)
    words = [f"w{chr(97 + i)}" for i in range(12)]
    texts = {i: [r.choice(words) for _ in range(r.randrange(1, 40))] for i in range(300)}
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in texts.items()], "id long, content string").repartition(4)
    found = search.or_search(spark.createDataFrame([(1, " ".join(words))], "query_id long, text string"), docs, 1_000).collect()
    mean = sum(map(len, texts.values())) / len(texts)
    df = {w: sum(w in x for x in texts.values()) for w in words}
    for x in found:
        parts, own = 0, texts[x.id]
        for w in set(own):
            idf, tf = math.log((300 - df[w] + 0.5) / (df[w] + 0.5)), own.count(w)
            parts += math.floor((idf if idf > 0 else 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(own) / mean)) * 1e9 + 0.5)
        assert x.score == parts / 1e9
    halves = [(33_000_000 + 10 * i + 5) / 1e7 for i in range(3_000)] + [33.2217735]
    got = [x[0] for x in spark.createDataFrame([(x,) for x in halves], "x double").coalesce(1).select(search.six(F.col("x"))).collect()]
    assert got == [duckdb.execute("SELECT round(CAST(? AS DOUBLE), 6)", [x]).fetchone()[0] for x in halves]


def test_a_vertical_tab_keeps_texts_apart_as_in_sql(spark, tmp_path):
    from loomspan.plans.search_plans import dedup_first_rank

    texts = ["alpha beta", "alpha\x0bbeta", "alpha\x0c\nbeta ", "alpha \x0b beta", "\talpha\r\n beta", "other"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(50, "alpha beta")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert sorted(r.id for r in dedup_first_rank(spark, str(tmp_path)).collect()) == [0, 1, 3]
