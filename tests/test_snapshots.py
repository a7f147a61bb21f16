"""Versions of a store: whole or not at all, pinned, one writer at a time; indexing as batches of them."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.operators import indexing, postings
from loomspan.operators.snapshots import Conflict, Snapshot, Store, bucket_of
from loomspan.sources import embed

SCHEMA = "k int, v string"


class Stopped(Exception):
    pass


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


def held(db, version=None, table="a"):
    return sorted((r.k, r.v) for r in db.read(db.snapshot(version), table, SCHEMA).collect())


def test_versions_replace_buckets_and_stay_readable(spark, tmp_path):
    db, by = Store(spark, str(tmp_path / "s")), bucket_of(F.col("k"), 4)
    assert db.snapshot() == Snapshot() and held(db) == []
    first = db.publish(db.snapshot(), {"a": (None, db.write("a", rows(spark, *[(i, "old") for i in range(20)]), by))}, facts={"n": 4})
    bucket = rows(spark, (7, "")).select(by.alias("b")).first().b
    second = db.publish(first, {"a": ([bucket], db.write("a", rows(spark, (7, "new")), by))})
    assert held(db, 1) == [(i, "old") for i in range(20)]
    now = held(db)
    assert (7, "new") in now and all(v == "old" for k, v in now if k != 7) and 1 <= len(now) < 20
    assert second.facts == {"n": 4} and len(set(first.folders("a")) & set(second.folders("a"))) == 3
    assert {r.k for r in db.read(second, "a", SCHEMA, [bucket]).collect()} == {7}
    empty = db.clear()
    assert held(db) == [] and held(db, 2) == now and empty.version == 3


def test_of_two_writers_one_fails_cleanly(spark, tmp_path):
    db, other = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    base = db.snapshot()
    mine, theirs = db.write("a", rows(spark, (1, "mine"))), other.write("a", rows(spark, (1, "theirs")))
    db.publish(base, append={"a": mine})
    with pytest.raises(Conflict):
        other.publish(base, append={"a": theirs})
    assert held(db) == [(1, "mine")] and db.versions() == [1]
    other.publish(other.snapshot(), append={"a": theirs})
    assert held(db) == [(1, "mine"), (1, "theirs")]
    assert db.expire(keep=1) == 0 and db.expire(keep=1, age=-5) == 0 and db.versions() == [2]
    db.publish(db.snapshot(), {"a": (None, [])})
    assert db.expire(keep=1, age=-5) == 2 and held(db) == []


def test_a_stop_after_any_step_leaves_one_whole_version(spark, tmp_path, monkeypatch):
    db = Store(spark, str(tmp_path / "s"))
    by = bucket_of(F.col("k"), 2)

    def change(word):
        base = db.snapshot()
        parts = {t: (None, db.write(t, rows(spark, (1, word), (2, word)), by)) for t in ("a", "b")}
        db.publish(base, parts)

    change("first")
    write, put, delete = Store.write, Store._put, []
    for stop in range(4):
        steps = iter(range(9))

        def counted(f, stop=stop, steps=steps):
            def run(*args, **named):
                done = f(*args, **named)
                if next(steps) == stop:
                    raise Stopped
                return done

            return run

        monkeypatch.setattr(Store, "write", counted(write))
        monkeypatch.setattr(Store, "_put", counted(put) if stop < 3 else put)
        if stop < 3:
            with pytest.raises(Stopped):
                change(f"word {stop}")
        else:  # a draft that was never put
            (tmp_path / "s" / "log" / "000000000009.json.x.draft").write_text("{")
        monkeypatch.undo()
        seen = {t: held(db, table=t) for t in ("a", "b")}
        assert seen["a"] == seen["b"] == [(k, "first" if stop < 2 else "word 2") for k in (1, 2)], delete


def tiny(texts):
    return np.array([[len(x), 1.0] for x in texts], dtype=np.float32)


def table_of(spark, files):
    return spark.createDataFrame([(p, c, "python") for p, c in files.items()], "file_path string, content string, language string")


def run(spark, files, store, **options):
    return indexing.index_files(spark, table_of(spark, files), store, embedder=tiny, **options)


def test_work_grows_with_what_changed_and_a_killed_run_goes_on(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "s")
    files = {f"d/f{i}.py": f"import m{i}\ndef f{i}(a):\n    return a + {i}\n" + "# filler\n" * 300 for i in range(60)}
    done = run(spark, files, store)
    assert (done.new, done.chunks, done.batches) == (60, 60, 1)
    db = Store(spark, store)
    whole = db.snapshot()
    files["d/f3.py"] += "def g():\n    return 1\n"
    del files["d/f4.py"]
    done = run(spark, files, store)
    assert (done.changed, done.deleted, done.unchanged, done.chunks) == (1, 1, 58, 2)
    after = db.snapshot()
    for name in ("chunks", "nodes", "edges", "manifest"):
        fresh = set(after.folders(name)) - set(whole.folders(name))
        assert 1 <= len(fresh) <= 2 and db.size(list(fresh)) < 0.6 * db.size(after.folders(name))
    assert indexing.read(spark, store, "manifest", whole.version).count() == 60 and indexing.read(spark, store, "manifest").count() == 59
    assert run(spark, files, store).batches == 0 and db.snapshot().version == after.version

    files |= {f"e/n{i}.py": f"def n{i}():\n    return {i}\n" for i in range(12)}
    real, calls = postings.write_generation, []

    def dies(*args, **named):
        calls.append(1)
        if len(calls) == 2:
            raise Stopped
        return real(*args, **named)

    monkeypatch.setattr(postings, "write_generation", dies)
    with pytest.raises(Stopped):
        run(spark, files, store, batch_files=4)
    monkeypatch.undo()
    manifest = {r.file_path for r in indexing.read(spark, store, "manifest").collect()}
    chunks = {r.file_path for r in indexing.read(spark, store, "chunks").collect()}
    assert manifest == chunks and 59 < len(manifest) < 71
    done = run(spark, files, store, batch_files=4)
    assert done.new == 71 - len(manifest) and done.unchanged == len(manifest)
    assert {r.file_path for r in indexing.read(spark, store, "chunks").collect()} == set(files)
    kept = indexing.full_text(spark, db.snapshot())
    found = kept.phrase_search(spark.createDataFrame([(1, "def g"), (2, "def f4"), (3, "n7 return 7")], "query_id long, text string"), 5).collect()
    ids = {r.id: r.file_path for r in indexing.read(spark, store, "chunks").collect()}
    assert {(r.query_id, ids[r.id]) for r in found} == {(1, "d/f3.py"), (3, "e/n7.py")}


def test_edges_into_changed_files_go_wherever_they_start(spark, tmp_path):
    store = str(tmp_path / "s")
    files = {f"f{i}.py": f"def f{i}():\n    return {i}\n" for i in range(8)}
    run(spark, files, store)
    db = Store(spark, store)
    now = db.snapshot()
    extra = spark.createDataFrame([(f"file_f{i}.py", "file_f0.py", "calls") for i in range(1, 8)], indexing.SCHEMAS["edges"])
    db.publish(now, append={"edges": db.write("edges", extra, bucket_of(F.regexp_replace("source_id", "^file_", ""), now.facts["buckets"]))})
    assert indexing.read(spark, store, "edges").where("edge_type = 'calls'").count() == 7
    files["f0.py"] += "# more\n"
    run(spark, files, store)
    edges = indexing.read(spark, store, "edges")
    assert edges.where("edge_type = 'calls'").count() == 0 and edges.where("edge_type = 'defines'").count() == 8
    assert run(spark, files, store, full=True).changed == 8 and indexing.read(spark, store, "edges").count() == 8
    assert run(spark, {"f0.py": files["f0.py"] + "# 2\n"}, store, target="f0.py").deleted == 0
    assert indexing.read(spark, store, "manifest").count() == 8


def test_batches_of_a_run_are_few_and_embedding_is_dealt_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(indexing, "BATCH_FILES", 3)
    files = {f"d/f{i}.py": f"def f{i}(a):\n    return a\n" for i in range(40)}
    assert run(spark, files, str(tmp_path / "s")).batches <= indexing.MOST_BATCHES
    rows = spark.createDataFrame([(f"text {i}",) for i in range(64)], "content string")
    cache = spark.createDataFrame([], "content_hash string, embedding array<float>")
    out = embed.cached(rows, cache, "content", "s", tiny)
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString() and out.count() == 64


def test_a_batch_leaves_the_cache_before_the_next(spark, tmp_path, monkeypatch):
    frames, left, cached = [], [], embed.cached

    def kept(*a):
        left.extend(f for f in frames if f.storageLevel.useMemory)
        frames.append(cached(*a))
        return frames[-1]

    monkeypatch.setattr(embed, "cached", kept)
    files = {f"d/f{i}.py": f"def f{i}(a):\n    return a\n" for i in range(12)}
    assert run(spark, files, str(tmp_path / "s"), batch_files=3).batches == len(frames) > 1
    assert left == []


def test_texts_of_about_one_length_are_embedded_at_once(spark):
    def spans(batch):
        sizes = [len(x) for x in batch]
        return np.array([[min(sizes), max(sizes)] for _ in batch], dtype=np.float32)

    texts = ["x" * (k * 37 % 101 + 1) for k in range(101)]
    rows = spark.createDataFrame([(t,) for t in [*texts, ""]], "text string").coalesce(1)
    got = {x.text: x.embedding for x in embed.embedded(rows, "text", spans, batch=8).collect()}
    assert got.pop("") is None and all(least <= len(t) <= most < least + 8 for t, (least, most) in got.items())


def test_hashed_vectors_are_sums_word_by_word():
    r = random.Random(3)
    texts = [" ".join(f"w{r.randrange(50)}" for _ in range(r.choice((1, 2, 40, 300)))) for _ in range(100)] + ["", "  ", "A a"]
    for dimensions in (1, 5, 32, 70):
        want = np.zeros((len(texts), dimensions), dtype=np.float32)
        for k, text in enumerate(texts):
            for word in text.lower().split():
                want[k] += np.resize(np.frombuffer(hashlib.sha256(word.encode()).digest(), dtype=np.uint8), dimensions) / 255.0 - 0.5
        norm = np.linalg.norm(want, axis=1, keepdims=True)
        assert (embed.hashed_vectors(texts, dimensions) == want / np.where(norm > 0, norm, 1)).all()
    assert embed.hashed_vectors([]).shape == (0, embed.DIMENSIONS)
