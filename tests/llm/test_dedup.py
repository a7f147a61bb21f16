"""Exact, near and line deduplication against brute force."""

import random
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspan.llm import exact_dedup, line_dedup, near_dedup
from loomspan.llm.components import connected_components

from .conftest import prose


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 60)), max_size=300))
def test_cuckoo_index_is_a_set(steps):
    index, live = exact_dedup.CuckooIndex(4), {}
    for add, x in steps:
        key = x.to_bytes(32, "big")[::-1]
        if add:
            assert index.insert(key, x) == (x not in live)
            live[x] = key
        else:
            assert index.delete(key) == (x in live)
            live.pop(x, None)
    assert index.size == len(live) and {r for _, r in index.items()} == set(live)


def test_cuckoo_index_survives_equal_fingerprints():
    """Keys of one bucket and fingerprint are told apart by their stored content, and an overflow doubles the index."""
    index = exact_dedup.CuckooIndex(4)
    keys = [random.Random(i).randbytes(32) for i in range(3_000)]
    assert all(index.insert(k, i) for i, k in enumerate(keys)) and index.resizes > 3
    assert all(index.get(k) == i for i, k in enumerate(keys))
    alike = [k[:6] + k[6:8] + bytes([i]) * 24 for i, k in enumerate([keys[0]] * 6)]
    assert all(index.insert(k, "x") for k in alike[:3]) and index.false_hits >= 3


def test_exact_dedup_of_odd_rows(spark, odd_docs):
    got = exact_dedup.assign(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = defaultdict(list)
    for r in got:
        by[r.digest].append(r)
    sizes = sorted(len(v) for v in by.values())
    assert sizes == [1] * 5 + [2, 3] and all(sum(r.kept for r in v) == 1 and {r.group_size for r in v} == {len(v)} for v in by.values())
    assert {r.keep_id for r in got if r.doc_id in (1, 2)} == {1} and {r.keep_id for r in got if r.doc_id in (5, 6)} == {5}
    kept = exact_dedup.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == 7


def test_exact_index_updates(spark):
    key = lambda x: F.unhex(F.sha2(F.lit(x), 256))
    row = lambda x, i: spark.range(1).select(key(x).alias("digest"), F.lit(i).cast("bigint").alias("keep_id"), F.lit(i).cast("bigint").alias("keep_rid"), F.lit(1).cast("bigint").alias("group_size"))
    live = row("a", 1).unionByName(row("b", 2))
    out = exact_dedup.update(live, row("a", 9).unionByName(row("c", 3)), row("b", 0).select("digest").unionByName(row("zz", 0).select("digest")))
    assert sorted((r.keep_id, r.group_size) for r in out.collect()) == [(1, 2), (3, 1)]


def near_docs():
    rows, r = [], random.Random(3)
    for base in range(12):
        words = prose(base, r.randrange(40, 120)).split()
        rows.append(" ".join(words))
        for _ in range(r.randrange(0, 6)):
            own = list(words)
            for _ in range(r.randrange(1, 4)):
                own[r.randrange(len(own))] = f"new{r.randrange(99)}"
            rows.append(" ".join(own).upper() if r.random() < 0.3 else ", ".join(own))
    rows += [rows[0]] * 5 + ["one two three", "One, two; three!", "one two four", "", "...", "..."]
    r.shuffle(rows)
    return list(enumerate(rows))


def brute_classes(rows, similarity=0.8):
    words = {d: re.findall(r"[0-9a-z\u0080-\U0010ffff]+", x.lower()) for d, x in rows}
    sets = {d: frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else x for (d, x), w in zip(rows, words.values())}
    near = defaultdict(set)
    for a in sets:
        for b in sets:
            if a != b and (sets[a] == sets[b] or (words[a] and words[b] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]))):
                near[a].add(b)
    classes = {}
    for d in sets:
        seen, todo = {d}, [d]
        while todo:
            for e in near[todo.pop()] - seen:
                seen.add(e)
                todo.append(e)
        classes[d] = min(seen)
    return classes, {d: len({sets[e] for e in near[d]} - {sets[d]}) for d in sets}


@pytest.mark.parametrize("block", [1_000, 2])
def test_near_dedup_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK_TEXTS", block)  # small blocks deal one component out to many units
    rows = near_docs()
    classes, links = brute_classes(rows)
    got = near_dedup.assign(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: r.class_id for r in got} == classes
    assert {r.doc_id: r.n_links for r in got} == links
    assert len(set(classes.values())) < len(rows) - 10


def test_near_dedup_of_odd_rows(spark, odd_docs, no_docs):
    got = near_dedup.assign(odd_docs).collect()
    assert len(got) == odd_docs.count() and {r.class_id for r in got if r.doc_id in (1, 2)} == {1}
    kept = near_dedup.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == 7
    assert near_dedup.assign(no_docs).count() == 0 and exact_dedup.assign(no_docs).count() == 0


def test_prefix_is_shortened_to_the_recall():
    assert near_dedup.prefix_length() == 5
    assert near_dedup.prefix_length(recall=0.9) == 8
    with pytest.raises(ValueError):
        near_dedup.prefix_length(similarity=0.01)


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(6)
    got = {x.node: x.component for x in connected_components(df).collect()}
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    assert got == {x: root(x) for x in up if any(x in e and e[0] != e[1] for e in edges)}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.text("ab", max_size=12), st.text("ab", max_size=12), st.integers(0, 4))
def test_banded_distance(a, b, k):
    assert line_dedup.within(a, b, k) == (distance(a, b) <= k)


def lines_table():
    r, rows = random.Random(5), []
    bases = [prose(50 + i, r.randrange(3, 14)) for i in range(15)]
    for d in range(40):
        own = []
        for _ in range(r.randrange(1, 6)):
            x = list(r.choice(bases))
            for _ in range(r.choice((0, 0, 1, 2, 3))):
                at = r.randrange(len(x))
                x[at : at + r.choice((0, 1))] = r.choice(("", "q", "z"))
            own.append("  " + "".join(x) if r.random() < 0.3 else "".join(x))
        rows.append((d, "\n".join([*own, "", "short", "shorp"])))
    return rows


@pytest.mark.parametrize("block", [2_000, 3])
def test_line_dedup_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(line_dedup, "BLOCK_LINES", block)
    rows = lines_table()
    places = [(d, i, " ".join(x.split())) for d, t in rows for i, x in enumerate(t.split("\n")) if x.strip()]
    distinct = sorted({x for *_, x in places})
    near = {x: {y for y in distinct if y != x and min(len(x), len(y)) >= line_dedup.MIN_CHARS and distance(x, y) <= 2} for x in distinct}
    klass = {}
    for x in distinct:
        seen, todo = {x}, [x]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        klass[x] = min(seen)
    first, dropped, changed = {}, defaultdict(list), Counter()
    for d, i, x in places:
        if klass[x] in first:
            dropped[d].append(i)
            changed[d] += first[klass[x]] != x
        else:
            first[klass[x]] = x
    got = line_dedup.assign(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: list(r.dropped) for r in got} == {d: dropped[d] for d, _ in rows}
    assert {r.doc_id: r.n_near for r in got} == {d: changed[d] for d, _ in rows} and sum(changed.values()) > 10


def test_line_dedup_of_odd_rows(spark, odd_docs, no_docs):
    out = line_dedup.cleaned(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    texts = [r.text for r in out.where("doc_id in (1, 2)").collect()]
    assert sorted(texts) == ["", "", "same text here for all of us"]
    assert line_dedup.assign(no_docs).count() == 0


@pytest.mark.parametrize("tile", [2_048, 16])
def test_hot_segments_meet_in_tiles(spark, monkeypatch, tile):
    """Hundreds of lines with the same first half: every pair of tiles meets, and links are those of brute force."""
    monkeypatch.setattr(line_dedup, "SAMPLED", 1)
    monkeypatch.setattr(line_dedup, "TILE_ROWS", tile)
    r = random.Random(9)
    lines = [f"the same words open each of these lines {r.choice('abcdefgh') * 3}{r.randrange(100, 999)}{r.choice('xyz') * r.randrange(3)}" for _ in range(300)]
    rows = [(d, "\n".join(lines[d * 5 : d * 5 + 5])) for d in range(60)]
    distinct = sorted(set(lines))
    near = {x: {y for y in distinct if y != x and distance(x, y) <= 2} for x in distinct}
    got = line_dedup.assign(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {x.doc_id: x.n_links for x in got} == {d: sum(len(near[x]) for x in t.split("\n") if near[x] or lines.count(x) > 1) for d, t in rows}
    klass, left = {}, set(distinct)
    while left:
        todo = [min(left)]
        head = todo[0]
        while todo:
            x = todo.pop()
            if x in left:
                left.discard(x)
                klass[x] = head
                todo += near[x]
    assert sum(x.n_kept for x in got) == len(set(klass.values()))
    keys = line_dedup.tiled(line_dedup.with_row_id(line_dedup.settled(spark.createDataFrame(rows, "doc_id long, text string"))))
    assert keys.groupBy("key").count().agg(F.max("count")).first()[0] < (300 * 13 if tile > 300 else 200)
