"""The LSH forest against brute force, its recall, and row ids that outlive another cut of the files."""

import random
import re
from itertools import cycle

import pytest
from pyspark.sql import functions as F

from loomspan.llm import decontaminate, exact_dedup, forest, line_dedup, near_dedup
from loomspan.llm.common import file_slots, settled, with_row_id

from .conftest import prose
from .test_dedup import brute_classes, near_docs


@pytest.mark.parametrize("node_rows, tasks", [(1_024, 1), (2, 1), (1_024, 40), (1, 40)])
def test_crowded_nodes_and_edges_of_tasks_lose_nothing(spark, monkeypatch, node_rows, tasks):
    """Nodes too large for comparing, and nodes cut by the range of a task, are met by longer and then shorter prefixes."""
    monkeypatch.setattr(forest, "NODE_ROWS", node_rows)
    rows = near_docs() + [(1_000 + i, " ".join(prose(7, 60).split()[: 60 - i % 4] + [f"end{i}"])) for i in range(40)]
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
    try:
        got = near_dedup.assign(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    classes, links = brute_classes(rows)
    assert {r.doc_id: r.class_id for r in got} == classes and {r.doc_id: r.n_links for r in got} == links


def test_recall_at_the_threshold(spark):
    """Of 1,500 pairs at 0.80 to 0.84 among 10,000 texts, nearly all are linked."""
    r, rows, pairs = random.Random(12), [], []
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    while len(pairs) < 1_500:
        a = prose(10_000 + r.randrange(1 << 40), r.randrange(50, 120)).split()
        b = list(a)
        while len(grams(a) & grams(b)) > 0.84 * len(grams(a) | grams(b)):
            b[r.randrange(len(b))] = f"new{r.randrange(999)}"
        if len(grams(a) & grams(b)) >= 0.8 * len(grams(a) | grams(b)):
            k = len(rows)
            rows += [(k, " ".join(a)), (k + 1, " ".join(b))]
            pairs.append((k, k + 1))
    rows += [(k, prose(k, r.randrange(20, 80))) for k in range(len(rows), 10_000)]
    got = {x.doc_id: x.class_id for x in near_dedup.assign(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.999 * len(pairs)
    assert all(got[k] == k for k, _ in rows[3_000:])


def test_prefixes_shorten_until_the_recall(spark):
    """Rows of one crowd are connected although no node may be compared, and rows far from any other stay apart."""
    base = prose(1, 80).split()
    rows = [(i, " ".join(f"own{i}x{k}" if k % 79 == i % 79 else w for k, w in enumerate(base))) for i in range(60)] + [(100 + i, prose(300 + i, 60)) for i in range(60)]
    signed = spark.createDataFrame(rows, "__rid long, text string").select(F.col("__rid").alias("doc_id"), "__rid", "text")
    signed = signed.mapInArrow(near_dedup._signed, "doc_id bigint, __rid bigint, set_key binary, n int, labels array<binary>, s0 bigint, s1 bigint")
    edges = [(x.a, x.b) for x in forest.candidates(signed.select("__rid", "labels", "s0", "s1"), node_rows=1).collect()]
    assert all(a < 100 and b < 100 for a, b in edges)
    up = {i: i for i in range(60)}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[root(a)] = root(b)
    assert len({root(x) for x in up}) == 1


def test_file_slots_are_distinct():
    assert file_slots([f"file:/t/part-{i}" for i in range(5_000)]) == {}


@pytest.fixture
def cuts(spark, monkeypatch):
    """Cuts the files anew after every staged table, as a cluster that grows or shrinks does."""
    from loomspan.llm import common, components

    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.leafNodeDefaultParallelism")
    sizes = cycle([("20000", "3"), ("128m", "8"), ("60000", "2")])
    whole = common.staged

    def staged(df, tag):
        out = whole(df, tag)
        for key, value in zip(keys, next(sizes)):
            spark.conf.set(key, value)
        return out

    for module in (common, components, exact_dedup, forest, near_dedup, line_dedup, decontaminate):
        if hasattr(module, "staged"):
            monkeypatch.setattr(module, "staged", staged)
    yield
    for key in keys:
        spark.conf.unset(key)


def test_row_ids_outlive_another_cut_of_the_files(spark, cuts, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs.unionByName(docs.limit(300)).repartition(5).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    ids = with_row_id(settled(docs))
    assert ids.select("__rid").distinct().count() == docs.count()
    normal = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x or "")
    texts = [r.text for r in docs.collect()]
    kept = exact_dedup.keep_first(docs).collect()
    assert len(kept) == len({normal(x) for x in texts}) == len({normal(r.text) for r in kept})
    near = near_dedup.assign(docs).collect()
    one = near_dedup.keep_one(docs).collect()
    assert sorted(r.doc_id for r in one) == sorted({r.class_id for r in near})
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    leaks = {r.doc_id for r in decontaminate.matches(docs, items).collect()}
    assert sorted(r.doc_id for r in decontaminate.clean(docs, items).collect()) == sorted(r.doc_id for r in docs.collect() if r.doc_id not in leaks) and leaks
    dropped = {(r.doc_id, len(r.dropped)) for r in line_dedup.assign(docs).collect()}
    lines = line_dedup.cleaned(docs)
    assert lines.count() == len(texts) and sum(n for _, n in dropped) > 0
    left = sum(len([x for x in (r.text or "").split("\n") if x.strip()]) for r in lines.collect())
    assert left == sum(r.n_kept for r in line_dedup.assign(docs).collect())
