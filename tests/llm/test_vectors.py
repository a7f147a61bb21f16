"""Clustering and nearest neighbours against brute force."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspan.llm.clustering import clustered, op12_dual_tree_lloyd, whole
from loomspan.llm import neighbours
from loomspan.llm.cover_tree import BASE, Centroids, Tree, nearest, squared

from .conftest import SF


def plain(x, c):
    """Nearest centroid by definition, in Python's whole numbers."""
    d = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q)) for q in c] for p in x]
    return [min(range(len(c)), key=lambda k: (row[k], k)) for row in d], d


def clouds(seed, n, dim, spread=40, scale=1000):
    r = np.random.default_rng(seed)
    return np.rint(r.normal(size=(7, dim))[r.integers(7, size=n)] * scale + r.normal(size=(n, dim)) * spread).astype(np.int64)


@pytest.mark.parametrize("dim, spread", [(2, 40), (5, 400), (20, 3000)])
def test_cover_tree_holds_its_invariants(dim, spread):
    x = np.r_[clouds(1, 500, dim, spread), clouds(1, 500, dim, spread)[:60]]
    t = Tree.over(x, 3)
    assert (t.points[t.order] == x).all() and t.high[0] == len(t.points) == len(np.unique(x, axis=0))
    d = np.sqrt(squared(t.points, t.points))
    for v in range(len(t.center)):
        c, held = t.center[v], np.arange(t.low[v], t.high[v])
        assert c in held and d[c, held].max() == t.radius[v]
        if not t.kids[v]:
            assert len(held) <= 3
            continue
        kids = np.arange(t.child[v], t.child[v] + t.kids[v])
        s = BASE ** (math.ceil(math.log(t.radius[v], BASE)) - 1)
        assert c in t.center[kids] and (t.radius[kids] <= s * (1 + 1e-9)).all()
        assert np.concatenate([np.arange(t.low[k], t.high[k]) for k in kids]).tolist() == held.tolist()
        apart = d[np.ix_(t.center[kids], t.center[kids])] + np.where(np.eye(len(kids)), np.inf, 0)
        assert apart.min() > s * (1 - 1e-9)
    u = Tree.unpacked(**t.packed(), dim=dim)
    assert all((getattr(u, f) == getattr(t, f)).all() for f in ("points", "order", "center", "low", "high", "radius", "child", "kids"))


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 60), st.integers(1, 12), st.integers(1, 4), st.sampled_from([1, 3, 50, 1 << 24]))
def test_nearest_equals_the_definition(seed, n, k, dim, most):
    r = np.random.default_rng(seed)
    x, c = r.integers(-most, most + 1, size=(n, dim)), r.integers(-most, most + 1, size=(k, dim))
    t = Tree.over(x, int(r.integers(1, 5)))
    found, _ = nearest(t, Centroids.of(c))
    assert found[t.order].tolist() == plain(x, c)[0]


def test_bounds_spare_most_distances_where_there_are_clouds():
    x, c = clouds(5, 4000, 8), clouds(6, 64, 8)
    t = Tree.over(x, 8)
    found, done = nearest(t, Centroids.of(c))
    assert (found[t.order] == squared(x, c).argmin(1)).all() and done < 0.5 * len(x) * len(c)


def test_too_large_components_are_an_error():
    with pytest.raises(ValueError, match="too large"):
        squared(np.full((1, 64), 1 << 40), np.zeros((1, 64), dtype=np.int64))


def test_query_equals_plain_lloyd(spark):
    rows = {r.vec_id: r for r in op12_dual_tree_lloyd(spark, SF).collect()}
    x = {r.id: r.x for r in whole(spark.read.parquet(f"{SF}/embeddings.parquet"), "vec_id", "embedding", 64, 1024).collect()}
    import hashlib

    ids = sorted(x)
    a = np.array([x[i] for i in ids])
    c = np.array([x[i] for i in sorted(x, key=lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest())[:8]])
    for _ in range(10):
        d = ((a[:, None] - c[None]) ** 2).sum(2)
        own = d.argmin(1)
        c = np.array([a[own == k].sum(0) // (own == k).sum() if (own == k).any() else c[k] for k in range(8)])
    d = ((a[:, None] - c[None]) ** 2).sum(2)
    own, least = d.argmin(1), d.min(1)
    assert set(rows) == set(ids)
    for i, k, m in zip(ids, own, least):
        r = rows[i]
        assert (r.cluster, r.distance, r.cluster_inertia, r.inertia) == (k, m, least[own == k].sum(), least.sum())
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, c[k].tolist())).encode()).hexdigest()


def embeddings(spark, path, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("own")).withColumn("x", F.lit("own")).withColumn("cluster", F.lit(1)).withColumn("score", F.lit("own"))
    df.repartition(2).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def odd_rows(seed=4):
    r = np.random.default_rng(seed)
    one = r.normal(size=64)
    vectors = [one, *r.normal(size=(90, 64)), *[one] * 30]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(vectors)]
    bad = [None, [], [1.0] * 63, [1.0] * 63 + [None], [1.0] * 63 + [float("nan")], [float("inf")] + [1.0] * 63]
    return rows + [(200 + 20 * i, v) for i, v in enumerate(bad)] + [(None, rows[3][1]), rows[5], rows[40], (400, [0.0] * 64)]


def test_clusters_of_odd_tables(spark, tmp_path):
    rows = op12_dual_tree_lloyd(spark, embeddings(spark, tmp_path / "odd", odd_rows())).collect()
    assert len(rows) == 91 + 30 + 4 and sum(r.vec_id is None for r in rows) == 1 and len({r.inertia for r in rows}) == 1
    assert len({(r.cluster, r.distance) for r in rows if r.vec_id == 0 or r.vec_id in range(91, 121)}) == 1
    assert op12_dual_tree_lloyd(spark, embeddings(spark, tmp_path / "none", [(1, None)])).collect() == []
    few = op12_dual_tree_lloyd(spark, embeddings(spark, tmp_path / "few", odd_rows()[:3])).collect()
    assert sorted(r.cluster for r in few) == [0, 1, 2] and {r.distance for r in few} == {0}


def test_empty_centroids_stay_and_ties_go_to_the_smaller(spark):
    vectors = spark.createDataFrame([(i, [3, 0]) for i in range(50)], "id long, x array<long>").repartition(3)
    starts = np.array([[0, 0], [0, 0], [90, 90], [4, 0], [2, 0]])
    found, last = clustered(vectors, starts, 4)
    assert last.tolist() == [[0, 0], [0, 0], [90, 90], [3, 0], [2, 0]]
    assert {(r.cluster, r.distance) for r in found.collect()} == {(3, 0)} and found.count() == 50


def by_force(rows, k=20):
    """(query, rank, id, score) by definition."""
    good = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    found = []
    for q in sorted({i for i, _ in good if i is not None and i % 20 == 0}):
        x = min(v.tolist() for i, v in good if i == q)
        scores = [(-round(sum(a * b for a, b in zip(x, v.tolist())), 9), i is None, i or 0) for i, v in good if i != q and len(v) == len(x)]
        found += [(q, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return found


def test_neighbours_of_odd_tables(spark, tmp_path):
    rows = [*odd_rows(), (600, [1.0, 2.0]), (601, [3.0, -1.0]), (602, [3.0, -1.0])]
    got = neighbours.op13_rotated_codes(spark, embeddings(spark, tmp_path / "odd", rows)).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got) == by_force(rows)
    assert neighbours.op13_rotated_codes(spark, embeddings(spark, tmp_path / "none", [(20, None)])).count() == 0
    few = embeddings(spark, tmp_path / "few", odd_rows()[:3])
    assert [(r["rank"], r.vec_id) for r in neighbours.op13_rotated_codes(spark, few).orderBy("rank").collect()] == [(r, i) for _, r, i, _ in by_force(odd_rows()[:3])]


@pytest.mark.parametrize("dim, wide", [(64, 0.0), (64, 3.0), (100, 1.0), (384, 0.5)])
def test_recall_and_bounds(dim, wide):
    """Recall of at least 0.99 with a fraction of the pairs reranked; nearly all errors are below the bounds."""
    r = np.random.default_rng(dim)
    x = r.normal(size=(20_000, dim)) + wide * r.normal(size=(12, dim))[r.integers(12, size=20_000)]
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids, asked, centre = np.arange(len(x)), np.arange(0, len(x), 100), x[:4096].mean(0)
    q = neighbours.Queries(ids[asked], x[asked], centre, 20)
    reranked = 0
    for a in range(0, len(x), neighbours.ROWS):
        part = slice(a, a + neighbours.ROWS)
        reranked += q.offer(ids[part], np.zeros(len(ids[part]), dtype=bool), x[part], *neighbours.encode(x[part], centre))
    exact = x[asked] @ x.T
    exact[np.arange(len(asked)), asked] = -np.inf
    best = np.argpartition(-exact, 20, axis=1)[:, :20]
    hits = sum(len(set(a) & set(b)) for a, b in zip(best.tolist(), q.found.tolist()))
    assert hits >= 0.99 * 20 * len(asked) and reranked < 0.5 * len(asked) * len(x)
    near, bound = q.estimates(slice(0, 128), *neighbours.encode(x[:5000], centre))
    error = np.abs(near - x[asked[:128]] @ x[:5000].T)
    assert (error <= bound).mean() > 0.999 and abs((near - x[asked[:128]] @ x[:5000].T).mean()) < 0.01
