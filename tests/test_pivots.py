"""Pruned nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.operators import pivots


def frame(spark, x, name, vector, extra=()):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)] + list(extra), f"{name} long, {vector} array<double>").repartition(3)


@pytest.mark.parametrize("clouds, spread, block", [(40, 0.05, 64), (1, 1.0, 512)])
def test_pruned_equals_brute_force(spark, clouds, spread, block):
    r = np.random.default_rng(clouds)
    x = r.normal(size=(clouds, 12))[r.integers(clouds, size=3000)] + spread * r.normal(size=(3000, 12))
    x[100:140] = x[100]  # ties
    q = np.concatenate([x[:60], x[100:101], r.normal(size=(39, 12))])
    found = pivots.knn(frame(spark, q, "query_id", "query"), frame(spark, x, "id", "embedding", [(9000, None)]), 10, block=block).collect()
    d = np.sqrt(np.cumsum((q[:, None] - x[None]) ** 2, axis=2)[:, :, -1])
    want = [(i, int(k), n, float(d[i, k])) for i in range(len(q)) for n, k in enumerate(np.lexsort((np.arange(len(x)), d[i]))[:10])]
    assert sorted((r.query_id, r.id, r["rank"], r.distance) for r in found) == sorted(want)
    share = sum({r.query_id: r.computed for r in found}.values()) / (len(q) * len(x))
    print("share of distances", round(share, 3))
    assert share < 0.5 if clouds > 1 else share <= 1


def test_odd_cases(spark):
    none = spark.createDataFrame([], "query_id long, query array<double>")
    few = frame(spark, np.array([[0.0, 1.0], [0.0, 1.0]]), "id", "embedding")
    assert pivots.knn(none, few, 3).count() == 0
    one = frame(spark, np.array([[0.0, 0.0]]), "query_id", "query", [(7, None)])
    assert [(r.id, r["rank"], r.distance) for r in pivots.knn(one, few, 3).orderBy("rank").collect()] == [(0, 0, 1.0), (1, 1, 1.0)]
    assert pivots.knn(one, few.where("id > 5"), 3).count() == 0
    assert pivots.knn(one, few.withColumn("embedding", F.lit(None).cast("array<double>")), 3).count() == 0
