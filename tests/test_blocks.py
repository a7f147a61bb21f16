import random

import pytest
from pyspark.sql import functions as F

from loomspan.operators import blocks, ledger, search
from loomspan.plans import search_plans, table_plans


def vectors_of(spark, n, seed=5, dim=6):
    r = random.Random(seed)
    own = [[r.choice((r.uniform(-1, 1), 0.0, 0.5, 1e-300, 1e150)) for _ in range(dim)] for _ in range(n)]
    own[3:9] = [own[2]] * 6  # copies: ties by id
    own[20] = [0.0] * dim
    own[21], own[22], own[23], own[24] = None, [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), [float("inf")] + [0.0] * (dim - 1)
    return spark.createDataFrame([(n - i, v, i % 3) for i, v in enumerate(own)], "id long, embedding array<double>, label int").repartition(3)


def by_pairs(queries, vectors, name, measure):
    return vectors.where("embedding is not null").crossJoin(queries).withColumn(name, measure(F.col("query"), F.col("embedding"))).drop("query", "embedding")


@pytest.mark.parametrize("k", [1, 4, 500])
def test_blocks_equal_pairs(spark, monkeypatch, k):
    monkeypatch.setattr(blocks, "VECTORS", 16)
    monkeypatch.setattr(blocks, "QUERIES", 5)
    monkeypatch.setattr(blocks, "PART_VALUES", 200)
    monkeypatch.setattr(blocks, "PAIRS", 7)
    own = vectors_of(spark, 90)
    q = own.where("id % 4 <> 1").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"), F.col("label").alias("query_label"))
    plain_q = q.where("query is not null and size(query) = 6 and query[0] is not null")
    rows = lambda df: sorted(map(repr, df.select(sorted(df.columns)).collect()))
    for asked in (plain_q, q.where("query is not null")):
        want = search.top(by_pairs(asked, own, "distance", search.l2), k, [F.col("distance"), F.col("id")])
        assert rows(search.knn(asked, own, k)) == rows(want)
    rounded = by_pairs(plain_q, own, "cosine", search.cosine).withColumn("cosine", F.round("cosine", 9)).where("cosine >= 0.1")
    want = search.top(rounded, k, [F.col("cosine").desc(), F.col("id")])
    assert rows(search.similar(plain_q, own, k, 0.1)) == rows(want)
    none = q.where("false")
    assert search.knn(none, own, k).count() == 0 and search.knn(plain_q, own.where("false"), k).count() == 0


def test_vector_queries_make_no_rows_of_pairs(spark):
    for f in (search_plans.cosine_rank_threshold, search_plans.knn_l2_topk, search_plans.knn_postfilter, search_plans.vector_max_distance, table_plans.precision_recall, table_plans.recall_at_k_mrr):
        plan = f(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "Join Cross" not in plan and "MapInArrow" in plan, f.__name__


def test_recall_of_marked_equals_recall_of_listed(spark):
    ranked = spark.createDataFrame([(1, 10, 0), (1, 11, 1), (1, 12, 2), (2, 10, 0)], "query_id long, id long, rank int")
    relevant = spark.createDataFrame([(1, 11), (1, 12), (1, 99), (3, 5)], "query_id long, id long")
    q = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "query_id long")
    marked = ranked.withColumn("good", F.expr("query_id = 1 and id > 10"))
    want = relevant.groupBy("query_id").agg(F.count("*").alias("want"))
    assert sorted(ledger.recall_of_marked(marked, want, q, 2).collect()) == sorted(ledger.recall_at_k(ranked, relevant, q, 2).collect())
    assert sorted(map(tuple, ledger.recall_at_k(ranked, relevant, q, 2).collect())) == [(1, 0.333333, 0.5, 0.5), (2, 0.0, 0.0, 0.0), (3, 0.0, 0.0, 0.0), (4, 1.0, 1.0, 1.0)]
