"""The kept index against searches over the documents themselves."""

import pyarrow as pa
from pyspark.sql import functions as F

from loomspan.operators import postings, search

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((r.query_id, r.id, round(r.score, 6), r["rank"]) for r in df.collect())


def test_kept_index_equals_search_over_documents(spark, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    queries = spark.read.parquet(f"{SF}/benchmark.parquet").where("item_id % 5 = 0").select(F.col("item_id").alias("query_id"), "text")
    store, old = str(tmp_path / "index"), docs.where("id % 3 <> 0")
    postings.build(old, store)
    assert rows(postings.search(queries, store, 20)) == rows(search.or_search(queries, old, 20))
    changed = docs.where("id % 3 = 0 or id % 10 = 1").withColumn("content", F.when(F.col("id") % 10 == 1, F.concat("content", F.lit(" the the end"))).otherwise(F.col("content")))
    gone = docs.where("id % 7 = 2 and id % 10 <> 1 and id % 3 <> 0").select("id")
    postings.update(changed, gone, store)
    now = old.join(gone, "id", "left_anti").join(changed.select("id"), "id", "left_anti").unionByName(changed)
    want = rows(search.or_search(queries, now, 20))
    assert rows(postings.search(queries, store, 20)) == want
    monkeypatch.setattr(search, "QUERY_TERMS", 3)  # many terms are met by a join
    assert rows(postings.search(queries, store, 20)) == want
    monkeypatch.undo()
    postings.compact(spark, store, str(tmp_path / "small"))
    assert rows(postings.search(queries, str(tmp_path / "small"), 20)) == want
    plan = postings.read(spark, store, spark.createDataFrame([("the",)], "term string"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_index_of_nulls_and_nothing(spark, tmp_path):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b a")], "id long, content string")
    postings.build(docs, str(tmp_path / "i"))
    assert postings.live(spark, str(tmp_path / "i")).count() == 3
    queries = spark.createDataFrame([(1, "a c"), (2, None)], "query_id long, text string")
    assert [(r.query_id, r.id) for r in postings.search(queries, str(tmp_path / "i"), 5).collect()] == [(1, 3)]
    postings.build(docs.limit(0), str(tmp_path / "e"))
    assert postings.search(queries, str(tmp_path / "e"), 5).count() == 0


def test_words_are_taken_in_parts_of_bounded_size(monkeypatch):
    monkeypatch.setattr(postings, "PART_WORDS", 10)
    lists = [["a"] * n for n in (3, 7, 1, 25, 4, 4, 4, 10, 11)]
    whole = pa.record_batch([pa.array(range(len(lists))), pa.array(lists)], names=["id", "words"])
    parts = list(postings._parts(whole.slice(0, 4))) + list(postings._parts(whole.slice(4)))
    assert [p.column("id").to_pylist() for p in parts] == [[0, 1], [2], [3], [4, 5], [6], [7], [8]]
    assert [x for p in parts for x in p.column("words").to_pylist()] == lists


def test_null_texts_do_not_count_in_the_mean_length(spark, tmp_path):
    docs = spark.createDataFrame([(1, None), (2, "a b c d"), (3, "a b"), (4, None), (5, "")], "id long, content string")
    whole = search.collection(docs).first()
    assert (whole.n, whole.mean_length) == (5, 2)
    store = str(tmp_path / "i")
    postings.build(docs, store)
    assert tuple(postings.kept(spark, store).whole().first()) == (5, 2)
    postings.update(spark.createDataFrame([(1, "a"), (2, None)], "id long, content string"), spark.createDataFrame([(4,)], "id long"), store)
    assert tuple(postings.kept(spark, store).whole().first()) == (4, 1)  # 1, 3 and 5 have texts
    postings.compact(spark, store, str(tmp_path / "c"))
    assert tuple(postings.kept(spark, str(tmp_path / "c")).whole().first()) == (4, 1)
