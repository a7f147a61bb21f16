import random

from pyspark.sql import functions as F

from loomspan.operators import phrases, postings, search


def plainly(docs, queries):
    """(query_id, id, n_hits) by reading."""
    out = set()
    for q, text in queries:
        want = (text or "").split()
        for i, content in docs:
            words = (content or "").split()
            n = sum(words[k : k + len(want)] == want for k in range(len(words) - len(want) + 1)) if want else 0
            out |= {(q, i, n)} if n else set()
    return out


def test_phrases_equal_reading(spark, tmp_path, monkeypatch):
    r = random.Random(8)
    docs = [(i, " ".join(r.choice("abcd") for _ in range(r.choice((0, 1, 2, 5, 40))))) for i in range(60)] + [(60, None), (61, "a a a a")]
    queries = [(i, " ".join(r.choice("abcd") for _ in range(r.choice((1, 2, 3, 5))))) for i in range(25)] + [(30, None), (31, "a a"), (32, "a a"), (33, "e a"), (34, "")]
    d, q = spark.createDataFrame(docs, "id long, content string").repartition(3), spark.createDataFrame(queries, "query_id long, text string")
    store, want = str(tmp_path / "i"), plainly(docs, queries)
    postings.build(d, store)
    monkeypatch.setattr(phrases, "DOCS", 7)
    rows = lambda df: {(x.query_id, x.id, x.n_hits) for x in df.collect()}
    direct, kept = search.phrase_search(q, d, 100), postings.phrase_search(q, store, 100)
    assert rows(direct) == want and rows(kept) == want
    key = lambda df: sorted((x.query_id, x["rank"], x.id, round(x.score, 9)) for x in df.collect())
    assert key(direct) == key(kept)
    monkeypatch.setattr(phrases, "MOST_PHRASES", 3)  # all windows are rows
    monkeypatch.setattr(search, "QUERY_TERMS", 2)
    assert rows(search.phrase_search(q, d, 100)) == want and rows(postings.phrase_search(q, store, 100)) == want


def test_many_queries_for_one_phrase_do_not_multiply_what_is_found(spark):
    docs = spark.range(200).select("id", F.lit("one two three four").alias("content"))
    queries = spark.range(40).select(F.col("id").alias("query_id"), F.lit("two three").alias("text"))
    assert phrases.in_words(docs.select("id", F.split("content", " ").alias("words")), phrases.asked_phrases(queries)).count() == 200
    assert search.phrase_search(queries, docs, 5).groupBy("query_id").count().where("count = 5").count() == 40


def test_scores_of_phrases_are_rounded_to_nine_digits_before_six(spark):
    found = spark.createDataFrame([("a b", i, 7 + i, 1) for i in range(400)], "phrase string, id long, length long, n_hits long")
    whole, asked = spark.createDataFrame([(10_000.0, 300.0)], "n double, mean_length double"), spark.createDataFrame([(1, "a b")], "query_id long, phrase string")
    assert all(r.score == round(r.score, 9) for r in search.ranked_by_phrases(asked, found, whole, 400).collect())


def test_postings_are_counted_without_a_shuffle_of_terms(spark):
    docs = spark.createDataFrame([(1, "b a b"), (2, None), (3, ""), (4, "c")], "id long, content string")
    rows = lambda df: sorted((r.id, r.term, r.tf, r.length) for r in df.collect())
    assert rows(search.postings(docs)) == [(1, "a", 1, 3), (1, "b", 2, 3), (4, "c", 1, 1)]
    assert "Exchange" not in search.postings(docs)._jdf.queryExecution().executedPlan().toString()
    assert rows(search.postings(docs.unionByName(docs))) == [(1, "a", 2, 3), (1, "b", 4, 3), (4, "c", 2, 1)]
