"""Vector and full-text search over a table of queries, fusion, ranking and packing.

Every operator takes all queries at once and returns (query_id, ...) rows. The query side is the small one: it
is broadcast only if its counted rows stay under ``QUERY_ROWS``, else it is dealt out like any table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SETTINGS, Settings
from ..functions import scoring
from ..functions.text import index_terms
from . import blocks, phrases

QUERY_ROWS = 10_000
#: So many different terms of queries are told to the tasks as a set, by which words are filtered before they become rows.
QUERY_TERMS = 5_000


def small(df: DataFrame, most: int = QUERY_ROWS) -> DataFrame:
    """A broadcast hint for a table that a bounded count shows to be small."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def small_as(df: DataFrame, like: DataFrame, most: int = QUERY_ROWS) -> DataFrame:
    """A broadcast hint for a table that has a few rows at most for each row of ``like``, which is cheaper to count."""
    return F.broadcast(df) if like.limit(most + 1).count() <= most else df


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance in double, summed in array order."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector or different lengths."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), 0.0).otherwise(dot(a, b) / F.when(norm == 0, 1.0).otherwise(norm))


def top(df: DataFrame, k: int, order, by: str | list[str] = "query_id", rank: str = "rank") -> DataFrame:
    """The first k rows of each group, with their rank from 0; Spark limits groups before the shuffle."""
    w = Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w) - 1).where(F.col(rank) < k)


def knn(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "l2", where: Column | None = None) -> DataFrame:
    """(query_id, id, distance, rank, ...) of the k nearest; queries (query_id, query), vectors (id, embedding, ...).

    ``where`` is tested before ranking, on columns of both sides. Null vectors are nobody's neighbour.
    """
    own = vectors.where("embedding is not null")
    if metric == "l2" and where is None:
        return top(by_blocks(queries, own, k, "distance", l2), k, [F.col("distance"), F.col("id")])
    measure = l2(F.col("query"), F.col("embedding")) if metric == "l2" else 1 - cosine(F.col("query"), F.col("embedding"))
    pairs = own.join(small(queries), F.lit(True) if where is None else where)
    return top(pairs.withColumn("distance", measure).drop("query", "embedding"), k, [F.col("distance"), F.col("id")])


def by_blocks(queries: DataFrame, vectors: DataFrame, k: int, name: str, measure: Callable[[Column, Column], Column], least: float | None = None) -> DataFrame:
    """Pairs with their measure that hold the k best of each query, from blocks; vectors and queries that are not plain meet one by one."""
    sizes = queries.select(F.size("query").alias("dim")).where(F.forall("query", lambda c: c.isNotNull())).where("dim > 0").first()
    dim = sizes["dim"] if sizes else 0
    regular = lambda name: blocks.plain(F.col(name), dim) if dim else F.lit(False)
    odd_q, odd_v = queries.where(~regular("query")), vectors.where(~regular("embedding"))
    plainly = lambda q, v: v.join(small(q)).withColumn(name, measure(F.col("query"), F.col("embedding"))).drop("query", "embedding")
    plain_q, plain_v = queries.where(regular("query")), vectors.where(regular("embedding"))
    out = blocks.nearest(plain_q, plain_v, k, max(dim, 1), name, least)
    if not odd_v.isEmpty():
        out = out.unionByName(plainly(plain_q, odd_v))
    return out if odd_q.isEmpty() else out.unionByName(plainly(odd_q, vectors))


def similar(queries: DataFrame, vectors: DataFrame, k: int, least: float) -> DataFrame:
    """(query_id, id, cosine, rank, ...) of the k greatest cosines from ``least`` on, compared by nine digits."""
    pairs = by_blocks(queries, vectors, k, "cosine", cosine, least).withColumn("cosine", F.round("cosine", blocks.DIGITS)).where(F.col("cosine") >= least)
    return top(pairs, k, [F.col("cosine").desc(), F.col("id")])


def knn_postfiltered(queries: DataFrame, vectors: DataFrame, k: int, where: Column) -> DataFrame:
    """The filter sees only the 3k nearest, so fewer than k rows may be left."""
    near = knn(queries, vectors, 3 * k).drop("rank").where(where)
    return top(near, k, [F.col("distance"), F.col("id")])


def centroids(vectors: DataFrame, by: str) -> DataFrame:
    """(by, dim, value): the mean vector of each group."""
    return vectors.select(by, F.posexplode("embedding").alias("dim", "x")).groupBy(by, "dim").agg(F.avg(F.col("x").cast("double")).alias("value"))


def _few(terms: DataFrame | None) -> list[str] | None:
    """The distinct ``terms`` (term), if they are few enough to be told to every task."""
    some = [r[0] for r in terms.distinct().limit(QUERY_TERMS + 1).collect()] if terms is not None else []
    return some if terms is not None and len(some) <= QUERY_TERMS else None


def postings(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(id, term, tf, length): counts of terms, of those of ``terms`` (term) only if given.

    Terms of queries are filtered inside each document's array, before rows multiply. A document's terms are counted where its text
    is read; only if an id comes twice are counts shuffled.
    """
    words = docs.select("id", index_terms(F.col("content")).alias("words")).withColumn("length", F.size("words").cast("bigint"))
    some = _few(terms)
    own = F.filter("words", lambda w: w.isin(some)) if some is not None else F.col("words")
    rows = _counts(words.select("id", "length", own.alias("words")))
    if terms is not None and some is None:
        rows = rows.join(small(terms.distinct(), 200_000), "term", "left_semi")
    if not docs.groupBy("id").count().where("count > 1").isEmpty():
        rows = rows.groupBy("id", "term", "length").agg(F.sum("tf").alias("tf"))
    return rows.select("id", "term", "length", "tf")


def _counts(words: DataFrame) -> DataFrame:
    """(id, term, length, tf) of documents (id, length, words), without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, phrases.DOCS):
                batch = whole.slice(s, phrases.DOCS)
                lists = batch.column("words")
                coded = lists.flatten().dictionary_encode()
                if not len(coded):
                    continue
                size = len(coded.dictionary)
                doc = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                pair, tf = np.unique(doc * size + coded.indices.to_numpy().astype(np.int64), return_counts=True)
                doc, code = pa.array(pair // size), pa.array(pair % size)
                yield pa.record_batch([batch.column("id").take(doc), coded.dictionary.take(code), batch.column("length").take(doc), pa.array(tf.astype(np.int64))], names=["id", "term", "length", "tf"])

    return words.mapInArrow(run, f"id {words.schema['id'].dataType.simpleString()}, term string, length bigint, tf bigint")


def collection(docs: DataFrame) -> DataFrame:
    """One row: n documents and their mean length in terms; null texts count as documents, but not in the mean, as in SQL."""
    return docs.select(F.when(F.col("content").isNotNull(), F.size(index_terms(F.col("content")))).cast("double").alias("length")).agg(F.count("*").cast("double").alias("n"), F.avg("length").alias("mean_length"))


def bm25(tf: Column, df: Column, length: Column, n: Column, mean: Column) -> Column:
    """The positive score; an inverse frequency of 0 or less counts as a millionth."""
    idf = F.log((n - df + 0.5) / (df + 0.5))
    idf = F.when(idf <= 0, 1e-6).otherwise(idf)
    return idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))


def six(score: Column) -> Column:
    """Rounded to six digits as SQL engines do it, by the double times a million, not by its decimal digits."""
    return F.round(score * 1e6) / 1e6


def ranked_by_terms(asked: DataFrame, found: DataFrame, whole: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank) of terms asked for (query_id, term), their postings, and the collection's one row."""
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    scored = found.join(df, "term").join(F.broadcast(whole))  # one row
    scored = scored.withColumn("part", bm25(F.col("tf"), F.col("df"), F.col("length"), F.col("n"), F.col("mean_length")))
    total = scored.join(small(asked, 200_000), "term").groupBy("query_id", "id").agg((F.sum(F.round(F.col("part") * 1e9).cast("bigint")) / 1e9).alias("score"))  # whole numbers add up alike in any order
    return top(total, k, [six(F.col("score")).desc(), F.col("id")])


def asked_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term) of queries (query_id, text)."""
    return queries.select("query_id", F.explode(F.array_distinct(index_terms(F.col("text")))).alias("term"))


def or_search(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): documents with any term of a query; queries (query_id, text), docs (id, content)."""
    asked = asked_terms(queries)
    return ranked_by_terms(asked, postings(docs, asked.select("term")), collection(docs), k)


def phrase_search(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(query_id, id, n_hits, score, rank): documents that hold a query's terms in a row."""
    asked = phrases.asked_phrases(queries)
    words = docs.select("id", index_terms(F.col("content")).alias("words"))
    return ranked_by_phrases(asked, phrases.in_words(words, asked), collection(docs), k)


def ranked_by_phrases(asked: DataFrame, found: DataFrame, whole: DataFrame, k: int) -> DataFrame:
    """(query_id, id, n_hits, score, rank) of phrases asked for (query_id, phrase), where they were found, and the collection's one row.

    Phrases are ranked before queries are met, so that queries that ask the same don't multiply what was found.
    """
    per = found.groupBy("phrase", "id", "length").agg(F.sum("n_hits").alias("n_hits"))
    # Counted by a condition on the hits, so that both uses of ``per`` share one exchange.
    df = per.groupBy("phrase").agg(F.count(F.when(F.col("n_hits") > 0, 1)).alias("df"))
    scored = per.join(small_as(df, asked, 200_000), "phrase").join(F.broadcast(whole))  # one row
    scored = scored.withColumn("score", F.round(bm25(F.col("n_hits"), F.col("df"), F.col("length"), F.col("n"), F.col("mean_length")), 9))
    best = top(scored.select("phrase", "id", "n_hits", "score"), k, [F.round("score", 6).desc(), F.col("id")], "phrase")
    return best.join(small(asked, 200_000), "phrase").select("query_id", "id", "n_hits", "score", "rank")


def dedup_first(df: DataFrame, key: list[str], order) -> DataFrame:
    """The first row of each key of a query."""
    return top(df, 1, order, ["query_id", *key], "__first").drop("__first")


def rrf(vector: DataFrame, lexical: DataFrame, weight: Column | float | DataFrame = 1.0, s: Settings = SETTINGS) -> DataFrame:
    """(query_id, id, rrf, rrf_norm, distance, lexical_rank) from ranks of two lists; lists may share ids.

    ``weight`` is that of the lexical list: one for all, or a table (query_id, weight), 1 for queries that it lacks.
    """
    v = vector.select("query_id", "id", F.col("rank").alias("vector_rank"), "distance")
    x = lexical.select("query_id", "id", F.col("rank").alias("lexical_rank"))
    both = v.join(x, ["query_id", "id"], "full_outer")
    if isinstance(weight, DataFrame):
        both = both.join(small(weight.select("query_id", "weight")), "query_id", "left")
        w = F.coalesce("weight", F.lit(1.0))
    else:
        w = weight if isinstance(weight, Column) else F.lit(float(weight))
    part = lambda r: F.coalesce(1 / (s.rrf_k + F.col(r) + s.rank_base), F.lit(0.0))
    fused = both.withColumn("rrf", part("vector_rank") + w * part("lexical_rank"))
    best = F.max("rrf").over(Window.partitionBy("query_id"))
    return fused.withColumn("rrf_norm", F.when(best > 0, F.col("rrf") / best).otherwise(0.0)).drop("weight")


def intent_weights(intents: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """(query_id, weight) of the lexical list by (query_id, intent): code lookups count it more."""
    return intents.select("query_id", F.when(F.col("intent") == "code_lookup", s.code_lookup_boost).otherwise(1.0).alias("weight"))


def hybrid_score(fused: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """Adds ``score`` to rows with rrf_norm, distance, keyword_distance, modified, file_path; below the threshold they go."""
    distance = scoring.halved_distance(F.coalesce("distance", F.lit(s.fts_only_distance)))
    own = scoring.confidence(distance, F.col("keyword_distance"), F.col("modified"), s)
    blend = s.confidence_weight * own + (1 - s.confidence_weight) * F.col("rrf_norm")
    return fused.withColumn("confidence", own).withColumn("score", blend * scoring.penalty(F.col("file_path"), s=s)).where(F.col("score") >= s.default_confidence)


def capped(df: DataFrame, k: int, per_file: int = SETTINGS.max_per_file, file: str = "file_path") -> DataFrame:
    """The best ``per_file`` rows of each file, then the best k of each query."""
    order = [F.round("score", 6).desc(), F.col("id")]
    return top(top(df, per_file, order, ["query_id", file], "file_rank"), k, order)


def packed(df: DataFrame, budget: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``taken`` and ``used``: in rank order a row is taken whole if it fits, else by its compressed size if
    that fits, else left out, and later ones are still tried. Rows: (query_id, rank, id, tokens, small_tokens), and columns to ``carry``.

    The fold runs over the rows of one query, which earlier limits bound.
    """
    row = F.struct("rank", "id", "tokens", "small_tokens", *carry)
    more = "".join(f",`{c}`:{df.schema[c].dataType.simpleString()}" for c in carry)
    start = F.struct(F.lit(budget).cast("bigint").alias("left"), F.array().cast(f"array<struct<rank:int,id:bigint,used:bigint,taken:boolean{more}>>").alias("rows"))

    def step(acc: Column, x: Column) -> Column:
        whole = x.tokens <= acc.left
        less = x.small_tokens.isNotNull() & (x.small_tokens <= acc.left)
        used = F.when(whole, x.tokens).when(less, x.small_tokens).otherwise(F.lit(0)).cast("bigint")
        own = F.struct(x["rank"].cast("int").alias("rank"), x["id"].cast("bigint").alias("id"), used.alias("used"), (whole | less).alias("taken"), *(x[c].alias(c) for c in carry))
        return F.struct((acc.left - used).alias("left"), F.concat(acc.rows, F.array(own)).alias("rows"))

    folded = df.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("all")).select("query_id", F.aggregate("all", start, step).alias("acc"))
    return folded.select("query_id", F.explode("acc.rows").alias("x")).select("query_id", "x.*")


def rank_lists(lists: DataFrame, limit: int = SETTINGS.recall_top, s: Settings = SETTINGS) -> DataFrame:
    """Fuses any number of ranked lists: (query_id, list, rank, key, text) to (query_id, key, text, score, rank).

    A key's text is its first (by list and rank) until a longer one with a hint (" · ") comes.
    """
    order = F.struct("list", "rank", "text")
    start = F.lit(None).cast("string")
    pick = lambda acc, x: F.when(acc.isNull() | ((F.length(x.text) > F.length(acc)) & x.text.contains(" · ")), x.text).otherwise(acc)
    grouped = lists.groupBy("query_id", "key").agg(F.sum(1 / (s.rrf_k + F.col("rank") + 1)).alias("score"), F.array_sort(F.collect_list(order)).alias("seen"))
    return top(grouped.select("query_id", "key", F.aggregate("seen", start, pick).alias("text"), F.round("score", 9).alias("score")), limit, [F.col("score").desc(), F.col("key")])
