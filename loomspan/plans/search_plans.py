"""Queries of search, fusion, ranking, packing and the graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring, tokens
from ..functions import text as tx
from ..operators import graph, pivots, search
from .base import asked, docs, edges, files, nodes, query, t, vector_queries, vectors
from .text_plans import INTENT

DIST = "sqrt(list_sum(list_transform(list_zip(q.query, v.embedding), lambda p: pow(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE), 2))))"
DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"
QV = "q AS (SELECT vec_id AS query_id, embedding AS query, label AS query_label FROM embeddings WHERE vec_id % 50 = 0), d AS (SELECT query_id, query_label, vec_id AS id, label, " + DIST + " AS distance FROM q, embeddings v)"
NEAR = "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) - 1 AS rank FROM d"


@query("knn_l2_topk", f"WITH {QV} SELECT query_id, id, round(distance, 6) AS distance, CAST(rank AS INT) AS rank FROM ({NEAR}) WHERE rank < 10")
def knn_l2_topk(spark, sf):
    return search.knn(vector_queries(spark, sf), vectors(spark, sf), 10).select("query_id", "id", F.round("distance", 6).alias("distance"), "rank")


@query("knn_pruned", f"WITH {QV} SELECT query_id, id, round(distance, 6) AS distance, CAST(rank AS INT) AS rank FROM ({NEAR}) WHERE rank < 10")
def knn_pruned(spark, sf):
    return pivots.knn(vector_queries(spark, sf), vectors(spark, sf), 10).select("query_id", "id", F.round("distance", 6).alias("distance"), "rank")


@query("knn_postfilter", f"WITH {QV}, n AS (SELECT * FROM ({NEAR}) WHERE rank < 30 AND label = query_label) SELECT query_id, id, round(distance, 6) AS distance, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) - 1 AS r FROM n) WHERE r < 10")
def knn_postfilter(spark, sf):
    found = search.knn_postfiltered(vector_queries(spark, sf), vectors(spark, sf), 10, F.col("label") == F.col("query_label"))
    return found.select("query_id", "id", F.round("distance", 6).alias("distance"), "rank")


@query("knn_prefilter", f"WITH {QV}, n AS (SELECT * FROM d WHERE label = query_label) SELECT query_id, id, round(distance, 6) AS distance, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) - 1 AS r FROM n) WHERE r < 10")
def knn_prefilter(spark, sf):
    found = search.knn(vector_queries(spark, sf), vectors(spark, sf), 10, where=F.col("label") == F.col("query_label"))
    return found.select("query_id", "id", F.round("distance", 6).alias("distance"), "rank")


@query("vector_max_distance", f"WITH {QV} SELECT query_id, id, round(distance, 6) AS distance FROM ({NEAR}) WHERE rank < 30 AND distance <= 0.92")
def vector_max_distance(spark, sf):
    return search.knn(vector_queries(spark, sf), vectors(spark, sf), 30).where("distance <= 0.92").select("query_id", "id", F.round("distance", 6).alias("distance"))


@query(
    "cosine_rank_threshold",
    "WITH q AS (SELECT vec_id AS query_id, embedding AS query FROM embeddings WHERE vec_id % 50 = 0), d AS (SELECT query_id, vec_id AS id, "
    + DOT.format(a="query", b="embedding") + " / (sqrt(" + DOT.format(a="query", b="query") + ") * sqrt(" + DOT.format(a="embedding", b="embedding") + ")) AS cosine FROM q, embeddings)"
    " SELECT query_id, id, round(cosine, 6) AS cosine, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 9) DESC, id) - 1 AS rank FROM d WHERE round(cosine, 9) >= 0.55) WHERE rank < 50",
)
def cosine_rank_threshold(spark, sf):
    found = search.similar(vector_queries(spark, sf), vectors(spark, sf), 50, 0.55)
    return found.select("query_id", "id", F.round("cosine", 6).alias("cosine"), "rank")


@query("centroid_by_label", "SELECT label, CAST(dim - 1 AS INT) AS dim, round(avg(CAST(embedding[dim] AS DOUBLE)), 6) AS value FROM (SELECT label, embedding, unnest(generate_series(1, len(embedding))) AS dim FROM embeddings) GROUP BY label, dim")
def centroid_by_label(spark, sf):
    return search.centroids(vectors(spark, sf), "label").withColumn("value", F.round("value", 6))


@query("bm25_doc_stats", "SELECT id AS doc_id, len(words) AS n_terms, len(list_distinct(words)) AS n_distinct, round(avg(len(words)) OVER (), 6) AS mean_terms FROM terms", ("terms",))
def bm25_doc_stats(spark, sf):
    own = docs(spark, sf).select(F.col("id").alias("doc_id"), tx.index_terms(F.col("content")).alias("words"))
    mean = search.collection(docs(spark, sf)).select(F.round("mean_length", 6).alias("mean_terms"))
    return own.select("doc_id", F.size("words").cast("bigint").alias("n_terms"), F.size(F.array_distinct("words")).cast("bigint").alias("n_distinct")).join(F.broadcast(mean))


COLLECTION = "c AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(words)) AS mean FROM terms)"
PART = "round(CASE WHEN ln((c.n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((c.n - df + 0.5) / (df + 0.5)) END * {f} * 2.2 / ({f} + 1.2 * (0.25 + 0.75 * length / c.mean)), 9)"
OR = (
    "p AS (SELECT id, len(words) AS length, unnest(words) AS term FROM terms), a AS (SELECT DISTINCT query_id, unnest(words) AS term FROM asked), "
    "tf AS (SELECT id, term, length, count(*) AS f FROM p WHERE term IN (SELECT term FROM a) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), " + COLLECTION + ", "
    "s AS (SELECT query_id, id, sum(" + PART.format(f="f") + ") AS score FROM tf JOIN df USING (term) JOIN a USING (term), c GROUP BY ALL), "
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) - 1 AS rank FROM s)"
)


@query("bm25_or_search", ", " + OR + " SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM ranked WHERE rank < 100", ("terms", "asked"))
def bm25_or_search(spark, sf):
    return search.or_search(asked(spark, sf), docs(spark, sf), 100).withColumn("score", search.six(F.col("score")))


def phrases(spark, sf):
    """The stated query set: words 3 to 5 of documents whose id is divisible by 50."""
    words = tx.index_terms(F.col("content"))
    return docs(spark, sf).where((F.col("id") % 50 == 0) & (F.size(words) >= 5)).select(F.col("id").alias("query_id"), F.array_join(F.slice(words, 3, 3), " ").alias("text"))


@query(
    "bm25_phrase_search",
    ", asked AS (SELECT id AS query_id, list_slice(words, 3, 5) AS words FROM terms WHERE id % 50 = 0 AND len(words) >= 5), pos AS (SELECT id, len(words) AS length, unnest(words) AS term, unnest(generate_series(1, len(words))) AS \"at\" FROM terms), ask AS (SELECT query_id, len(words) AS n_terms, unnest(words) AS term, unnest(generate_series(1, len(words))) AS place FROM asked), "
    "hit AS (SELECT query_id, id, length, n_terms, \"at\" - place AS start FROM pos JOIN ask USING (term) GROUP BY ALL HAVING count(*) = n_terms), "
    "per AS (SELECT query_id, id, length, count(*) AS n_hits FROM hit GROUP BY ALL), df AS (SELECT query_id, count(*) AS df FROM per GROUP BY 1), " + COLLECTION + ", "
    "s AS (SELECT query_id, id, n_hits, " + PART.format(f="n_hits") + " AS score FROM per JOIN df USING (query_id), c) "
    "SELECT query_id, id, n_hits, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) - 1 AS rank FROM s) WHERE rank < 100",
    ("terms",),
)
def bm25_phrase_search(spark, sf):
    return search.phrase_search(phrases(spark, sf), docs(spark, sf), 100).withColumn("score", F.round("score", 6))


# Hybrid search: the query of item i is the vector of id i, the vector of document d that of id d.
def _lists(spark, sf, k: int = 60):
    q = t(spark, sf, "embeddings").join(asked(spark, sf).select(F.col("query_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    own = vectors(spark, sf).join(docs(spark, sf).select("id"), "id", "left_semi").drop("label")
    return search.knn(q, own, k), search.or_search(asked(spark, sf), docs(spark, sf), k)


HYBRID = (
    OR + ", l AS (SELECT query_id, id, rank AS lexical_rank FROM ranked WHERE rank < 60), "
    "q AS (SELECT vec_id AS query_id, embedding AS query FROM embeddings WHERE vec_id IN (SELECT query_id FROM asked)), "
    "d AS (SELECT query_id, vec_id AS id, " + DIST + " AS distance FROM q, embeddings v WHERE vec_id IN (SELECT doc_id FROM documents)), "
    "v AS (SELECT query_id, id, distance, rank AS vector_rank FROM (" + NEAR + ") WHERE rank < 60), "
    "f AS (SELECT query_id, id, distance, lexical_rank, coalesce(1.0 / (60 + vector_rank), 0) + coalesce(1.0 / (60 + lexical_rank), 0) AS rrf FROM v FULL JOIN l USING (query_id, id)), "
    "fused AS (SELECT *, rrf / max(rrf) OVER (PARTITION BY query_id) AS rrf_norm FROM f)"
)


@query("rrf_fusion", ", " + HYBRID + " SELECT query_id, id, round(rrf, 9) AS rrf, round(rrf_norm, 6) AS rrf_norm FROM fused", ("terms", "asked"))
def rrf_fusion(spark, sf):
    return search.rrf(*_lists(spark, sf)).select("query_id", "id", F.round("rrf", 9).alias("rrf"), F.round("rrf_norm", 6).alias("rrf_norm"))


@query(
    "rrf_intent_weight",
    ", " + HYBRID + ", w AS (SELECT query_id, CASE WHEN " + INTENT + " = 'code_lookup' THEN 1.5 ELSE 1.0 END AS weight FROM (SELECT query_id, CASE WHEN query_id % 100 = 0 THEN 'where is ' || text || ' defined' ELSE text END AS q FROM asked)), "
    "x AS (SELECT query_id, id, rrf + (weight - 1) * coalesce(1.0 / (60 + lexical_rank), 0) AS rrf FROM f JOIN w USING (query_id)) "
    "SELECT query_id, id, round(rrf, 9) AS rrf, round(rrf / max(rrf) OVER (PARTITION BY query_id), 6) AS rrf_norm FROM x",
    ("terms", "asked"),
)
def rrf_intent_weight(spark, sf):
    """Every second query is put as a question for code, so that its lexical list counts more."""
    put = F.when(F.col("query_id") % 100 == 0, F.concat(F.lit("where is "), "text", F.lit(" defined"))).otherwise(F.col("text"))
    weights = search.intent_weights(asked(spark, sf).select("query_id", tx.intent(put).alias("intent")))
    return search.rrf(*_lists(spark, sf), weights).select("query_id", "id", F.round("rrf", 9).alias("rrf"), F.round("rrf_norm", 6).alias("rrf_norm"))


KEYWORDS = (
    "kw AS (SELECT query_id, list_filter(list_concat(regexp_extract_all(text, '[A-Z][a-zA-Z0-9]+'), list_filter(regexp_extract_all(text, '[a-zA-Z_][a-zA-Z0-9_]*'), lambda w: length(w) > 2 AND NOT list_contains(["
    + ", ".join(f"'{w}'" for w in tx.STOP_WORDS + tx.CODE_PREFIXES) + "], lower(w)))), lambda w: true) AS keywords, regexp_extract_all(text, '" + tx.FILE_HINT + "') AS hints FROM asked)"
)
PENALTY = "CASE WHEN " + " OR ".join(f"contains(lower(file_path), '{m}')" for m in scoring.PENALISED) + " THEN 0.8 ELSE 1.0 END"
SCORED = (
    HYBRID + ", " + KEYWORDS + ", "
    "k AS (SELECT fused.*, file_path, content, CASE WHEN list_bool_or(list_transform(hints, lambda h: contains(file_path, h))) OR list_bool_or(list_transform(keywords, lambda w: contains(lower(content), lower(w)))) THEN 0.0 ELSE 2.0 END AS keyword_distance FROM fused JOIN files ON fused.id = files.doc_id JOIN kw USING (query_id)), "
    "conf AS (SELECT *, greatest(0.0, least(1.0, 0.5 * greatest(0.0, 1 - greatest(0.0, least(1.0, coalesce(distance, 0.0) / 2))) + 0.4 * greatest(0.0, 1 - keyword_distance / 5) + 0.1 * 0.5)) AS confidence FROM k), "
    "scored AS (SELECT *, (0.5 * confidence + 0.5 * rrf_norm) * " + PENALTY + " AS score FROM conf)"
)


def _scored(spark, sf):
    fused = search.rrf(*_lists(spark, sf))
    own = files(spark, sf).select(F.col("doc_id").alias("id"), "file_path", "content", "source")
    words = asked(spark, sf).select("query_id", tx.keywords(F.col("text")).alias("words"), tx.file_hints(F.col("text")).alias("hints"))
    # The fused rows are few; texts are met by id.
    rows = fused.join(own, "id").join(search.small(words), "query_id")
    near = tx.keyword_distance(F.col("words"), F.col("hints"), F.col("file_path"), F.col("content"))
    return search.hybrid_score(rows.withColumn("keyword_distance", near).withColumn("modified", F.lit(None).cast("double")))


@query("hybrid_score", ", " + SCORED + " SELECT query_id, id, file_path, round(confidence, 6) AS confidence, round(score, 6) AS score FROM scored", ("files", "terms", "asked"))
def hybrid_score(spark, sf):
    return _scored(spark, sf).select("query_id", "id", "file_path", F.round("confidence", 6).alias("confidence"), F.round("score", 6).alias("score"))


CAPPED = SCORED + ", cap AS (SELECT * FROM (SELECT *, split_part(file_path, '/', 1) AS folder, row_number() OVER (PARTITION BY query_id, split_part(file_path, '/', 1) ORDER BY round(score, 6) DESC, id) AS fr FROM scored) WHERE fr <= 3), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) - 1 AS place FROM cap) WHERE place < 10)"


def _capped(spark, sf):
    rows = _scored(spark, sf).withColumn("folder", F.split("file_path", "/")[0])
    return search.capped(rows, 10, file="folder")


@query("per_file_cap_topk", ", " + CAPPED + " SELECT query_id, id, folder, round(score, 6) AS score, CAST(place AS INT) AS rank FROM best", ("files", "terms", "asked"))
def per_file_cap_topk(spark, sf):
    return _capped(spark, sf).select("query_id", "id", "folder", F.round("score", 6).alias("score"), "rank")


PACK = (
    ", sized AS (SELECT query_id, place, id, greatest(1, CAST(floor(length(content) / 3.3) AS BIGINT)) AS tokens, greatest(1, CAST(floor(length(CASE WHEN length(content) <= 300 THEN content ELSE substr(content, 1, 300) || '...' END) / 3.3) AS BIGINT)) AS small_tokens FROM best), "
    "fold AS (SELECT query_id, place, id, CAST(CASE WHEN tokens <= 1500 THEN tokens WHEN small_tokens <= 1500 THEN small_tokens ELSE 0 END AS BIGINT) AS used, 1500 - CASE WHEN tokens <= 1500 THEN tokens WHEN small_tokens <= 1500 THEN small_tokens ELSE 0 END AS room FROM sized WHERE place = 0 "
    "UNION ALL SELECT s.query_id, s.place, s.id, CAST(CASE WHEN tokens <= room THEN tokens WHEN small_tokens <= room THEN small_tokens ELSE 0 END AS BIGINT), room - CASE WHEN tokens <= room THEN tokens WHEN small_tokens <= room THEN small_tokens ELSE 0 END FROM sized s JOIN fold f ON s.query_id = f.query_id AND s.place = f.place + 1) "
)


def _packed(spark, sf, budget=1_500, carry=()):
    rows = _capped(spark, sf)
    small = tx.fallback(F.col("content"), F.lit("standard"))
    sized = rows.select("query_id", "rank", "id", *carry, tokens.packed_tokens(F.col("content")).alias("tokens"), tokens.packed_tokens(F.col("content"), small).alias("small_tokens"))
    return search.packed(sized, budget, carry)


@query("token_packing", ", " + CAPPED + PACK + "SELECT query_id, CAST(place AS INT) AS rank, id, used, used > 0 AS taken FROM fold", ("files", "terms", "asked"))
def token_packing(spark, sf):
    return _packed(spark, sf)


@query(
    "inline_overflow_split",
    ", " + CAPPED + ", sized AS (SELECT query_id, place, id, greatest(1, length(content) // 4) AS tokens FROM best), "
    "fold AS (SELECT query_id, place, id, tokens, tokens <= 2000 AS inline, 2000 - CASE WHEN tokens <= 2000 THEN tokens ELSE 0 END AS room FROM sized WHERE place = 0 "
    "UNION ALL SELECT s.query_id, s.place, s.id, s.tokens, s.tokens <= room, room - CASE WHEN s.tokens <= room THEN s.tokens ELSE 0 END FROM sized s JOIN fold f ON s.query_id = f.query_id AND s.place = f.place + 1) "
    "SELECT query_id, CAST(place AS INT) AS rank, id, inline FROM fold",
    ("files", "terms", "asked"),
)
def inline_overflow_split(spark, sf):
    rows = _capped(spark, sf).select("query_id", "rank", "id", tokens.counted_tokens(F.col("content")).alias("tokens"), F.lit(None).cast("bigint").alias("small_tokens"))
    return search.packed(rows, 2_000).select("query_id", "rank", "id", F.col("taken").alias("inline"))


@query("hybrid_search_e2e", ", " + CAPPED + PACK + "SELECT query_id, id, round(score, 6) AS score, CAST(b.place AS INT) AS rank, CASE WHEN score > 0.8 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS level, used FROM fold JOIN best b USING (query_id, id) WHERE used > 0", ("files", "terms", "asked"))
def hybrid_search_e2e(spark, sf):
    kept = _packed(spark, sf, carry=("score",)).where("taken")
    return kept.select("query_id", "id", F.round("score", 6).alias("score"), "rank", scoring.level(F.col("score")).alias("level"), "used")


@query(
    "dedup_first_rank",
    ", " + OR + ", top AS (SELECT r.query_id, r.id, r.rank, sha256(regexp_replace(trim(content, E' \\t\\n\\r'), '\\s+', ' ', 'g')) AS key FROM ranked r JOIN files ON files.doc_id = r.id) "
    "SELECT query_id, id, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, key ORDER BY rank) AS n FROM top) WHERE n = 1",
    ("files", "terms", "asked"),
)
def dedup_first_rank(spark, sf):
    ranked = search.or_search(asked(spark, sf), docs(spark, sf), 1 << 30)
    key = F.sha2(F.regexp_replace(F.btrim(F.col("content"), F.lit(" \t\n\r")), r"[\t\n\f\r ]+", " "), 256)  # white space as SQL's patterns have it, without the vertical tab
    rows = ranked.join(docs(spark, sf).select("id", key.alias("key")), "id")
    return search.dedup_first(rows, ["key"], [F.col("rank")]).select("query_id", "id", "rank")


@query("path_penalty", "SELECT doc_id, file_path, CAST(" + PENALTY + " AS DOUBLE) AS factor FROM files UNION ALL SELECT page_id, url, CAST(" + PENALTY.replace("file_path", "url") + " AS DOUBLE) FROM pages", ("files",))
def path_penalty(spark, sf):
    rows = files(spark, sf).select("doc_id", "file_path").unionByName(t(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("file_path")))
    return rows.select("doc_id", "file_path", scoring.penalty(F.col("file_path")).alias("factor"))


URGENT = "SELECT id FROM nodes WHERE name = '1-URGENT'"


@query("graph_neighbors", "SELECT DISTINCT source_id, n.id, node_type, name, file_path FROM edges e JOIN nodes n ON e.target_id = n.id WHERE edge_type = 'calls'", ("edges", "nodes"))
def graph_neighbors(spark, sf):
    n = nodes(spark, sf)
    return graph.neighbours(edges(spark, sf), n, n.select(F.col("id").alias("source_id")), "calls")


@query("graph_neighbors_for_files", "SELECT DISTINCT s.file_path AS from_file, t.id, t.node_type, t.name, t.file_path FROM nodes s JOIN edges e ON e.source_id = s.id JOIN nodes t ON t.id = e.target_id WHERE s.name = '1-URGENT'", ("edges", "nodes"))
def graph_neighbors_for_files(spark, sf):
    n = nodes(spark, sf)
    # Nodes of other priorities in the same files start no edge here.
    own = n.where("name = '1-URGENT' or node_type <> 'file'")
    return graph.file_neighbours(edges(spark, sf), own, own.where("node_type = 'file'").select("file_path"))


@query(
    "related_files_anti",
    ", f AS (SELECT DISTINCT file_path FROM nodes WHERE name = '1-URGENT') SELECT DISTINCT t.file_path FROM nodes s JOIN edges e ON e.source_id = s.id JOIN nodes t ON t.id = e.target_id WHERE s.file_path IN (FROM f) AND e.edge_type IN ('calls', 'imports') AND t.node_type IN ('function', 'class', 'file', 'module') AND t.file_path NOT IN (FROM f)",
    ("edges", "nodes"),
)
def related_files_anti(spark, sf):
    n = nodes(spark, sf)
    return graph.related_files(edges(spark, sf), n, n.where("name = '1-URGENT'").select("file_path"))


@query(
    "cascade_delete_edges",
    ", g AS (SELECT id FROM nodes WHERE file_path IN (SELECT file_path FROM nodes WHERE name = '1-URGENT')) SELECT source_id, target_id, edge_type FROM edges WHERE source_id NOT IN (FROM g) AND target_id NOT IN (FROM g)",
    ("edges", "nodes"),
)
def cascade_delete_edges(spark, sf):
    n = nodes(spark, sf)
    return graph.without_files(n, edges(spark, sf), n.where("name = '1-URGENT'").select("file_path"))[1]


EXPANSION = (
    ", heads AS (SELECT DISTINCT query_id, folder FROM best WHERE place < 3), "
    "rel AS (SELECT DISTINCT query_id, b.source AS file_path FROM heads JOIN documents a ON a.source = folder JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE (query_id, b.source) NOT IN (SELECT (query_id, folder) FROM heads)), "
    "two AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY file_path) AS n FROM rel) WHERE n <= 2), "
    "near AS (SELECT two.query_id, doc_id AS id, file_path, " + DIST + " AS distance FROM two JOIN documents ON source = file_path JOIN embeddings v ON v.vec_id = doc_id JOIN q USING (query_id)), "
    "nearest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, file_path ORDER BY distance, id) AS n FROM near) WHERE n <= 2) "
    "SELECT query_id, id, file_path, round(greatest(0.0, 1 - distance) * 0.85, 6) AS score FROM nearest WHERE (query_id, id) NOT IN (SELECT (query_id, id) FROM best)"
)


@query("graph_expansion", ", " + CAPPED + EXPANSION, ("files", "terms", "asked"))
def graph_expansion(spark, sf):
    """Documents as files of a graph whose calls lead to the next document's source folder."""
    own = files(spark, sf).select("doc_id", "source")
    n = own.select(F.concat(F.lit("d"), "doc_id").alias("id"), F.lit("file").alias("node_type"), F.col("source").alias("name"), F.col("source").alias("file_path"))
    e = own.select(F.concat(F.lit("d"), "doc_id").alias("source_id"), F.concat(F.lit("d"), F.col("doc_id") + 1).alias("target_id"), F.lit("calls").alias("edge_type"))
    ranked = _capped(spark, sf).select("query_id", "id", F.col("folder").alias("file_path"), "rank")
    q = t(spark, sf, "embeddings").join(asked(spark, sf).select(F.col("query_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    vectors_ = vectors(spark, sf).select("id", "embedding").join(own.select(F.col("doc_id").alias("id"), F.col("source").alias("file_path")), "id")
    return graph.expand_all(ranked, e, n, vectors_, q).withColumn("score", F.round("score", 6))


@query("postings_table", "SELECT id, term, count(*) AS tf, CAST(any_value(length) AS BIGINT) AS length FROM (SELECT id, len(words) AS length, unnest(words) AS term FROM terms) GROUP BY id, term", ("terms",))
def postings_table(spark, sf):
    return search.postings(docs(spark, sf)).select("id", "term", "tf", "length")
