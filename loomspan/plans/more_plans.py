"""Queries of compression, presentation, path filters and code graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import tokens
from ..operators import chunks as ck
from ..operators import compress, graph, present, search, tables
from ..sources import files as fs
from ..sources import store
from .search_plans import OR
from .base import AS_OF, asked, docs, epoch, files, ledger, query, t, turns

SHORT = "CASE WHEN length(content) <= {n} THEN content ELSE substr(content, 1, {n}) || '...' END"


@query("compress_levels", ", c AS (SELECT doc_id, content, length(content) / 10000.0 AS confidence FROM files) SELECT doc_id, sha256(CASE WHEN confidence > 0.8 THEN content ELSE " + SHORT.format(n=800) + " END) AS text_sha256, CASE WHEN confidence > 0.8 THEN 'passed' ELSE 'short' END AS origin FROM c", ("files",))
def compress_levels(spark, sf):
    rows = files(spark, sf).select(F.col("doc_id").alias("id"), "content", F.lit("doc").alias("chunk_type"), (F.length("content") / 10_000.0).alias("confidence_score"), F.array(F.lit(1.0)).alias("embedding"))
    return compress.compressed(rows, "full").select(F.col("id").alias("doc_id"), F.sha2("compressed_content", 256).alias("text_sha256"), "origin")


@query("compression_cache", ", k AS (SELECT doc_id, upper(language) AS compressed FROM files WHERE language <> 'en') SELECT f.doc_id, sha256(coalesce(compressed, " + SHORT.format(n=300) + ")) AS text_sha256, CASE WHEN compressed IS NULL THEN 'short' ELSE 'cached' END AS origin FROM files f LEFT JOIN k USING (doc_id)", ("files",))
def compression_cache(spark, sf):
    own = files(spark, sf)
    rows = own.select(F.col("doc_id").alias("id"), "content", F.lit("doc").alias("chunk_type"), F.lit(0.5).alias("confidence_score"), F.array(F.lit(1.0)).alias("embedding"))
    cache = own.where("language <> 'en'").select(F.col("doc_id").alias("chunk_id"), F.lit("standard").alias("level"), F.upper("language").alias("compressed"))
    return compress.compressed(rows, "standard", cache).select(F.col("id").alias("doc_id"), F.sha2("compressed_content", 256).alias("text_sha256"), "origin")


TOOL = " OR ".join(f"starts_with(p, '{x}')" for x in present.TOOL_PREFIXES)


@query("tool_config_filter", ", p AS (SELECT CASE WHEN language = 'fr' THEN '.cursor/' || file_path WHEN language = 'es' THEN 'CLAUDE.md' ELSE file_path END AS p, doc_id FROM files) SELECT doc_id, p = 'CLAUDE.md' OR " + TOOL + " AS tool FROM p", ("files",))
def tool_config_filter(spark, sf):
    path = F.when(F.col("language") == "fr", F.concat(F.lit(".cursor/"), "file_path")).when(F.col("language") == "es", "CLAUDE.md").otherwise(F.col("file_path"))
    return files(spark, sf).select("doc_id", present.is_tool_file(path).alias("tool"))


@query("watch_path_filter", "SELECT page_id, NOT list_has_any(string_split(url, '/'), ['fr', 'logs', 'tmp']) AS watched FROM pages")
def watch_path_filter(spark, sf):
    return t(spark, sf, "pages").select("page_id", present.watched(F.col("url"), ("fr", "logs", "tmp")).alias("watched"))


@query("code_graph_edges", "SELECT 'file_' || file_path AS source_id, substr(sha256(file_path || ':module'), 1, 16) AS target_id, 'defines' AS edge_type FROM files UNION SELECT 'file_' || file_path, 'module_' || source, 'imports' FROM files", ("files",))
def code_graph_edges(spark, sf):
    own = files(spark, sf)
    return graph.code_graph(ck.module_chunks(own), own.select("file_path", F.col("source").alias("module")))[1]


@query("import_modules", "SELECT doc_id, split_part(split_part(file_path, '/', 1), '.', 1) AS module FROM files", ("files",))
def import_modules(spark, sf):
    return files(spark, sf).select("doc_id", tx.import_module(F.col("file_path")).alias("module"))


@query("node_lookup", "SELECT 'p' || p_partkey AS id, 'class' AS node_type FROM part WHERE p_size >= 25")
def node_lookup(spark, sf):
    from .base import nodes

    return graph.nodes_where(nodes(spark, sf), node_type="class").select("id", "node_type")


@query("reply_savings", "SELECT DISTINCT event_type, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 125 WHEN 'purchase' THEN 350 WHEN 'signup' THEN 400 ELSE 0 END::BIGINT AS saved FROM events")
def reply_savings(spark, sf):
    kind = F.col("event_type")
    level = F.when(kind == "click", "off").when(kind == "view", "lite").when(kind == "purchase", "standard").when(kind == "signup", "max").otherwise("none")
    return t(spark, sf, "events").select("event_type", tokens.reply_saving(level).alias("saved")).distinct()


@query("last_retrieval", f" SELECT CAST(floor(epoch(max(ts))) AS BIGINT) AS last, {AS_OF} AS as_of FROM ledger WHERE bucket = 'retrieval'", ("ledger",))
def last_retrieval(spark, sf):
    return ledger(spark, sf).where("bucket = 'retrieval'").agg(F.max(epoch("ts")).alias("last"), F.lit(AS_OF).alias("as_of"))


@query("next_prompt_number", " SELECT session_id, CAST(coalesce(max(prompt_number), 0) + 1 AS BIGINT) AS next FROM turns GROUP BY 1", ("turns",))
def next_prompt_number(spark, sf):
    return turns(spark, sf).groupBy("session_id").agg((F.coalesce(F.max("prompt_number"), F.lit(0)) + 1).alias("next"))


@query(
    "status_text",
    ", s AS (SELECT count(*) AS q, CAST(sum(baseline) AS BIGINT) AS raw, CAST(sum(served) AS BIGINT) AS served, CAST(greatest(sum(baseline) - sum(served), 0) AS BIGINT) AS saved FROM ledger GROUP BY bucket) "
    "SELECT 'Token savings (' || q || ' queries): ' || format('{:,}', raw) || ' raw → ' || format('{:,}', served) || ' served (' || CASE WHEN raw > 0 THEN CAST(floor(100 * saved / raw) AS INT) ELSE 0 END || '% saved' || CASE WHEN saved * 15.0 / 1e6 < 0.01 THEN '' ELSE format(', ${:.2f}', saved * 15.0::DOUBLE / 1e6) END || ')' AS text FROM s",
    ("ledger",),
)
def status_text(spark, sf):
    own = ledger(spark, sf).groupBy("bucket").agg(F.count("*").alias("queries"), F.sum("baseline").alias("raw"), F.sum("served").alias("served")).withColumn("full_file", F.lit(0).cast("bigint"))
    return present.status(own, 15.0)


@query("project_overview")
def project_overview(spark, sf):
    ranked = search.or_search(asked(spark, sf), docs(spark, sf), 30).where("query_id = 0")
    rows = ranked.join(docs(spark, sf), "id").join(files(spark, sf).select(F.col("doc_id").alias("id"), "file_path"), "id")
    return present.overview(rows.select("id", "file_path", "content", F.lit(None).cast("string").alias("compressed_content"), (1 - F.col("rank") / 60).alias("confidence_score"), "rank"), "documents")


RESULT = (
    ", hits AS (SELECT query_id, id, rank, score, file_path, " + SHORT.format(n=100) + " AS served FROM ranked JOIN files ON id = doc_id WHERE rank < 10), "
    "shown AS (SELECT query_id, string_agg(format('[{}:1] (confidence: {:.2f})', file_path, score) || chr(10) || served, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS shown FROM hits WHERE rank < 5 GROUP BY 1), "
    "kept AS (SELECT query_id, count(*) AS n, string_agg(format('  expand_chunk(chunk_id=\"{}\")  → {}:1 (confidence: {:.2f})', id, file_path, score), chr(10) ORDER BY rank) AS refs FROM hits WHERE rank >= 5 GROUP BY 1) "
    "SELECT query_id, concat_ws(chr(10) || chr(10) || '---' || chr(10) || chr(10), shown, chr(10) || '---' || chr(10) || n || ' more result(s) available (not shown to save tokens):' || chr(10) || refs) AS text FROM shown LEFT JOIN kept USING (query_id)"
)


@query("result_texts", ", " + OR + RESULT, ("files", "terms", "asked"))
def result_texts(spark, sf):
    ranked = search.or_search(asked(spark, sf), docs(spark, sf), 10)
    rows = ranked.join(files(spark, sf).select(F.col("doc_id").alias("id"), "file_path", tx.fallback(F.col("content"), F.lit("minimal")).alias("served")), "id")
    return present.results(rows.select("query_id", "rank", "id", "file_path", F.lit(1).alias("start_line"), "score", "served", (F.col("rank") < 5).alias("inline")))


@query("recall_texts")
def recall_texts(spark, sf):
    ranked = search.or_search(asked(spark, sf), docs(spark, sf), 20)
    rows = ranked.join(docs(spark, sf), "id").select("query_id", F.concat(F.lit("item "), "query_id").alias("topic"), "rank", F.substring_index("content", ".", 1).alias("key"), F.substring_index("content", ".", 1).alias("text"))
    return present.recall_text(rows)


@query("chunks_by_id", "SELECT doc_id, sha256(text) AS text_sha256 FROM documents WHERE doc_id IN (SELECT item_id * 7 FROM benchmark)")
def chunks_by_id(spark, sf):
    wanted = t(spark, sf, "benchmark").select((F.col("item_id") * 7).alias("doc_id"))
    return tables.by_ids(t(spark, sf, "documents"), wanted, "doc_id").select("doc_id", F.sha2("text", 256).alias("text_sha256"))


@query(
    "changed_files",
    ", l AS (SELECT source AS log, doc_id AS place, CASE WHEN doc_id // 20 % 5 = 0 THEN substr(sha256(file_path), 1, 40) END AS own, file_path FROM files), "
    "c AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY log ORDER BY place) AS sha FROM l) SELECT sha, file_path FROM c WHERE own IS NULL AND sha IS NOT NULL",
    ("files",),
)
def changed_files(spark, sf):
    """Documents as the name-only logs of their sources: every fifth of a source is a commit, the others are its files."""
    line = F.when(F.floor(F.col("doc_id") / 20) % 5 == 0, F.substring(F.sha2("file_path", 256), 1, 40)).otherwise(F.col("file_path"))
    return fs.changed_files(files(spark, sf).select(F.col("source").alias("log"), F.col("doc_id").alias("at"), line.alias("line")))


@query("clamped_limits", "SELECT event_id, greatest(1, least(50, coalesce(CASE WHEN event_type <> 'error' THEN CAST(floor(value) AS INT) END, 10))) AS n FROM events")
def clamped_limits(spark, sf):
    asked_for = F.when(F.col("event_type") != "error", F.floor("value").cast("int"))
    return t(spark, sf, "events").select("event_id", tokens.clamp(asked_for, 1, 50, 10).alias("n"))


_MODELS = [m for m, *_ in store.PRICES]
_PRICED = ", ".join(f"('{m}', {float(i)}::DOUBLE, {float(o)}::DOUBLE)" for m, i, o in store.PRICES)
_NAMED = " ".join(f"WHEN {k} THEN '{m}'" for k, m in enumerate(_MODELS))


@query("priced_rows", f"WITH p(model, i, o) AS (VALUES {_PRICED}), e AS (SELECT event_id, CASE event_id % {len(_MODELS) + 1} {_NAMED} ELSE 'another' END AS model FROM events) SELECT event_id, model, coalesce(p.i, f.i) AS input_rate, coalesce(p.o, f.o) AS output_rate FROM e LEFT JOIN p USING (model), (SELECT i, o FROM p WHERE model = '{store.FALLBACK}') f")
def priced_rows(spark, sf):
    model = F.coalesce(F.get(F.array(*map(F.lit, _MODELS)), (F.col("event_id") % (len(_MODELS) + 1)).cast("int")), F.lit("another"))
    return store.priced(t(spark, sf, "events").select("event_id", model.alias("model")), store.prices(spark)).select("event_id", "model", "input_rate", "output_rate")


@query("merged_searches", "WITH a AS (SELECT doc_id AS id, CAST(row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS INT) AS rank FROM documents QUALIFY rank < 40), b AS (SELECT doc_id AS id, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS INT) AS rank FROM documents WHERE lang = 'fr' QUALIFY rank < 40) SELECT id, rank, 0 AS list FROM a UNION ALL SELECT id, rank, 1 AS list FROM b WHERE id NOT IN (SELECT id FROM a)")
def merged_searches(spark, sf):
    """The longest documents as one search, the first French ones as another."""
    own = t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "n_chars", "lang", F.lit(1).alias("k"))
    one = search.top(own, 40, [F.col("n_chars").desc(), F.col("id")], "k").select("id", "rank")
    two = search.top(own.where("lang = 'fr'"), 40, [F.col("id")], "k").select("id", "rank")
    return present.merged_searches(one, two)


@query("substring_fallback", "WITH q AS (SELECT item_id AS query_id, substr(text, 1, 4) AS topic FROM benchmark WHERE item_id % 10 = 5) SELECT query_id, topic, CAST(conv_id AS VARCHAR) AS key, sha256(text) AS text_sha256 FROM q, conversations WHERE contains(lower(text), lower(topic))")
def substring_fallback(spark, sf):
    topics = t(spark, sf, "benchmark").where("item_id % 5 = 0").select(F.col("item_id").alias("query_id"), F.substring("text", 1, 4).alias("topic"))
    items = t(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("key"), "text")
    found = present.substring_fallback(topics.where("query_id % 10 = 0"), items, topics)
    return found.select("query_id", "topic", "key", F.sha2("text", 256).alias("text_sha256"))
