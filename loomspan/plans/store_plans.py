"""Queries over kept stores: incremental indexing, pinned versions, positional postings."""

from __future__ import annotations

import os
from functools import partial

from pyspark.sql import functions as F

from ..operators import indexing, postings, retention
from ..operators.snapshots import Store
from ..sources import embed, scratch
from ..sources.files import walked_files
from .base import AS_OF, epoch, files, query, t
from .search_plans import COLLECTION, PART, phrases

#: The files before and after a change: some come, some go, some get another line.
BEFORE = "doc_id % 10 <> 4"
AFTER = "doc_id % 10 <> 3"
CHANGED = "doc_id % 10 = 1"
ADDED = "\nthe end of the line"


def _after(rows, text: str):
    return rows.where(AFTER).withColumn(text, F.when(F.expr(CHANGED), F.concat(F.coalesce(text, F.lit("")), F.lit(ADDED))).otherwise(F.col(text)))


NEW_TEXT = f"CASE WHEN {CHANGED} THEN coalesce(text, '') || chr(10) || 'the end of the line' ELSE text END"


@query(
    "incremental_index",
    f"SELECT 'first' AS state, source || '/' || doc_id || '.txt' AS file_path, sha256(coalesce(text, '')) AS content_hash, 1::BIGINT AS n_chunks FROM documents WHERE {BEFORE} "
    f"UNION ALL SELECT 'last', source || '/' || doc_id || '.txt', sha256(coalesce({NEW_TEXT}, '')), 1::BIGINT FROM documents WHERE {AFTER}",
)
def incremental_index(spark, sf):
    """Two runs over the documents as files; the first version is read, pinned, after the second run."""
    rows = files(spark, sf).withColumn("content", F.coalesce("content", F.lit("")))
    store, vectors = scratch.folder(spark, "index"), partial(embed.hashed_vectors, dimensions=8)
    columns = ("file_path", "content", "language")
    indexing.index_files(spark, rows.where(BEFORE).select(*columns), store, embedder=vectors)
    db = Store(spark, store)
    first = db.snapshot()
    indexing.index_files(spark, _after(rows, "content").select(*columns), store, embedder=vectors)
    out = None
    for state, version in (("first", first), ("last", db.snapshot())):
        counts = db.read(version, "chunks", indexing.SCHEMAS["chunks"]).groupBy("file_path").agg(F.count("*").alias("n_chunks"))
        own = db.read(version, "manifest", indexing.SCHEMAS["manifest"]).join(counts, "file_path").select(F.lit(state).alias("state"), "file_path", "content_hash", "n_chunks")
        out = own if out is None else out.unionByName(own)
    return out


WORDS = r"list_filter(string_split_regex(strip_accents(lower(text)), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


@query(
    "positional_phrase_search",
    f"WITH docs AS (SELECT doc_id, {NEW_TEXT} AS text FROM documents WHERE {AFTER}), terms AS (SELECT doc_id AS id, {WORDS} AS words FROM docs), "
    f"asked AS (SELECT doc_id AS query_id, list_slice({WORDS}, 3, 5) AS words FROM documents WHERE doc_id % 50 = 0 AND len({WORDS}) >= 5), "
    "pos AS (SELECT id, len(words) AS length, unnest(words) AS term, unnest(generate_series(1, len(words))) AS \"at\" FROM terms), ask AS (SELECT query_id, len(words) AS n_terms, unnest(words) AS term, unnest(generate_series(1, len(words))) AS place FROM asked), "
    "hit AS (SELECT query_id, id, length, n_terms, \"at\" - place AS start FROM pos JOIN ask USING (term) GROUP BY ALL HAVING count(*) = n_terms), "
    "per AS (SELECT query_id, id, length, count(*) AS n_hits FROM hit GROUP BY ALL), df AS (SELECT query_id, count(*) AS df FROM per GROUP BY 1), " + COLLECTION + ", "
    "s AS (SELECT query_id, id, n_hits, " + PART.format(f="n_hits") + " AS score FROM per JOIN df USING (query_id), c) "
    "SELECT query_id, id, n_hits, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) - 1 AS rank FROM s) WHERE rank < 100",
)
def positional_phrase_search(spark, sf):
    """Phrases of three words of documents, searched in an index of three generations."""
    docs = t(spark, sf, "documents").select("doc_id", F.col("doc_id").alias("id"), F.col("text").alias("content"))
    queries = phrases(spark, sf)
    store, none = scratch.folder(spark, "postings"), docs.where("false").select("id")
    postings.build(docs.where(BEFORE).select("id", "content"), store)
    postings.update(docs.where("doc_id % 10 = 4").select("id", "content"), docs.where("doc_id % 10 = 3").select("id"), store)
    postings.update(_after(docs, "content").where(CHANGED).select("id", "content"), none, store)
    return postings.phrase_search(queries, store, 100).withColumn("score", F.round("score", 6))


@query(
    "retention_archive",
    f"WITH r AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'turns' WHEN 'view' THEN 'decisions' ELSE 'areas' END AS kind, CAST(floor(epoch(ts)) AS BIGINT) AS created FROM events) SELECT event_id, kind, CASE WHEN created < {AS_OF} - 86400 * CASE kind WHEN 'decisions' THEN 365 ELSE 180 END THEN 'archived' ELSE 'kept' END AS place FROM r",
)
def retention_archive(spark, sf):
    """Events as rows of three memory tables by months; expired ones move to the archives, and a second run changes nothing."""
    kind = F.when(F.col("event_type") == "click", "turns").when(F.col("event_type") == "view", "decisions").otherwise("areas")
    rows = t(spark, sf, "events").select("event_id", kind.alias("kind"), epoch("ts").alias("created"))
    db, days, schema = Store(spark, scratch.folder(spark, "memory")), {"turns": 180, "decisions": 365, "areas": 180}, "event_id long, created long"
    for table in days:
        retention.add(db, table, rows.where(F.col("kind") == table).select("event_id", "created"))
    for _ in range(2):
        retention.prune(db, dict.fromkeys(days, schema), AS_OF, days)
    now, out = db.snapshot(), None
    for table in days:
        for name, place in ((table, "kept"), (retention.archive_of(table), "archived")):
            own = db.read(now, name, schema).select("event_id", F.lit(table).alias("kind"), F.lit(place).alias("place"))
            out = own if out is None else out.unionByName(own)
    return out


def _written(folder: str):
    def write(rows) -> None:
        for r in rows:
            path = os.path.join(folder, r["file_path"])
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "wb") as f:
                f.write(r["content"].encode())

    return write


@query("file_tree_scan", "SELECT source || '/' || doc_id || '.txt' AS file_path, sha256(coalesce(text, '')) AS content_sha256, 'plaintext' AS language FROM documents WHERE octet_length(encode(coalesce(text, ''))) <= 2097152")
def file_tree_scan(spark, sf):
    """The documents written as files of a shared folder, and read back by the source of file trees."""
    folder = scratch.folder(spark, "tree").removeprefix("file:")
    files(spark, sf).select("file_path", F.coalesce("content", F.lit("")).alias("content")).foreachPartition(_written(folder))
    found = walked_files(spark, folder)
    return found.select("file_path", F.sha2("content", 256).alias("content_sha256"), "language")
