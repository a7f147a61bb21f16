"""Incremental indexing of files into bucketed tables: a run's work and bytes written grow with what changed.

The store (``snapshots.Store``) has the tables chunks, nodes, edges and manifest in buckets by a hash of the file's path, an
embedding cache, and the full-text index of the chunks by generations (``postings.Kept``). A run compares hashes, then takes
the touched buckets in a few batches: the files are cut and embedded, the batch's buckets are
written anew, and one version of the log publishes all tables together, manifest included. So the manifest is the checkpoint: a run
that dies between batches is simply repeated and goes on with the files that are left, and readers see whole versions only. Of two
writers at once one fails with ``snapshots.Conflict``, and its run is repeated.

Buckets are as many as the text needs when a store is made. A change of the vectors' dimension indexes everything anew.
Edges that end in a changed or deleted file's nodes go, wherever they start; only buckets that have some are written again.
Cache and generations are appended to by each batch and put together when they are many, or after a full run, which also drops
vectors of texts that are no more.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.redact import secrets
from ..functions.text import content_hash
from ..sources import embed, files
from . import chunks as ck
from . import graph, postings, tables
from .search import small
from .snapshots import Snapshot, Store, bucket_of

CHUNKS = ck.CHUNK + ", content_hash string, embedding array<float>"
SCHEMAS = {"chunks": CHUNKS, "nodes": "id string, node_type string, name string, file_path string", "edges": "source_id string, target_id string, edge_type string", "cache": "content_hash string, embedding array<float>", "manifest": "file_path string, content_hash string"}
#: Bytes of text a bucket, and the most buckets; files of a batch.
BUCKET_BYTES, MOST_BUCKETS = 32 << 20, 4096
BATCH_FILES = 2_000
#: A batch has costs of its own, and reads what the store has in small: so a run has few, however many files it is for.
MOST_BATCHES = 2
#: So many parts of the cache are read side by side before they are put together.
CACHE_PARTS = 32


@dataclass(frozen=True)
class Indexed:
    """Counts of one run, and of the versions that it published."""

    new: int = 0
    changed: int = 0
    unchanged: int = 0
    deleted: int = 0
    chunks: int = 0
    hits: int = 0
    batches: int = 0


def read(spark: SparkSession, store: str, name: str, version: int | None = None) -> DataFrame:
    """A table of the store as of a version (the last); empty before the first run."""
    own = Store(spark, store)
    return own.read(own.snapshot(version), name, SCHEMAS[name])


def full_text(spark: SparkSession, snapshot: Snapshot) -> postings.Kept:
    """The full-text index of a version; without folders before the first run."""
    return postings.Kept(spark, snapshot.folders("fts"))


def searched_text():
    """What the full-text index holds of a chunk."""
    return F.concat_ws("\n", "content", "file_path", "language", "chunk_type")

#: Bytes of a folder for each task, at most; a scan gives every small file a share of its own.
TASK_BYTES = 32 << 20


def task_count(spark: SparkSession, root: str) -> int:
    """So many tasks that none has more than ``TASK_BYTES`` of the folder, and one for each core at least."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    size = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))


def index(spark: SparkSession, root: str, store: str, patterns=(), target: str | None = None, redact: bool = True, **options) -> Indexed:
    """Brings the store up to date with a folder, or a file or subtree of it; see ``index_files`` for the options."""
    own = files.project_files(spark, root, patterns, target).coalesce(task_count(spark, root))
    if redact:
        own = own.withColumn("content", secrets(F.col("content"))[0])
    return index_files(spark, own, store, target, **options)


def _batches(counts: dict[int, int], most: int) -> list[list[int]]:
    """Buckets in batches of ``most`` files or little more."""
    out, held = [], 0
    for bucket in sorted(counts):
        if not out or held >= most:
            out.append([])
            held = 0
        out[-1].append(bucket)
        held += counts[bucket]
    return out


def _source_file(source_id):
    return F.regexp_replace(source_id, "^file_", "")


def index_files(spark: SparkSession, own: DataFrame, store: str, target: str | None = None, full: bool = False, embedder=embed.hashed_vectors, salt: str = "hash:words", batch_files: int | None = None) -> Indexed:
    """Brings the store up to date with files (file_path, content, language), one row a path.

    ``target``: only this file or subtree is compared. ``full``: every file counts as changed. ``batch_files``: files of a batch; by
    default ``BATCH_FILES``, or as many more as leave ``MOST_BATCHES`` batches.
    """
    db = Store(spark, store)
    now = db.snapshot()
    n = now.facts.get("buckets")
    if n is None:
        size = own.agg(F.sum(F.octet_length("content"))).first()[0] or 0
        n = min(MOST_BUCKETS, max(8, -(-size // BUCKET_BYTES)))
    by_file = bucket_of(F.col("file_path"), n)
    own = own.withColumn("content_hash", content_hash(F.col("content"))).withColumn("bucket", by_file).cache()
    held = [own]
    try:
        dimension = len(embedder(["dimension"])[0])
        full = full or now.facts.get("dimension", dimension) != dimension
        manifest = db.read(now, "manifest", SCHEMAS["manifest"])
        scope = manifest if target is None else manifest.where((F.col("file_path") == target) | F.startswith("file_path", F.lit(target.rstrip("/") + "/")))
        diff = tables.manifest_diff(scope, own, full).withColumn("bucket", by_file).cache()
        held.append(diff)
        counts: dict[str, int] = {}
        todo: dict[int, int] = {}
        for r in diff.groupBy("status", "bucket").count().collect():  # four rows a bucket at most
            counts[r["status"]] = counts.get(r["status"], 0) + r["count"]
            if r["status"] != "unchanged":
                todo[r["bucket"]] = todo.get(r["bucket"], 0) + r["count"]
        made = hits = 0
        plan = _batches(todo, batch_files or max(BATCH_FILES, -(-sum(todo.values()) // MOST_BATCHES)))
        for buckets in plan:
            now, n_chunks, n_hits = _batch(db, now, own, diff, buckets, n, dimension, embedder, salt, held)
            made, hits = made + n_chunks, hits + n_hits
        _tidy(db, now, full and target is None)
        return Indexed(*(counts.get(k, 0) for k in ("new", "changed", "unchanged", "deleted")), chunks=made, hits=hits, batches=len(plan))
    finally:
        for frame in held:
            frame.unpersist()


def _batch(db: Store, now: Snapshot, own: DataFrame, diff: DataFrame, buckets: list[int], n: int, dimension: int, embedder, salt: str, held: list) -> tuple[Snapshot, int, int]:
    """Indexes the changed files of some buckets and publishes the version after ``now``."""
    part = diff.where(F.col("bucket").isin(buckets))
    stale = part.where("status <> 'unchanged'").select("file_path")
    touched = own.join(part.where("status in ('new', 'changed')").select("file_path"), "file_path", "left_semi")
    old = {t: db.read(now, t, SCHEMAS[t], buckets) for t in ("chunks", "nodes", "manifest")}
    kept = tables.delete_files(old, stale)
    fresh = embed.cached(ck.chunks(touched), db.read(now, "cache", SCHEMAS["cache"]), "content", salt, embedder).cache()
    held.append(fresh)
    n_chunks, n_hits = fresh.agg(F.count("*"), F.coalesce(F.sum(F.col("hit").cast("int")), F.lit(0))).first()
    nodes, edges = graph.code_graph(fresh, ck.imports(touched))
    gone = old["nodes"].join(stale, "file_path", "left_semi").select("id")
    by_source = bucket_of(_source_file(F.col("source_id")), n)
    ends = db.read(now, "edges", SCHEMAS["edges"]).join(small(gone.withColumnRenamed("id", "target_id"), 200_000), "target_id", "left_semi")
    edge_buckets = sorted({*buckets, *(r[0] for r in ends.select(by_source.alias("b")).distinct().collect())})  # as many as there are buckets at most
    _, left = graph.without_files(old["nodes"], db.read(now, "edges", SCHEMAS["edges"], edge_buckets), stale)
    by_file = bucket_of(F.col("file_path"), n)
    replace = {
        "chunks": (buckets, db.write("chunks", kept["chunks"].unionByName(fresh.drop("hit")), by_file, ["file_path", "start_line"])),
        "nodes": (buckets, db.write("nodes", kept["nodes"].unionByName(nodes), by_file)),
        "edges": (edge_buckets, db.write("edges", left.unionByName(edges).distinct(), by_source)),
        "manifest": (buckets, db.write("manifest", kept["manifest"].unionByName(touched.select("file_path", "content_hash")), by_file)),
    }
    cache = fresh.where("not hit and embedding is not null").select("content_hash", "embedding").dropDuplicates(["content_hash"]).sortWithinPartitions("content_hash")
    append = {"cache": db.write("cache", cache)}
    texts = fresh.select("id", searched_text().alias("content")).dropDuplicates(["id"])
    dead = old["chunks"].join(stale, "file_path", "left_semi").select("id").distinct().join(texts.select("id"), "id", "left_anti")
    append["fts"] = [(None, postings.write_generation(texts, dead, f"{db.root}/data/fts/{uuid.uuid4().hex}", full_text(db.spark, now)))]
    made = db.publish(now, replace, append, {"buckets": n, "dimension": dimension})
    fresh.unpersist()  # later batches need the room
    return made, n_chunks, n_hits


def _tidy(db: Store, now: Snapshot, full: bool) -> None:
    """Puts many appended parts together; after a full run the cache keeps live texts alone."""
    replace = {}
    parts = now.folders("cache")
    if parts and (full or len(parts) > CACHE_PARTS):
        chunks = db.read(now, "chunks", SCHEMAS["chunks"]).where("embedding is not null").select("content_hash", "embedding")
        rows = chunks.dropDuplicates(["content_hash"]) if full else db.read(now, "cache", SCHEMAS["cache"]).dropDuplicates(["content_hash"])
        replace["cache"] = (None, db.write("cache", rows.sortWithinPartitions("content_hash")))
    if len(now.folders("fts")) > postings.MAX_GENERATIONS:
        replace["fts"] = (None, [(None, full_text(db.spark, now).compact(f"{db.root}/data/fts/{uuid.uuid4().hex}"))])
    if replace:
        db.publish(now, replace)
    db.expire(keep=3)
