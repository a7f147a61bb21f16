"""Keyed tables: manifests, upserts, caches, retention and lookups as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def manifest_diff(manifest: DataFrame, current: DataFrame, full: bool = False) -> DataFrame:
    """(file_path, status) new, changed, unchanged or deleted, from (file_path, content_hash) tables."""
    old = manifest.select("file_path", F.col("content_hash").alias("old_hash"))
    both = old.join(current.select("file_path", "content_hash"), "file_path", "full_outer")
    same = F.col("old_hash").eqNullSafe(F.col("content_hash")) & F.lit(not full)
    status = F.when(F.col("content_hash").isNull(), "deleted").when(F.col("old_hash").isNull(), "new").when(same, "unchanged").otherwise("changed")
    return both.select("file_path", status.alias("status"))


def deleted_files(manifest: DataFrame, current: DataFrame) -> DataFrame:
    return manifest.select("file_path").join(current.select("file_path"), "file_path", "left_anti")


def file_status(manifest: DataFrame, current: DataFrame, chunks: DataFrame) -> DataFrame:
    """(file_path, status ok, stale or missing, n_chunks) of the manifest's files."""
    old = manifest.select("file_path", F.col("content_hash").alias("old_hash"))
    counts = chunks.groupBy("file_path").agg(F.count("*").alias("n_chunks"))
    both = old.join(current.select("file_path", "content_hash"), "file_path", "left").join(counts, "file_path", "left")
    status = F.when(F.col("content_hash").isNull(), "missing").when(F.col("content_hash") == F.col("old_hash"), "ok").otherwise("stale")
    return both.select("file_path", status.alias("status"), F.coalesce("n_chunks", F.lit(0)).cast("bigint").alias("n_chunks"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows of both by key; new ones win, among them the one with the greatest ``order``."""
    rank = [F.col("__new").desc()] + ([F.col(order).desc_nulls_last()] if order else [])
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(*rank)
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__new", "__n")


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """Rows of ``new`` whose key is neither in ``old`` nor earlier in ``new``; null keys are equal to each other."""
    w = Window.partitionBy(*keys).orderBy(F.lit(1) if order is None else order)
    first = new.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    held = old.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & first[k].eqNullSafe(held[f"__{k}"])
    return first.join(held, same, "left_anti")


def lookup(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``hit``: whether the table has their key."""
    return rows.join(table.select(key).distinct().withColumn("__hit", F.lit(True)), key, "left").withColumn("hit", F.coalesce("__hit", F.lit(False))).drop("__hit")


def prune(cached: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Cached rows whose key is live; all of them if nothing is live."""
    some = live.select(key).distinct()
    empty = some.limit(1).count() == 0
    return cached if empty else cached.join(some, key, "left_semi")


def age_out(payloads: DataFrame, events: DataFrame, cutoff: Column) -> DataFrame:
    """Payloads with their texts emptied where no event at or after the cutoff refers to them.

    payloads: id, raw_input, raw_output, size_bytes. events: payload_id, ts. Adds ``aged``.
    """
    recent = events.where(F.col("ts") >= cutoff).select(F.col("payload_id").alias("id")).distinct().withColumn("__recent", F.lit(True))
    own = payloads.join(recent, "id", "left").withColumn("aged", F.col("__recent").isNull() & (F.col("size_bytes") > 0)).drop("__recent")
    for name, empty in (("raw_input", F.lit("")), ("raw_output", F.lit(None).cast("string")), ("size_bytes", F.lit(0).cast("bigint"))):
        own = own.withColumn(name, F.when(F.col("aged"), empty).otherwise(F.col(name)))
    return own


def retention(rows: DataFrame, as_of: int, days: dict[str, int]) -> DataFrame:
    """``rows`` (kind, created, ...) with ``archived``: older than their kind's days."""
    limit = F.lit(None).cast("bigint")
    for kind, n in days.items():
        limit = F.when(F.col("kind") == kind, F.lit(as_of - 86_400 * n).cast("bigint")).otherwise(limit)
    return rows.withColumn("archived", F.coalesce(F.col("created") < limit, F.lit(False)))


def delete_files(tables: dict[str, DataFrame], files: DataFrame) -> dict[str, DataFrame]:
    """Each table (file_path, ...) without rows of the files."""
    gone = files.select("file_path").distinct()
    return {name: df.join(gone, "file_path", "left_anti") for name, df in tables.items()}


def resolved(rows: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """``rows`` with a null key where the parents have no such row."""
    held = parents.select(F.col(parent_key).alias("__parent")).distinct()
    return rows.join(held, rows[key] == held["__parent"], "left").withColumn(key, F.col("__parent")).drop("__parent")


def move_table(spark: SparkSession, source: str, path: str) -> None:
    """Puts a written table in the place of another; two renames of the store's own."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new, old, own = (jvm.org.apache.hadoop.fs.Path(p) for p in (source, f"{path}.last", path))
    fs = own.getFileSystem(conf)
    fs.delete(old, True)
    if fs.exists(own):
        fs.rename(own, old)
    fs.rename(new, own)
    fs.delete(old, True)


def replace_table(df: DataFrame, path: str) -> None:
    """Writes a new version of a table beside the old one, then swaps the folders; a failed write leaves the old one."""
    df.write.mode("overwrite").parquet(f"{path}.next")
    move_table(df.sparkSession, f"{path}.next", path)


def by_ids(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of a table whose key is among the ids, each once however often it is asked for."""
    return table.join(ids.select(key).distinct(), key, "left_semi")
