"""Shared plumbing of the training-data operators: tables, staging, Arrow helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE_WORDS = 5
SIMILARITY = 0.8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="loomspan-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and returns the table.

    The lineage ends here, and any executor can read the rows again after another one is lost. The tables of an
    application are removed when it ends.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    folder = f"{shared_dir(spark)}/{context.applicationId}"
    path = f"{folder}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    own = context._jvm.org.apache.hadoop.fs.Path(folder)
    own.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(own)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *cols: str, n: int | None = None) -> DataFrame:
    """Hash-partitions by ``cols`` into a fixed number of partitions."""
    spark = df.sparkSession
    return df.repartition(n or int(spark.conf.get("spark.sql.shuffle.partitions")), *cols)


def checked_broadcast(df: DataFrame, rows: int, max_rows: int) -> DataFrame:
    """A broadcast hint only where the counted ``rows`` stay within the bound; else Spark shuffles."""
    return F.broadcast(df) if rows <= max_rows else df


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The strings of a batch, null as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Re-cuts batches so that each holds about ``most_bytes`` of ``column`` at most (one row at least)."""
    for batch in batches:
        at, held = 0, 0
        sizes = pc.binary_length(batch.column(column)).to_pylist() if batch.num_rows else []
        for i, n in enumerate(sizes):
            if held and held + (n or 0) > most_bytes:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += n or 0
        if batch.num_rows > at:
            yield batch.slice(at)
        del batch
        pa.default_memory_pool().release_unused()  # else a worker keeps what its largest batch took


ROW_BITS = 30


def settled(df: DataFrame) -> DataFrame:
    """``df`` if it is no more than a scan of Parquet files, whose rows have a place in a file; else a staged copy."""
    node = df._jdf.queryExecution().optimizedPlan()
    steady = node.deterministic()
    while node.nodeName() in ("Project", "Filter"):
        node = node.children().apply(0)
    if steady and node.getClass().getSimpleName() == "LogicalRelation":
        relation = node.relation()
        if relation.getClass().getSimpleName() == "HadoopFsRelation" and relation.fileFormat().toString() == "Parquet":
            return df
    return staged(df, "settled")


def file_slots(paths: list[str]) -> dict[str, int]:
    """A number below 2 to the 33 for each path that has not the first choice, its hash, for itself alone."""
    taken: set[int] = set()
    moved = {}
    for path in sorted(paths):
        slot = first = xxhash.xxh64(path.encode(), seed=42).intdigest() >> 31
        while slot in taken:
            slot = (slot + 1) % (1 << 33)
        taken.add(slot)
        if slot != first:
            moved[path] = slot
    return moved


def with_row_id(docs: DataFrame) -> DataFrame:
    """Adds ``__rid``, which tells repeated rows apart; ``docs`` has to be settled.

    It is the row's place: the number of its file, from the hash of its path, and its index there. So it is the same in
    every scan, however the files are split and whichever executors read them.
    """
    one_slash = lambda p: re.sub(r"^(\w+:)/+", r"\1/", p)  # noqa: E731  the scan and the listing differ in this
    moved = file_slots([one_slash(p) for p in docs.inputFiles()])
    place = docs.metadataColumn("_metadata")
    path = F.regexp_replace(place["file_path"], r"^(\w+:)/+", "$1/")
    slot: Column = F.shiftrightunsigned(F.xxhash64(path), 31)
    if moved:
        pairs = [F.lit(x) for item in moved.items() for x in item]
        slot = F.coalesce(F.element_at(F.create_map(*pairs), path), slot)
    row = F.when(place["row_index"] < 1 << ROW_BITS, place["row_index"]).otherwise(F.raise_error("a file has too many rows"))
    return docs.withColumn("__rid", F.shiftleft(slot, ROW_BITS).bitwiseOR(row.cast("bigint")))


def fold_of(doc_id: str = "doc_id"):
    """crc32 of the id as text, mod 4; 2 is the held-out fold."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url):
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url):
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))
