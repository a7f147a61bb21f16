"""Exact deduplication with a cuckoo-filter index of live digests.

A text's digest is the SHA-256 of its normalised form. Every task keeps a ``CuckooIndex``: an array of
buckets of four 16-bit fingerprints, and beside each fingerprint the stored key with its record. A digest
whose fingerprint is in neither of its two buckets is new for certain and is inserted; a fingerprint hit is
verified against the stored keys of those buckets. When an insertion finds no slot, the index doubles and is
rebuilt from the stored keys. Deleting a digest clears its slot.

Input rows pass a first index where they are read, so that a group of copies, however large, reaches the
shuffle as one row a task; the second index, dealt by digest, merges these. No text is shuffled.

Cases: null text counts as empty; empty texts form one group; of equal texts the smallest doc_id stays, a
null doc_id last, and of rows with one doc_id the one with the smallest row id; an empty table gives an empty result; other
columns are ignored by ``assign`` and kept by ``keep_first``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checked_broadcast, dealt, settled, staged, table, with_row_id

WHITE = r"[\x20\x09-\x0D]+"
GROUP = "digest binary, keep_id bigint, keep_rid bigint, group_size bigint"
LAST = (1 << 63) - 1


class CuckooIndex:
    """Cuckoo filter with the stored keys beside the fingerprints.

    >>> index = CuckooIndex()
    >>> index.insert(b"x" * 32, 1), index.get(b"x" * 32), index.delete(b"x" * 32), index.get(b"x" * 32)
    (True, 1, True, None)
    """

    SLOTS, KICKS = 4, 200

    def __init__(self, buckets: int = 256):
        self.resizes = self.false_hits = self.size = 0
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints = [0] * (buckets * self.SLOTS)
        self.keys: list[bytes | None] = [None] * len(self.prints)
        self.records: list = [None] * len(self.prints)

    def _places(self, key: bytes) -> tuple[int, int, int]:
        h = int.from_bytes(key[:8], "little")
        mark = (h >> 48) or 1
        one = h & self.mask
        return mark, one, self._other(one, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ ((mark * 0x5BD1E995) & self.mask)

    def _slot(self, key: bytes) -> int:
        """The slot that holds the key, or -1; only fingerprint hits compare stored keys."""
        mark, one, two = self._places(key)
        prints = self.prints
        for bucket in (one, two):
            at = bucket * self.SLOTS
            for k in range(at, at + self.SLOTS):
                if prints[k] == mark:
                    if self.keys[k] == key:
                        return k
                    self.false_hits += 1
        return -1

    def get(self, key: bytes):
        k = self._slot(key)
        return None if k < 0 else self.records[k]

    def insert(self, key: bytes, record) -> bool:
        """Stores a key; False, with the record replaced, where it is live already."""
        k = self._slot(key)
        if k >= 0:
            self.records[k] = record
            return False
        self._place(key, record)
        self.size += 1
        return True

    def delete(self, key: bytes) -> bool:
        k = self._slot(key)
        if k < 0:
            return False
        self.prints[k], self.keys[k], self.records[k] = 0, None, None
        self.size -= 1
        return True

    def _place(self, key: bytes, record) -> None:
        if self.size >= 0.94 * len(self.prints):
            self._grow(key, record)
            return
        mark, one, two = self._places(key)
        bucket = one
        for turn in range(self.KICKS):
            for b in (bucket, two) if turn == 0 else (bucket,):
                at = b * self.SLOTS
                for k in range(at, at + self.SLOTS):
                    if not self.prints[k]:
                        self.prints[k], self.keys[k], self.records[k] = mark, key, record
                        return
            k = bucket * self.SLOTS + (turn + mark) % self.SLOTS
            mark, self.prints[k] = self.prints[k], mark
            key, self.keys[k] = self.keys[k], key
            record, self.records[k] = self.records[k], record
            bucket = self._other(bucket, mark)
        self._grow(key, record)

    def _grow(self, key: bytes, record) -> None:
        """Twice the buckets, filled again from the stored keys and the one without a slot."""
        kept = [*self.items(), (key, record)]
        self.resizes += 1
        self._clear(2 * (self.mask + 1))
        size, self.size = self.size, 0
        for k, r in kept:
            self._place(k, r)
        self.size = size

    def items(self) -> Iterator[tuple[bytes, object]]:
        return ((k, r) for k, r in zip(self.keys, self.records) if k is not None)


def digest_of(text: Column) -> Column:
    """SHA-256, 32 bytes, of the text with each run of white space as one space."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " "), 256))


def _emit(index: CuckooIndex) -> Iterator[pa.RecordBatch]:
    rows = list(index.items())
    schema = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("keep_rid", pa.int64()), ("group_size", pa.int64())])
    for i in range(0, len(rows), 20_000):
        part = rows[i : i + 20_000]
        first = [r[0] for _, r in part]
        yield pa.record_batch([pa.array([k for k, _ in part], pa.binary()), pa.array([None if null else x for null, x, _ in first], pa.int64()), pa.array([x for _, _, x in first], pa.int64()), pa.array([r[1] for _, r in part], pa.int64())], schema=schema)


def _merge(index: CuckooIndex, batch: pa.RecordBatch) -> None:
    columns = (batch.column(c).to_pylist() for c in ("digest", "keep_id", "keep_rid", "group_size"))
    for digest, doc_id, rid, n in zip(*columns):
        own = (doc_id is None, 0 if doc_id is None else doc_id, rid)
        if (old := index.get(digest)) is None:
            index.insert(digest, [own, n])
        else:
            old[0] = min(old[0], own)
            old[1] += n


def _indexed(most: int | None):
    """most: emit and start anew at so many keys; None where one task has to see all rows of a digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex()
        for batch in batches:
            _merge(index, batch)
            if most and index.size >= most:
                yield from _emit(index)
                index = CuckooIndex()
        yield from _emit(index)

    return run


def groups(digests: DataFrame, keys_per_task: int = 500_000) -> DataFrame:
    """One row per live digest: the row that stays and the group's size, from (doc_id, __rid, digest)."""
    rows = digests.select("digest", F.col("doc_id").cast("bigint").alias("keep_id"), F.col("__rid").alias("keep_rid"), F.lit(1).cast("bigint").alias("group_size"))
    local = rows.mapInArrow(_indexed(100_000), GROUP)
    n = max(int(digests.sparkSession.conf.get("spark.sql.shuffle.partitions")), digests.count() // keys_per_task)
    return dealt(local, "digest", n=n).mapInArrow(_indexed(None), GROUP)


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, __rid, digest, keep_id, keep_rid, group_size, kept."""
    docs = settled(docs)
    rows = with_row_id(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("__text")))
    digests = staged(rows.select("doc_id", "__rid", digest_of(F.col("__text")).alias("digest")), "digests")
    live = staged(groups(digests), "live-digests")
    return digests.join(live, "digest").withColumn("kept", F.col("__rid") == F.col("keep_rid"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, and nothing else."""
    docs = settled(docs)
    gone = staged(assign(docs, id_col, text_col).where(~F.col("kept")).select("__rid"), "dropped")
    return with_row_id(docs).join(checked_broadcast(gone, gone.count(), 1_000_000), "__rid", "left_anti").drop("__rid")


def update(live: DataFrame, inserts: DataFrame, deletes: DataFrame, keys_per_task: int = 500_000) -> DataFrame:
    """The index after a batch: ``deletes`` (digest) go first, then ``inserts`` (GROUP columns) come in."""
    none = F.lit(None).cast("bigint")
    gone = deletes.select("digest", none.alias("keep_id"), none.alias("keep_rid"), none.alias("group_size"), F.lit(1).alias("turn"))
    rows = live.withColumn("turn", F.lit(0)).unionByName(gone).unionByName(inserts.withColumn("turn", F.lit(2)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex()
        for batch in batches:
            turn = batch.column("turn").to_numpy()
            for kind in (0, 1, 2):
                part = batch.filter(pa.array(turn == kind))
                if kind == 1:
                    for digest in part.column("digest").to_pylist():
                        index.delete(digest)
                else:
                    _merge(index, part)
        yield from _emit(index)

    n = max(int(live.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // keys_per_task)
    return dealt(rows, "digest", n=n).sortWithinPartitions("turn").mapInArrow(run, GROUP)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = assign(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP8_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS x FROM documents
), g AS (SELECT doc_id, x, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size FROM t WINDOW w AS (PARTITION BY x))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(x) AS text_sha256 FROM g
"""
