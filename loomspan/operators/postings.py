"""A kept full-text index with positions, by generations.

A generation is a folder: ``postings`` (term, id, tf, length, deltas) in folders by a hash of the term and sorted by it, so that
a search reads the folders of its terms alone, and in them the row groups that hold them; ``lengths`` (id, length); and
``summary``, one row with the number of live documents, their total length, the number of buckets, and that of live documents with a text. ``deltas`` are the places of
a term in its document, each less the one before. ``build`` writes the first generation, ``update`` one with the documents that
came or changed and a row without a length for those that went; what an earlier generation says of an id that a later one has
no longer counts, which only the later, small generations are read for. ``compact`` writes the live rows as one generation.
Searches equal those over the documents themselves.

Buckets and files of a bucket grow with the text, and a bucket is dealt out by document, so that a frequent term is no task's
own. A document's postings are made where its text is read; they are shuffled once, to their files.

Phrases: the terms asked for are put in their places again, document by document, and all phrases are looked for at once (``phrases.py``).

Cases: an id that comes twice in one batch has to be the same document; null texts have no terms but count as documents, though not
in the mean length; their length is -1.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import index_terms
from . import phrases
from .search import _few, asked_terms, ranked_by_phrases, ranked_by_terms, small
from .snapshots import bucket_of

#: Bytes of text for each file of postings, and the most folders of a generation; beyond it a folder has several files.
FILE_BYTES, MOST_BUCKETS = 32 << 20, 512
MAX_GENERATIONS = 8
#: Words of documents whose places are sorted at once in a task.
PART_WORDS = 1 << 18
ROW_FIELDS = "term string, tf bigint, length bigint, deltas array<int>, bucket int"


def bucket_number(term: str, n: int) -> int:
    """``bucket_of`` for one term, on the driver."""
    return ctypes.c_int64(xxhash.xxh64_intdigest(term.encode(), seed=42)).value % n


def _parts(whole: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of documents with ``PART_WORDS`` words or less, or of one document."""
    ends = whole.column("words").offsets.to_numpy()
    start = 0
    while start < whole.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, int(ends[start]) + PART_WORDS, "right")) - 1)
        yield whole.slice(start, stop - start)
        start = stop


def positions(docs: DataFrame) -> DataFrame:
    """(id, term, tf, length, deltas) of documents (id, content); all rows of a document come from one place, without a shuffle."""
    words = docs.select("id", index_terms(F.col("content")).alias("words")).where("size(words) > 0")
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _parts(whole)):
            lists = batch.column("words")
            length = np.diff(lists.offsets.to_numpy())
            coded = lists.flatten().dictionary_encode()
            code = coded.indices.to_numpy()
            doc = np.repeat(np.arange(len(length)), length)
            place = np.arange(len(code)) - np.repeat(np.cumsum(length) - length, length)
            by = np.lexsort((code, doc))  # stable: places stay in order
            code, doc, place = code[by], doc[by], place[by].astype(np.int32)
            new = np.ones(len(code), dtype=bool)
            new[1:] = (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])
            begin = np.flatnonzero(new)
            deltas = np.diff(place, prepend=np.int32(0)).astype(np.int32)
            deltas[begin] = place[begin]
            ends = np.append(begin, len(code)).astype(np.int32)
            yield pa.record_batch(
                [batch.column("id").take(pa.array(doc[begin])), coded.dictionary.take(pa.array(code[begin])), pa.array(np.diff(ends).astype(np.int64)), pa.array(length[doc[begin]].astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(deltas))],
                names=["id", "term", "tf", "length", "deltas"],
            )

    return words.mapInArrow(run, f"id {kind}, term string, tf bigint, length bigint, deltas array<int>")


def _layout(size: int) -> tuple[int, int]:
    """Buckets, and files of each, for so many bytes of text."""
    files = max(8, -(-size // FILE_BYTES))
    buckets = min(files, MOST_BUCKETS)
    return buckets, -(-files // buckets)


def _files(rows: DataFrame, folder: str, layout: tuple[int, int]) -> None:
    buckets, deep = layout
    held = rows.withColumn("bucket", bucket_of(F.col("term"), buckets)).repartition(buckets * deep, "bucket", F.pmod(F.xxhash64("id"), F.lit(deep)))
    held.sortWithinPartitions("bucket", "term", "id").write.partitionBy("bucket").parquet(f"{folder}/postings")


def _summed(spark: SparkSession, folder: str, n: int, total: int, buckets: int, texts: int) -> None:
    # The summary comes last: a generation counts once it is there.
    spark.createDataFrame([(f"{n} {total} {buckets} {texts}",)], "value string").coalesce(1).write.text(f"{folder}/summary")


def write_generation(docs: DataFrame, gone: DataFrame | None, folder: str, earlier: Kept | None = None) -> str:
    """Documents (id, content) that came or changed, and ids (id) that went, as a generation after ``earlier`` ones."""
    spark, seen = docs.sparkSession, Observation()
    length = F.when(F.col("content").isNull(), -1).otherwise(F.size(index_terms(F.col("content")))).cast("bigint")
    sizes = docs.select("id", length.alias("length"), F.octet_length("content").alias("size"))
    sizes = sizes.observe(seen, F.count("*").alias("n"), F.sum(F.greatest("length", F.lit(0))).alias("total"), F.sum("size").alias("size"), F.count("size").alias("texts")).drop("size")
    if gone is not None:
        sizes = sizes.unionByName(gone.select("id", F.lit(None).cast("bigint").alias("length")))
    sizes.write.parquet(f"{folder}/lengths")
    facts = seen.get
    n, total, texts = facts["n"] or 0, facts["total"] or 0, facts["texts"] or 0
    layout = _layout(facts["size"] or 0)
    _files(positions(docs), folder, layout)
    if earlier is not None and earlier.folders:
        own = spark.read.parquet(f"{folder}/lengths").select("id")
        was = earlier.live().join(small(own, 200_000), "id", "left_semi").agg(F.count("*"), F.coalesce(F.sum(F.greatest("length", F.lit(0))), F.lit(0)), F.count(F.when(F.col("length") >= 0, 1))).first()
        facts = earlier.facts()
        n, total, texts = n + facts[0] - was[0], total + facts[1] - was[1], texts + facts[3] - was[2]
    _summed(spark, folder, n, total, layout[0], texts)
    return folder


class Kept:
    """An index of generations, the earliest first."""

    def __init__(self, spark: SparkSession, folders: list[str]):
        self.spark, self.folders = spark, list(folders)
        self._facts: dict[str, tuple[int, int, int, int]] = {}

    def facts(self, folder: str | None = None) -> tuple[int, int, int, int]:
        """Live documents and their total length after a generation (the last), its buckets, and live documents with a text."""
        if not self._facts:  # a line a generation, each in a file of its own
            lines = self.spark.read.text([f"{f}/summary" for f in self.folders]).select(F.col("_metadata.file_path"), "value").collect()
            for path, value in lines:
                n, total, buckets, *texts = map(int, value.split())  # older generations have no fourth number
                self._facts[path.split("/")[-3]] = (n, total, buckets, *(texts or [n]))
        return self._facts[(folder or self.folders[-1]).split("/")[-1]]

    def lengths(self, first: int = 0) -> DataFrame:
        """(id, length, gen) of the generations from ``first`` on."""
        rows = None
        for gen, folder in list(enumerate(self.folders))[first:]:
            own = self.spark.read.parquet(f"{folder}/lengths").withColumn("gen", F.lit(gen))
            rows = own if rows is None else rows.unionByName(own)
        return rows

    def live(self) -> DataFrame:
        """(id, length, gen): the latest word on each document that is still there."""
        last = self.lengths().groupBy("id").agg(F.max(F.struct("gen", "length")).alias("x"))
        return last.select("id", "x.length", "x.gen").where("length is not null")

    def read(self, terms: DataFrame | None = None, columns: tuple[str, ...] = ("tf", "length")) -> DataFrame:
        """(id, term, ...) of live documents; with ``terms`` (term) only of these, from their folders."""
        return self._read(terms, _few(terms), columns)

    def _read(self, terms: DataFrame | None, some: list[str] | None, columns: tuple[str, ...]) -> DataFrame:
        """``some``: the terms as a list, if they are few."""
        kind = self.spark.read.parquet(f"{self.folders[0]}/lengths").schema["id"].dataType.simpleString()
        rows = None
        for gen, folder in enumerate(self.folders):
            own = self.spark.read.schema(f"id {kind}, {ROW_FIELDS}").parquet(f"{folder}/postings")
            if some is not None:
                n = self.facts(folder)[2]
                own = own.where(F.col("bucket").isin(sorted({bucket_number(t, n) for t in some})) & F.col("term").isin(some))
            own = own.select("id", "term", *columns, F.lit(gen).alias("gen"))
            rows = own if rows is None else rows.unionByName(own)
        if some is None and terms is not None:
            rows = rows.join(small(terms.distinct(), 200_000), "term", "left_semi")
        if len(self.folders) > 1:
            later = self.lengths(1).groupBy("id").agg(F.max("gen").alias("last"))
            rows = rows.join(small(later, 200_000), "id", "left").where("last is null or last = gen").drop("last")
        return rows.drop("gen")

    def whole(self) -> DataFrame:
        n, total, _, texts = self.facts()
        return self.spark.createDataFrame([(float(n), total / texts if texts else None)], "n double, mean_length double")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, id, score, rank) as ``search.or_search`` has it."""
        asked = asked_terms(queries)
        return ranked_by_terms(asked, self.read(asked.select("term")), self.whole(), k)

    def phrase_search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, id, n_hits, score, rank) as ``search.phrase_search`` has it, from the postings of the queries' terms alone."""
        asked = phrases.asked_phrases(queries)
        terms = asked.select(F.explode(F.split("phrase", " ")).alias("term"))
        rows = self._read(terms, _few(terms), ("length", "deltas"))
        return ranked_by_phrases(asked, phrases.in_places(rows, asked), self.whole(), k)

    def compact(self, folder: str) -> str:
        """The live rows as one generation in another folder."""
        n, total, _, texts = self.facts()
        rows = self.read(columns=("tf", "length", "deltas"))
        layout = _layout(total * 6)
        _files(rows, folder, layout)
        self.live().select("id", "length").write.parquet(f"{folder}/lengths")
        _summed(self.spark, folder, n, total, layout[0], texts)
        return folder


def kept(spark: SparkSession, store: str) -> Kept:
    """The index in a folder of its own, whose generations are numbered."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []
    done = lambda n: fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store}/{n}/summary/_SUCCESS"))
    return Kept(spark, [f"{store}/{n}" for n in names if n.startswith("gen-") and done(n)])


def build(docs: DataFrame, store: str) -> None:
    """Writes the index of documents (id, content) to a new folder."""
    write_generation(docs, None, f"{store}/gen-{0:06d}")


def update(docs: DataFrame, gone: DataFrame, store: str) -> None:
    """Documents (id, content) that came or changed, and ids (id) that went, as a generation of their own."""
    earlier = kept(docs.sparkSession, store)
    write_generation(docs, gone, f"{store}/gen-{len(earlier.folders):06d}", earlier)


def live(spark: SparkSession, store: str) -> DataFrame:
    return kept(spark, store).live()


def read(spark: SparkSession, store: str, terms: DataFrame | None = None) -> DataFrame:
    return kept(spark, store).read(terms)


def search(queries: DataFrame, store: str, k: int) -> DataFrame:
    return kept(queries.sparkSession, store).search(queries, k)


def phrase_search(queries: DataFrame, store: str, k: int) -> DataFrame:
    return kept(queries.sparkSession, store).phrase_search(queries, k)


def compact(spark: SparkSession, store: str, target: str) -> None:
    kept(spark, store).compact(f"{target}/gen-{0:06d}")
