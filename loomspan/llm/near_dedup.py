"""N-gram Jaccard join with a MinHash LSH forest.

Two texts are linked when the Jaccard similarity of their sets of five-word shingles is at least 0.8.

1. Copies: texts with equal shingle sets become one class of copies, represented by one row.
2. Forest: the representatives' signatures meet in sorted prefix tries (``forest.py``), whose prefixes are shortened
   until a pair at the threshold is met with the target recall. Pairs that meet and may reach the threshold, by
   a sketch of their signatures, are candidates; only edges that connect these leave a task.
3. Components of these edges hold every candidate pair. Their texts, and no others, are read again.
4. Verification: the exact similarity of all pairs in a component, by inverted lists of shingles. A large
   component is cut into blocks and each pair of blocks is a unit of work, so no task holds all of it.
   Pairs are counted, not written; what leaves a unit are counts of links and a forest of its links.
5. Components of the verified links are the classes.

Cases: null text counts as empty; texts without words are linked only with equal texts, as copies; of a
class the smallest doc_id names it and stays (null last, of repeated rows the one with the smallest row id); an empty
table gives an empty result; other columns are ignored by ``assign`` and kept by ``keep_one``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SIMILARITY, checked_broadcast, dealt, pieces, settled, staged, table, texts, with_row_id
from .components import Forest, connected_components
from .forest import DEPTH, RECALL, TREES, WIDTH, candidates, shortest_prefix, signatures
from .shingles import shingle_sets

BLOCK_TEXTS, BLOCK_SHINGLES = 250, 250_000


def prefix_length(similarity: float = SIMILARITY, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """To what the forest's prefixes may be shortened; see ``forest.shortest_prefix``."""
    return shortest_prefix(similarity, trees, depth, recall)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The key of each text's set of shingles, and the signature of sets that are not empty."""
    for batch in pieces(batches, "text", 1 << 18):
        text = texts(batch)
        h, offsets = shingle_sets(text)
        n = np.diff(offsets)
        some = n > 0
        raw, cut = h.tobytes(), (8 * offsets).tolist()
        sets = [hashlib.blake2b(raw[a:b] if b > a else x.encode(), digest_size=16, key=b"set" if b > a else b"text").digest() for x, a, b in zip(text, cut, cut[1:])]
        labels, sketch = signatures(h, np.append(offsets[:-1][some], len(h))) if some.any() else (np.zeros((0, TREES, WIDTH), dtype=np.uint8), np.zeros((0, 2), dtype=np.uint64))
        m = len(labels) * TREES
        flat = pa.BinaryArray.from_buffers(pa.binary(), m, [None, pa.py_buffer(np.arange(m + 1, dtype=np.int32) * np.int32(WIDTH)), pa.py_buffer(labels.tobytes())])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some) * TREES]), pa.int32()), flat)
        words = np.zeros((len(text), 2), dtype=np.int64)
        words[some] = sketch.view(np.int64)
        yield pa.record_batch([batch.column("doc_id"), batch.column("__rid"), pa.array(sets, pa.binary()), pa.array(n, pa.int32()), lists, pa.array(words[:, 0]), pa.array(words[:, 1])], names=["doc_id", "__rid", "set_key", "n", "labels", "s0", "s1"])


def linked(h: np.ndarray, offsets: np.ndarray, side: np.ndarray, similarity: float) -> Iterator[tuple[int, np.ndarray]]:
    """(text, linked texts after it): all pairs at the similarity; with two sides only pairs across them."""
    n = np.diff(offsets)
    m = len(n)
    owner = np.repeat(np.arange(m), n)
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = ranked[1:] != ranked[:-1]
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(h)))
    term = np.empty(len(h), dtype=np.int64)
    term[order] = np.cumsum(new) - 1
    posting = owner[order]
    mixed_sides = side.min() != side.max()
    for a in range(m - 1):
        t = term[offsets[a] : offsets[a + 1]]
        t = t[size[t] > 1]
        if not len(t):
            continue
        c = size[t]
        where = np.repeat(begin[t] - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))
        shared = np.bincount(posting[where], minlength=m)
        ok = shared >= similarity * (n[a] + n - shared) - 1e-9
        ok &= shared > 0
        ok[: a + 1] = False
        if mixed_sides:
            ok &= side != side[a]
        if ok.any():
            yield a, np.flatnonzero(ok)


def _verified(similarity: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])

    def unit(rid: list[int], side: np.ndarray, text: list[str]) -> list[tuple]:
        h, offsets = shingle_sets(text)
        count = np.zeros(len(rid), dtype=np.int64)
        forest, out = Forest(), []
        for a, bs in linked(h, offsets, side, similarity):
            count[a] += len(bs)
            count[bs] += 1
            out += [(rid[a], rid[b], 0) for b in bs.tolist() if forest.join(a, b)]
        return out + [(rid[k], None, int(count[k])) for k in np.flatnonzero(count).tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rid, side, text = None, [], [], []

        def done() -> Iterator[pa.RecordBatch]:
            # A unit of two blocks has only pairs across them; one of a single block has all its pairs.
            if len(rid) > 1 and (key[1] == key[2] or len(set(side)) == 2) and (rows := unit(rid, np.array(side), text)):
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("component", "i", "j", "__rid", "own", "text")]
            for c, i, j, r, own, x in zip(*columns):
                if (c, i, j) != key:
                    if key:
                        yield from done()
                    key, rid, side, text = (c, i, j), [], [], []
                rid.append(r)
                side.append(own)
                text.append(x or "")
        if key:
            yield from done()

    return run


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per input row: doc_id, __rid, class_id, keep_rid, n_links (other texts), n_copies (rows with its shingles)."""
    docs = settled(docs)
    rows = with_row_id(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")))
    signed = staged(rows.select("doc_id", "__rid", "text").mapInArrow(_signed, "doc_id bigint, __rid bigint, set_key binary, n int, labels array<binary>, s0 bigint, s1 bigint"), "signatures")

    first = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("__rid"))
    copies = staged(signed.groupBy("set_key").agg(F.min(first).alias("first"), F.count("*").alias("n_copies")), "copies")
    members = staged(signed.select("doc_id", "__rid", "set_key").join(copies.select("set_key", F.col("first.doc_id").alias("rep_id"), F.col("first.__rid").alias("rep"), "n_copies"), "set_key").drop("set_key"), "members")
    others = members.where("__rid <> rep").select("__rid")
    reps = signed.select("__rid", "doc_id", "n", "labels", "s0", "s1").join(checked_broadcast(others, others.count(), 1_000_000), "__rid", "left_anti")
    met = connected_components(candidates(reps.select("__rid", "labels", "s0", "s1"), similarity), "candidates")
    sized = met.withColumnRenamed("node", "__rid").join(signed.select("__rid", "n"), "__rid")
    blocks = sized.groupBy("component").agg(F.ceil(F.greatest(F.count("*") / BLOCK_TEXTS, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("g"))
    units = staged(sized.join(blocks, "component").select("__rid", "component", "g", F.pmod(F.hash("__rid"), "g").alias("own")), "units")

    read = rows.select("__rid", "text").join(checked_broadcast(units, units.count(), 500_000), "__rid")
    other = F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("other")
    spread = read.select("*", other).select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "__rid", "own", "text")
    sent = dealt(spread, "component", "i", "j").sortWithinPartitions("component", "i", "j", "__rid")
    found = staged(sent.mapInArrow(_verified(similarity), "a bigint, b bigint, links bigint"), "links")

    classes = connected_components(found.where("b is not null").select("a", "b"), "classes")
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("n_links"))
    named = classes.join(reps.select(F.col("__rid").alias("node"), F.col("doc_id").alias("rep_id")), "node").join(links, "node", "left")
    heads = named.groupBy("component").agg(F.min(F.struct(F.col("rep_id").isNull(), F.col("rep_id"), F.col("node"))).alias("head"))
    named = named.join(heads, "component").select(F.col("node").alias("rep"), F.col("head.rep_id").alias("class_id"), F.col("head.node").alias("keep"), "n_links")
    joined = members.join(named, "rep", "left")
    return joined.select("doc_id", "__rid", F.when(F.col("keep").isNull(), F.col("rep_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("keep", "rep").alias("keep_rid"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), "n_copies")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, with all its columns."""
    docs = settled(docs)
    gone = staged(assign(docs, id_col, text_col).where("__rid <> keep_rid").select("__rid"), "dropped")
    return with_row_id(docs).join(checked_broadcast(gone, gone.count(), 1_000_000), "__rid", "left_anti").drop("__rid")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = assign(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "n_links", "n_copies", (F.col("__rid") == F.col("keep_rid")).alias("kept"))
