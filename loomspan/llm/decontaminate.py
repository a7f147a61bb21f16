"""Benchmark decontamination by SimHash over item-sized windows.

A window is as many words of a document as a benchmark item has. Both carry a 64-bit SimHash of their words.
Fingerprints are cut into ``radius + 1`` blocks: two that differ in at most ``radius`` bits agree in one block
at least, so looking up each block finds every item within the radius. A candidate is then verified by the
exact weighted Jaccard similarity of five-word shingles, 0.8 or more; a shingle's weight is the logarithm of
how few items hold it.

Windows without any shingle of an item of their size have similarity 0, so only windows around shared
shingles get fingerprints. A document shorter than an item is one window. An item of one to four words has one
shingle, of all its words: documents' shingles of that size are looked up as they are.

The items are a stated query set, broadcast in blocks of ``BLOCK_BYTES`` of text and indexed once a worker; more than one
block means more than one pass. How many items hold a shingle is counted over all blocks. Documents stay where they are read: nothing is shuffled.

Cases: null and empty texts and items match nothing; items with equal words are each reported; repeated rows
are reported each; an empty table gives an empty result; other columns are ignored by ``matches`` and kept by
``clean``. Of several windows of a document that match an item, the most similar, then the first, is reported.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SHINGLE_WORDS, SIMILARITY, checked_broadcast, pieces, settled, staged, table, texts, with_row_id
from .shingles import Words, shingle_hashes, shingle_sets, words

#: The smallest radius that keeps pairs at the similarity: of windows with as many words replaced as it allows, all at one
#: end, 99.9 % lie within 16 bits (94.5 % within 12), of others all. With 17 blocks of 3 or 4 bits the index selects little.
RADIUS = 16
BLOCK_BYTES = 16 << 20
TILE = 1 << 18
FILTER_BITS = 22
MATCH = "doc_id bigint, __rid bigint, item_id bigint, start_word bigint, n_words int, hamming int, similarity double, n_windows int"


def votes(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of the 64 bits of each word's hash."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int32) * 2 - 1


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """SimHashes of rows of 64 sums; a sum of 0 gives a 0."""
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").reshape(-1)


class HammingIndex:
    """All stored fingerprints within the radius of a query, by blocks that have to agree somewhere."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS):
        self.prints, self.radius = prints, radius
        edges = np.linspace(0, 64, radius + 2).astype(int)
        self.cuts = [(np.uint64(a), np.uint64((1 << int(b - a)) - 1)) for a, b in zip(edges, edges[1:])]
        self.blocks: list[dict[int, np.ndarray]] = []
        for shift, mask in self.cuts:
            value = (prints >> shift) & mask
            self.blocks.append({int(v): np.flatnonzero(value == v) for v in np.unique(value)})

    def find(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, stored, distance) of all pairs within the radius, each once. Pairs that agree in a block are compared in
        tiles of ``TILE``, so memory grows with the pairs that are found, not with those that are compared."""
        found = [np.zeros(0, dtype=np.int64)]
        for (shift, mask), block in zip(self.cuts, self.blocks):
            value = (queries >> shift) & mask
            for v, stored in block.items():
                rows = np.flatnonzero(value == np.uint64(v))
                for c in range(0, len(stored), TILE):
                    own = stored[c : c + TILE]
                    step = max(1, TILE // len(own))
                    for a in range(0, len(rows), step):
                        part = rows[a : a + step]
                        i, j = np.nonzero(np.bitwise_count(queries[part, None] ^ self.prints[own][None, :]) <= self.radius)
                        if len(i):
                            found.append(part[i] * len(self.prints) + own[j])
        q, s = np.divmod(np.unique(np.concatenate(found)), max(len(self.prints), 1))
        return q, s, np.bitwise_count(queries[q] ^ self.prints[s]).astype(np.int64)


@dataclass
class Held:
    """The number of items of the benchmark, and how many of them hold a shingle, where it is two or more."""

    items: int
    shingles: np.ndarray
    counts: np.ndarray


def held_by(blocks: list[list[tuple[int, str]]]) -> Held:
    found, counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    for rows in blocks:
        own, n = np.unique(shingle_sets([x for _, x in rows])[0], return_counts=True)
        found, at = np.unique(np.concatenate([found, own]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([counts, n]), len(found)).astype(np.int64)
    return Held(sum(map(len, blocks)), found[counts > 1], counts[counts > 1])


class Items:
    """The items of one block, ready to be met by documents; ``held`` is of the whole benchmark."""

    def __init__(self, rows: list[tuple[int, str]], held: Held, similarity: float, radius: int):
        w = words([x for _, x in rows])
        h, owner, _ = shingle_hashes(w)
        self.ids = [i for i, _ in rows]
        self.similarity = similarity
        self.sizes = np.diff(w.offsets)
        self.sets = [frozenset(h[owner == k].tolist()) for k in range(len(rows))]
        self.most = float(np.log1p(held.items))
        self.weight = dict.fromkeys(h.tolist(), self.most)
        self.weight |= {s: float(np.log1p(held.items / n)) for s, n in zip(held.shingles.tolist(), held.counts.tolist())}
        self.totals = [sum(self.weight[s] for s in own) for own in self.sets]
        long = [k for k in range(len(rows)) if self.sizes[k] >= SHINGLE_WORDS]
        self.short: dict[int, dict[int, list[int]]] = {}  # by size, items of one short shingle
        for k in np.flatnonzero((self.sizes > 0) & (self.sizes < SHINGLE_WORDS)).tolist():
            self.short.setdefault(int(self.sizes[k]), {}).setdefault(next(iter(self.sets[k])), []).append(k)
        self.known = np.array(sorted({s for k in long for s in self.sets[k]}), dtype=np.uint64)
        self.seen = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.seen[(self.known & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True
        self.holders: dict[int, list[int]] = {}  # sizes of the items that hold a shingle
        for k in long:
            for s in self.sets[k]:
                sizes = self.holders.setdefault(s, [])
                if int(self.sizes[k]) not in sizes:
                    sizes.append(int(self.sizes[k]))
        self.by_size: dict[int, tuple[np.ndarray, HammingIndex]] = {}
        for size in np.unique(self.sizes[long]).tolist():
            own = np.flatnonzero(self.sizes == size)
            sums = np.stack([votes(w.hashes[w.offsets[k] : w.offsets[k + 1]]).sum(axis=0) for k in own])
            self.by_size[size] = (own, HammingIndex(fingerprints(sums), radius))

    def seeds(self, h: np.ndarray) -> np.ndarray:
        """Places of the shingles that some item holds."""
        at = np.flatnonzero(self.seen[(h & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)])
        if not len(self.known) or not len(at):
            return at[:0]
        k = np.minimum(np.searchsorted(self.known, h[at]), len(self.known) - 1)
        return at[self.known[k] == h[at]]

    def met_short(self, w: Words) -> Iterator[tuple[int, int, int, int, int, float, int]]:
        """(text, item, first word, words, distance, similarity, windows) of items below five words: a window is one shingle, equal or not."""
        for size, own in self.short.items():
            h, owner, first = shingle_hashes(w, size)
            known = np.array(sorted(own), dtype=np.uint64)
            k = np.minimum(np.searchsorted(known, h), len(known) - 1)
            at = np.flatnonzero(known[k] == h)
            _, places, windows = np.unique(owner[at] * len(known) + k[at], return_index=True, return_counts=True)
            for p, n in zip(at[places].tolist(), windows.tolist()):
                text = int(owner[p])
                for item in own[int(known[k[p]])]:
                    yield text, item, int(first[p] - w.offsets[text]), size, 0, 1.0, n

    def similar(self, window: set[int], item: int) -> float:
        shared = sum(self.weight[s] for s in window & self.sets[item])
        either = self.totals[item] + sum(self.weight.get(s, self.most) for s in window) - shared
        return shared / either if either else 0.0

    def met(self, hashes: np.ndarray, shingles: np.ndarray, seeds: np.ndarray) -> Iterator[tuple[int, int, int, int, float, int]]:
        """(item, first word, words, distance, similarity, windows) of a document's matches; seeds: its places."""
        n = len(hashes)
        sums = np.zeros((n + 1, 64), dtype=np.int32)
        np.cumsum(votes(hashes), axis=0, out=sums[1:])
        at: dict[int, list[int]] = {}
        for p in seeds.tolist():
            for size in self.holders[int(shingles[p])]:
                at.setdefault(size, []).append(p)
        best: dict[int, tuple] = {}
        for size, places in at.items():
            own, index = self.by_size[size]
            span = min(size, n)
            lead = max(span - SHINGLE_WORDS, 0)
            starts = np.unique((np.array(places)[:, None] - np.arange(lead + 1)[None, :]).ravel())
            starts = starts[(starts >= 0) & (starts <= n - span)]
            if not len(starts):
                continue
            q, s, distance = index.find(fingerprints(sums[starts + span] - sums[starts]))
            for k, item, d in zip(starts[q].tolist(), own[s].tolist(), distance.tolist()):
                window = set(shingles[k : k + max(span - SHINGLE_WORDS + 1, 1)].tolist())
                value = self.similar(window, item)
                if value >= self.similarity:
                    old = best.get(item)
                    row = (value, -k, span, d)
                    best[item] = (max(old[0], row), old[1] + 1) if old else (row, 1)
        for item, ((value, k, span, d), windows) in sorted(best.items()):
            yield item, -k, span, d, value, windows


_built: dict[str, Items] = {}  # of this process, by the block's name


def built(name: str, block, similarity: float, radius: int) -> Items:
    """The items of a broadcast block, built once a process."""
    if name not in _built:
        _built.clear()
        _built[name] = Items(*block.value, similarity, radius)
    return _built[name]


def _matched(block, similarity: float, radius: int):
    name = uuid.uuid4().hex
    schema = pa.schema([("doc_id", pa.int64()), ("__rid", pa.int64()), ("item_id", pa.int64()), ("start_word", pa.int64()), ("n_words", pa.int32()), ("hamming", pa.int32()), ("similarity", pa.float64()), ("n_windows", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = built(name, block, similarity, radius)
        for batch in pieces(batches, "text", 1 << 20):
            w = words(texts(batch))
            h, owner, _ = shingle_hashes(w)
            seeds = items.seeds(h)
            begins = np.searchsorted(owner, np.arange(len(w.offsets)))
            out = []
            for k in np.unique(owner[seeds]).tolist():
                own = seeds[(seeds >= begins[k]) & (seeds < begins[k + 1])] - begins[k]
                doc, rid = batch.column("doc_id")[k].as_py(), batch.column("__rid")[k].as_py()
                for item, *rest in items.met(w.hashes[w.offsets[k] : w.offsets[k + 1]], h[begins[k] : begins[k + 1]], own):
                    out.append((doc, rid, items.ids[item], *rest))
            for k, item, *rest in items.met_short(w):
                out.append((batch.column("doc_id")[k].as_py(), batch.column("__rid")[k].as_py(), items.ids[item], *rest))
            if out:
                yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)

    return run


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """One row per document and item that it holds (schema MATCH)."""
    docs = settled(docs)
    rows = with_row_id(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))).select("doc_id", "__rid", "text")
    blocks: list[list[tuple[int, str]]] = [[]]
    size = 0
    for r in benchmark.select(F.col("item_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text")).toLocalIterator():
        if size + len(r[1]) > BLOCK_BYTES and blocks[-1]:
            blocks.append([])
            size = 0
        blocks[-1].append((r[0], r[1]))
        size += len(r[1])
    held = held_by(blocks)
    context = docs.sparkSession.sparkContext
    return reduce(DataFrame.unionByName, [rows.mapInArrow(_matched(context.broadcast((b, held)), similarity, radius), MATCH) for b in blocks])


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that hold no item, with all their columns."""
    docs = settled(docs)
    gone = staged(matches(docs, benchmark, id_col, text_col).select("__rid").distinct(), "leaks")
    return with_row_id(docs).join(checked_broadcast(gone, gone.count(), 1_000_000), "__rid", "left_anti").drop("__rid")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start_word", "n_words", "hamming", F.round("similarity", 9).alias("similarity"), "n_windows")
