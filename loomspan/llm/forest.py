"""An LSH forest over MinHash signatures: who meets whom, without looking at texts.

Each of ``TREES`` trees orders all rows by a label of ``DEPTH`` MinHash values of 16 bits. Rows whose labels begin
alike are a node of that tree's prefix trie, and in the sorted order a node is a run of neighbours. Labels are dealt
out by ranges of their order, so a node of any size is spread evenly and no task holds more than its share.

Rows that meet in a node are not linked blindly: a sketch of 128 bits, one of each of as many MinHash values, tells how
alike two rows are up to some noise, and only pairs that may reach the threshold become edges. Nodes are entered at
the shortest prefix, ``shortest_prefix()``, with which a pair at the threshold meets in some tree with the target
recall. A node that is too large for comparing all pairs, or that reaches over the edge of a task, is left for the
longer prefixes below it; at full depth its rows are simply chained. What recall a row still has, with a longer
prefix in some trees, is summed up; as long as it is short of the target, the row's prefixes are shortened value by
value, and what it meets there is chained. So crowded nodes keep long prefixes where the other trees make up for it.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SIMILARITY, checked_broadcast, staged
from .shingles import mixed, numbers

TREES, DEPTH, RECALL = 24, 8, 0.9999
NODE_ROWS = 1_024
SKETCH = 128
#: Of the sketch's bits, those that agree at least: a pair at the threshold has 115 on average, give or take 3.4.
LEAST_AGREE = 100
WIDTH = 1 + 2 * DEPTH
TASK_ROWS = 1_000_000
EDGE, HELD, OPEN = 0, 1, 2


def shortest_prefix(similarity: float = SIMILARITY, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix with which a pair at the similarity meets in one of the trees often enough."""
    for p in range(depth, 0, -1):
        if 1 - (1 - similarity**p) ** trees >= recall:
            return p
    raise ValueError(f"{trees} trees can't reach a recall of {recall} at {similarity}")


def signatures(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(labels, sketches) of sets of hashes, none of them empty: bytes (set, tree, WIDTH) and two words each."""
    n = len(offsets) - 1
    factor, shift = numbers(21, TREES * DEPTH), numbers(22, TREES * DEPTH)
    values = np.empty((n, TREES * DEPTH), dtype=np.uint64)
    for k in range(TREES * DEPTH):
        values[:, k] = np.minimum.reduceat((h * factor[k] + shift[k]) >> np.uint64(16), offsets[:-1])
    values = mixed(values)
    labels = np.empty((n, TREES, WIDTH), dtype=np.uint8)
    labels[:, :, 0] = np.arange(TREES)
    labels[:, :, 1:] = (values & np.uint64(0xFFFF)).astype(">u2").view(np.uint8).reshape(n, TREES, 2 * DEPTH)
    bits = ((values[:, :SKETCH] >> np.uint64(20)) & np.uint64(1)).astype(np.uint8)
    return labels, np.packbits(bits, axis=1).view("<u8")


def depths(labels: np.ndarray) -> np.ndarray:
    """How many values each label shares with the one before it; -1 for the first one and in another tree."""
    same = labels[1:] == labels[:-1]
    units = np.concatenate([same[:, :1], same[:, 1::2] & same[:, 2::2]], axis=1)
    return np.concatenate([[-1], np.cumprod(units, axis=1).sum(axis=1) - 1])


def alike(sketch: np.ndarray) -> Iterator[np.ndarray]:
    """Groups of two rows or more that are connected by pairs with enough agreeing bits."""
    apart = np.bitwise_count(sketch[:, None, 0] ^ sketch[None, :, 0]).astype(np.int16)
    apart += np.bitwise_count(sketch[:, None, 1] ^ sketch[None, :, 1])
    near = apart <= SKETCH - LEAST_AGREE
    left = near.sum(axis=1) > 1
    while left.any():
        group = near[left.argmax()].copy()
        fresh = group
        while fresh.any():
            more = near[fresh].any(axis=0) & ~group
            group |= more
            fresh = more
        left &= ~group
        yield np.flatnonzero(group)


class Trie:
    """One task's stretch of the sorted labels; ``rows`` collects (kind, a, b, prefix, label)."""

    def __init__(self, shortest: int, node_rows: int):
        self.shortest, self.node_rows = shortest, node_rows
        self.rows: list[tuple] = []

    def add(self, labels: np.ndarray, rid: np.ndarray, sketch: np.ndarray, opens: bool, closes: bool) -> None:
        """Links a block of whole nodes; ``opens`` and ``closes`` tell whether its ends are those of the stretch."""
        shared = depths(labels)
        begin = np.flatnonzero(shared < self.shortest)
        end = np.append(begin[1:], len(rid))
        size = end - begin
        inner = np.ones(len(begin), dtype=bool)
        inner[0] &= not opens
        inner[-1] &= not closes
        two = begin[inner & (size == 2)]
        apart = np.bitwise_count(sketch[two] ^ sketch[two + 1]).sum(axis=1)
        two = two[apart <= SKETCH - LEAST_AGREE]
        self.rows += [(EDGE, int(x), int(y), None, None) for x, y in zip(rid[two + 1], rid[two])]
        for k in np.flatnonzero(~inner | (size > 2)).tolist():
            ends = (opens and k == 0, closes and k == len(begin) - 1)
            self._node(labels, rid, sketch, shared, int(begin[k]), int(end[k]), self.shortest, *ends)

    def _node(self, labels, rid, sketch, shared, a: int, b: int, depth: int, opens: bool, closes: bool) -> None:
        if depth == DEPTH:
            self.rows += [(EDGE, int(x), int(rid[a]), None, None) for x in rid[a + 1 : b]]
        elif b - a <= self.node_rows and not opens and not closes:
            for group in alike(sketch[a:b]) if b - a > 1 else ():
                own = rid[a + group]
                self.rows += [(EDGE, int(x), int(own[0]), None, None) for x in own[1:]]
        else:
            starts = [a, *(np.flatnonzero(shared[a + 1 : b] <= depth) + a + 1).tolist()]
            for s, e in zip(starts, [*starts[1:], b]):
                self._node(labels, rid, sketch, shared, s, e, depth + 1, opens and s == a, closes and e == b)
            return
        if depth > self.shortest:
            self.rows += [(HELD, int(rid[k]), None, depth, labels[k].tobytes()) for k in range(a, b)]
        if opens or closes:
            self.rows.append((OPEN, int(rid[a]), None, None, labels[a].tobytes()))

    def batch(self) -> pa.RecordBatch:
        kinds = (pa.int8(), pa.int64(), pa.int64(), pa.int8(), pa.binary())
        columns = list(zip(*self.rows)) or [()] * 5
        self.rows = []
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names=["kind", "a", "b", "prefix", "label"])


def _walk(shortest: int, node_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(shortest, node_rows)
        kept: list[tuple] = []  # the node that the last block ended in
        first = True
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = np.frombuffer(b"".join(batch.column("label").to_pylist()), dtype=np.uint8).reshape(-1, WIDTH)
            sketch = np.stack([batch.column(c).to_numpy().view(np.uint64) for c in ("s0", "s1")], axis=1)
            own = (raw, batch.column("__rid").to_numpy(), sketch)
            if kept and raw[0].tobytes()[: 1 + 2 * shortest] == raw[-1].tobytes()[: 1 + 2 * shortest] == kept[0][0][0].tobytes()[: 1 + 2 * shortest]:
                kept.append(own)  # all of one node
                continue
            whole = tuple(np.concatenate(x) for x in zip(*kept, own))
            cut = int(np.flatnonzero(depths(whole[0]) < shortest)[-1])
            if cut:
                trie.add(*(x[:cut] for x in whole), opens=first, closes=False)
                first = False
            kept = [tuple(x[cut:] for x in whole)]
            if trie.rows:
                yield trie.batch()
        if kept:
            trie.add(*(np.concatenate(x) for x in zip(*kept)), opens=first, closes=True)
            yield trie.batch()

    return run


def _chained(rows: DataFrame, key: Column) -> DataFrame:
    """(a, b): each row of (rid, label) with the smallest row of its key."""
    keyed = rows.select(F.col("rid").alias("a"), key.alias("key"))
    heads = staged(keyed.groupBy("key").agg(F.min("a").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n"), "heads")
    return keyed.join(checked_broadcast(heads, heads.count(), 500_000), "key").where("a <> b").select("a", "b")


def candidates(rows: DataFrame, similarity: float = SIMILARITY, node_rows: int | None = None) -> DataFrame:
    """Edges (a, b) among (__rid, labels, s0, s1) that connect every pair the forest finds."""
    shortest = shortest_prefix(similarity)
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() * TREES // TASK_ROWS)
    each = rows.select(F.explode("labels").alias("label"), "__rid", "s0", "s1")
    sorted_ = each.repartitionByRange(n, "label", "__rid").sortWithinPartitions("label", "__rid")
    walked = staged(sorted_.mapInArrow(_walk(shortest, node_rows or NODE_ROWS), "kind tinyint, a bigint, b bigint, prefix tinyint, label binary"), "forest")
    edges = walked.where(F.col("kind") == EDGE).select("a", "b")
    edges = edges.unionByName(_chained(walked.where(F.col("kind") == OPEN).select(F.col("a").alias("rid"), "label"), F.col("label")))

    held = walked.where(F.col("kind") == HELD).select(F.col("a").alias("rid"), F.col("prefix").cast("int").alias("prefix"), "label")
    lost = [log1p(-(similarity**p)) for p in range(1, DEPTH + 1)]
    more = F.element_at(F.array(*(F.lit(x - lost[shortest - 1]) for x in lost)), F.col("prefix"))
    for p in range(DEPTH - 1, shortest - 1, -1):
        missed = F.exp(F.sum(more) + TREES * lost[shortest - 1])
        short = staged(held.groupBy("rid").agg(missed.alias("missed")).where(F.col("missed") > 1 - RECALL).select("rid"), "short")
        if not (count := short.count()):
            break
        key = F.substring("label", 1, 1 + 2 * p)
        held = held.withColumn("key", F.when(F.col("prefix") > p, key))
        nodes = held.join(checked_broadcast(short, count, 500_000), "rid").where("key is not null").select("key").distinct()
        nodes = staged(nodes.withColumn("met", F.lit(True)), "nodes")
        held = staged(held.join(checked_broadcast(nodes, nodes.count(), 500_000), "key", "left"), "held")
        edges = edges.unionByName(_chained(held.where("met").select("rid", "label"), key))
        held = held.select("rid", F.when(F.col("met"), F.lit(p)).otherwise(F.col("prefix")).alias("prefix"), "label")
    return edges
