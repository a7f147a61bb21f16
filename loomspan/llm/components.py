"""Connected components of a graph of integer nodes, by alternating large and small stars.

Edges are first thinned in each task to a forest of what it has read; then rounds of stars run until
nothing changes. Each round is a table in the shared folder, so lineage stays short and a lost executor
costs a task. Nothing is collected but two numbers a round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


#: Edges up to which the least neighbours of all nodes, two at most an edge, are sent to every task.
BROADCAST_EDGES = 500_000


class Forest:
    """Union-find whose roots are the smallest nodes."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (p := up.get(top, top)) != top:
            top = p
        while (p := up.get(x, x)) != top:
            up[x] = top
            x = p
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if a < b:
            a, b = b, a
        self.up[a] = b
        return True

    def stars(self) -> Iterator[tuple[int, int]]:
        return ((x, self.root(x)) for x in list(self.up))


def _thin(most: int = 250_000):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()

        def out() -> Iterator[pa.RecordBatch]:
            rows = list(forest.stars())
            for i in range(0, len(rows), 50_000):
                a, b = zip(*rows[i : i + 50_000])
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                forest.join(a, b)
            if len(forest.up) > most:
                yield from out()
                forest = Forest()
        yield from out()

    return run


def connected_components(edges: DataFrame, tag: str = "components", thin: bool = True) -> DataFrame:
    """(node, component) of every node that an edge (a, b) touches, smallest node as the component.

    ``thin`` is False where the edges are a forest in each task already, which saves a second Python worker a task.
    """
    some = edges.where("a <> b").select("a", "b")
    now = staged(some.mapInArrow(_thin(), "a bigint, b bigint") if thin else some, tag)
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == seen or state[0] == 0:
            break
        seen = state
        # A hub's edges meet its least neighbour by a broadcast while there are few nodes, else in a join whose
        # both sides are tables, so that Spark can split the hub.
        few = state[0] <= BROADCAST_EDGES
        met = F.broadcast if few else (lambda df: staged(df, tag))
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(met(least), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = large if few else staged(large, tag)
        floor = large.groupBy("a").agg(F.min("b").alias("m"))
        floor = floor if few else staged(floor, tag)
        small = large.join(F.broadcast(floor) if few else floor, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).unionByName(floor.select("a", F.col("m").alias("b")))
        now = staged(small.where("a <> b").distinct(), tag)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
