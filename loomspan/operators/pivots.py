"""Exact nearest neighbours (L2) with fewer distances: cells around pivots, pruned by the triangle inequality.

Some pivots are chosen far apart from a bounded sample, and each vector is put into the cell of its nearest one. Cells are written as
blocks of vectors sorted by their distance to the pivot, cut by ranges of (cell, distance), so that a large cell is many
tasks' own. A query first meets its own cell, which gives a bound on its k-th distance; then only cells that the bound
reaches, and in them only vectors whose distance to the pivot differs from the query's by no more than the bound. Queries meet blocks
by cell, many at once, with one matrix product a pair of blocks; what can be among the k nearest is measured again in the order of
components. There is no cross join, and the result is exact whatever the pivots are: they only decide how much is pruned, which is much
where vectors lie in clouds and little where all are about as far from each other. ``computed`` tells how many distances a query took.

Cases: null vectors and queries take no part; all others have one number of components; ties go to the smaller id; fewer vectors
than k: all of them; repeated queries have to be the same vector; no vectors or no queries: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import scratch
from .search import small_as, top

PIVOTS, SAMPLE, BLOCK, CHUNK = 64, 2_048, 512, 256


def chosen(sample: np.ndarray, most: int) -> np.ndarray:
    """Rows of a sample, each the farthest from those before it."""
    found = [0] if len(sample) else []
    near = np.full(len(sample), np.inf)
    while found and len(found) < min(most, len(sample)):
        near = np.minimum(near, ((sample - sample[found[-1]]) ** 2).sum(1))
        far = int(near.argmax())
        if near[far] <= 0:
            break
        found.append(far)
    return sample[found]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _blocks(vectors: DataFrame, pivots: np.ndarray, block: int) -> DataFrame:
    """(cell, low, high, ids, near, x): blocks of a cell by distance to its pivot, in a table of their own."""
    kind = vectors.schema["id"].dataType.simpleString()

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = distances(_matrix(batch.column("x")), pivots)
                cell = d.argmin(1)
                yield pa.record_batch([pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell]), batch.column("id"), batch.column("x")], names=["cell", "near", "id", "x"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, near = batch.column("cell").to_numpy(), batch.column("near").to_numpy()
            cuts = np.flatnonzero(np.diff(cell, prepend=-1)).tolist() + [len(cell)]
            for a, b in zip(cuts, cuts[1:]):
                for k in range(a, b, block):
                    part = slice(k, min(k + block, b))
                    ids, x = (batch.column(c).slice(k, part.stop - k) for c in ("id", "x"))
                    row = [pa.array([cell[k]], pa.int32()), pa.array([near[part][0]]), pa.array([near[part][-1]]), pa.array([ids.to_pylist()], pa.list_(ids.type)), pa.array([near[part].tobytes()], pa.binary()), pa.array([_matrix(x).tobytes()], pa.binary())]
                    yield pa.record_batch(row, names=["cell", "low", "high", "ids", "near", "x"])

    rows = vectors.mapInArrow(placed, f"cell int, near double, id {kind}, x array<double>").repartitionByRange("cell", "near").sortWithinPartitions("cell", "near")
    schema = f"cell int, low double, high double, ids array<{kind}>, near binary, x binary"
    path = scratch.folder(vectors.sparkSession, "cells")
    rows.mapInArrow(packed, schema).write.parquet(path)
    return vectors.sparkSession.read.schema(schema).parquet(path)


def _met(asked: DataFrame, blocks: DataFrame, k: int, kinds: tuple[str, str], chunks: int) -> DataFrame:
    """(query_id, id, distance, computed) of queries (cell, query_id, q, d, bound) and the blocks of their cells."""
    parts = asked.groupBy("cell", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).alias("chunk")).agg(F.collect_list(F.struct("query_id", "q", "d", "bound")).alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = batch.column("own")[i].values
                q, d, bound = _matrix(own.field("q")), own.field("d").to_numpy(), own.field("bound").to_numpy()
                near = np.frombuffer(batch.column("near")[i].as_py())
                x = np.frombuffer(batch.column("x")[i].as_py()).reshape(len(near), -1)
                slack = 1e-9 * (1 + np.abs(d))
                first, last = np.searchsorted(near, d - bound - slack), np.searchsorted(near, d + bound + slack, "right")
                some = np.flatnonzero(last > first)
                if not len(some):
                    continue
                a, b = int(first[some].min()), int(last[some].max())
                found = distances(q[some], x[a:b])
                ring = (np.arange(a, b)[None, :] >= first[some][:, None]) & (np.arange(a, b)[None, :] < last[some][:, None])
                found[~ring] = np.inf
                cut = bound[some] + slack[some]
                if b - a > k:
                    cut = np.minimum(cut, np.partition(found, k - 1, axis=1)[:, k - 1] + 1e-6)
                row, col = np.nonzero((found <= cut[:, None]) & ring)
                exact = np.empty(len(row))
                for s in range(0, len(row), 16_384):
                    e = slice(s, s + 16_384)
                    exact[e] = np.sqrt(np.cumsum((q[some[row[e]]] - x[a + col[e]]) ** 2, axis=1)[:, -1])
                names = own.field("query_id")
                ids = batch.column("ids")[i].values
                none = pa.nulls(len(some))
                yield pa.record_batch([names.take(pa.array(some[row])), ids.take(pa.array(a + col)), pa.array(exact), pa.array(np.zeros(len(row), dtype=np.int64))], names=["query_id", "id", "distance", "computed"])
                yield pa.record_batch([names.take(pa.array(some)), none.cast(ids.type), none.cast(pa.float64()), pa.array(ring.sum(1).astype(np.int64))], names=["query_id", "id", "distance", "computed"])

    return small_as(parts, parts, 1_000).join(blocks, "cell").select("own", "ids", "near", "x").mapInArrow(run, f"query_id {kinds[0]}, id {kinds[1]}, distance double, computed long")


def knn(queries: DataFrame, vectors: DataFrame, k: int, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """(query_id, id, distance, rank, computed) of the k nearest; queries (query_id, query), vectors (id, embedding)."""
    spark = vectors.sparkSession
    own = vectors.where("embedding is not null").select("id", F.transform("embedding", lambda c: c.cast("double")).alias("x"))
    asked = queries.where("query is not null").select("query_id", F.transform("query", lambda c: c.cast("double")).alias("q"))
    kinds = (asked.schema["query_id"].dataType.simpleString(), own.schema["id"].dataType.simpleString())
    sample = own.orderBy(F.xxhash64("x"), "x").limit(SAMPLE).select("x").collect()
    centres = chosen(np.array([r["x"] for r in sample], dtype=float), pivots)
    if not len(centres):
        return spark.createDataFrame([], f"query_id {kinds[0]}, id {kinds[1]}, distance double, rank int, computed long")
    blocks = _blocks(own, centres, block)
    radius = {r["cell"]: r["high"] for r in blocks.groupBy("cell").agg(F.max("high").alias("high")).collect()}  # a row for each pivot

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.append_column("ds", pa.array(distances(_matrix(batch.column("q")), centres).tolist(), pa.list_(pa.float64())))

    path = scratch.folder(spark, "asked")
    asked.mapInArrow(measured, f"query_id {kinds[0]}, q array<double>, ds array<double>").write.parquet(path)
    asked = spark.read.schema(f"query_id {kinds[0]}, q array<double>, ds array<double>").parquet(path)
    chunks = max(1, -(-asked.count() // CHUNK))
    cells = F.array(*(F.lit(float(radius.get(c, -np.inf))) for c in range(len(centres))))
    each = asked.select("query_id", "q", F.posexplode("ds").alias("cell", "d")).withColumn("radius", F.get(cells, F.col("cell"))).where("radius > double('-infinity')")
    home = each.groupBy("query_id").agg(F.min(F.struct("d", "cell")).alias("x")).select("query_id", F.col("x.cell").alias("home"))
    first = each.join(home, "query_id").where("cell = home").withColumn("bound", F.lit(float("inf")))
    path = scratch.folder(spark, "first")
    _met(first, blocks, k, kinds, chunks).write.parquet(path)
    begun = spark.read.schema(f"query_id {kinds[0]}, id {kinds[1]}, distance double, computed long").parquet(path)
    order = [F.col("distance"), F.col("id")]
    bound = top(begun.where("distance is not null"), k, order).groupBy("query_id").agg(F.count("*").alias("n"), F.max("distance").alias("far"))
    bound = bound.select("query_id", F.when(F.col("n") >= k, F.col("far")).otherwise(float("inf")).alias("bound"))
    rest = each.join(home, "query_id").where("cell <> home").join(bound, "query_id").where("d - radius <= bound * (1 + 1e-9) + 1e-9")
    path = scratch.folder(spark, "rest")
    _met(rest, blocks, k, kinds, chunks).write.parquet(path)
    met = begun.unionByName(spark.read.schema(begun.schema).parquet(path))
    cost = met.groupBy("query_id").agg(F.sum("computed").alias("computed"))
    best = top(met.where("distance is not null").drop("computed"), k, order)
    return best.join(small_as(cost, asked), "query_id")
