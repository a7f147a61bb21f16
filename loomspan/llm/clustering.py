"""Centroid clustering by dual-tree Lloyd rounds over whole numbers.

Vectors are put into blocks where they are read, and a cover tree is built over each block once and written to
the shared folder. In each round a cover tree is built over the centroids, and every block walks both trees at once
(``cover_tree.nearest``): pairs of nodes are pruned by distance bounds, leaves are compared exactly. A task returns sums
and counts of its blocks for each centroid, Spark adds them, and only these k rows reach the driver. So the result is that
of plain Lloyd rounds in every digit, on any partitioning.

Cases: vectors that are null, of another length, or hold null or non-finite components are left out; repeated rows and
copies count each (a tree holds distinct points, with copies beside them); an empty centroid stays; ties go to the smaller number;
fewer vectors than centroids: all vectors start one; no vectors: no rows; null ids are kept and come last where ids choose the
starts; components so large that a squared distance exceeds 64 bits raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table
from .cover_tree import Centroids, Tree, nearest, squared_pairs

BLOCK = 2048
LEAF = 8
DIM, CENTROIDS, ROUNDS, SCALE = 64, 8, 10, 1024


def whole(vectors: DataFrame, id_col: str, vector_col: str, dim: int, scale: int) -> DataFrame:
    """(id, x): vectors of ``dim`` finite components, as floor(scale * component)."""
    good = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    x = F.transform(vector_col, lambda c: F.floor(F.lit(scale) * c.cast("double")))
    return vectors.where((F.size(vector_col) == dim) & good).select(F.col(id_col).alias("id"), x.alias("x"))


def trees(vectors: DataFrame, dim: int, block: int = BLOCK) -> DataFrame:
    """A row for each block of vectors (id, x): the ids and its cover tree."""
    kind = vectors.schema["id"].dataType.simpleString()
    fields = ("points", "order", "nodes", "radius")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id")
            rows = batch.column("x").flatten().to_numpy().reshape(-1, dim)
            for k in range(0, len(rows), block):
                packed = Tree.over(rows[k : k + block], LEAF).packed()
                yield pa.record_batch([pa.array([ids.slice(k, block).to_pylist()], pa.list_(ids.type)), *(pa.array([packed[f]], pa.binary()) for f in fields)], names=["ids", *fields])

    return staged(vectors.mapInArrow(run, f"ids array<{kind}>, " + ", ".join(f"`{f}` binary" for f in fields)), "trees")


def blocks(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[pa.Array, Tree]]:
    for i in range(batch.num_rows):
        parts = {f: batch.column(f)[i].as_py() for f in ("points", "order", "nodes", "radius")}
        yield batch.column("ids")[i].values, Tree.unpacked(**parts, dim=dim)


def moved(forest: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Centroids.of(centroids)
        n, sums = np.zeros(k, dtype=np.int64), np.zeros((k, dim), dtype=np.int64)
        for batch in batches:
            for _, t in blocks(batch, dim):
                found, _ = nearest(t, c)
                copies = np.bincount(t.order, minlength=len(found))
                np.add.at(n, found, copies)
                for j in range(k):
                    own = found == j
                    sums[j] += (t.points[own] * copies[own][:, None]).sum(0)
        yield pa.record_batch([pa.array(np.arange(k, dtype=np.int32)), pa.array(n), pa.array(sums.tolist(), pa.list_(pa.int64()))], names=["k", "n", "s"])

    parts = forest.mapInArrow(run, "k int, n long, s array<long>").where("n > 0").groupBy("k")
    after = centroids.copy()
    for row in parts.agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dim)]).collect():
        after[row["k"]] = [int(row[f"s{i}"]) // row["n"] for i in range(dim)]
    return after


def assigned(forest: DataFrame, centroids: np.ndarray, kind: str) -> DataFrame:
    """(id, cluster, distance) of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Centroids.of(centroids)
        for batch in batches:
            for ids, t in blocks(batch, centroids.shape[1]):
                found, _ = nearest(t, c)
                distance = squared_pairs(t.points, centroids[found])
                yield pa.record_batch([ids, pa.array(found[t.order].astype(np.int32)), pa.array(distance[t.order])], names=["id", "cluster", "distance"])

    return forest.mapInArrow(run, f"id {kind}, cluster int, distance long")


def clustered(vectors: DataFrame, starts: np.ndarray, rounds: int) -> tuple[DataFrame, np.ndarray]:
    """Every vector (id, x) with its cluster and squared distance after ``rounds``, as a staged table, and the final centroids."""
    kind, dim = vectors.schema["id"].dataType.simpleString(), starts.shape[1]
    forest = trees(vectors, dim)
    for _ in range(rounds):
        starts = moved(forest, starts)
    return staged(assigned(forest, starts, kind), "clusters"), starts


def op12_dual_tree_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", DIM, SCALE)
    digest = F.sha2(F.concat(F.lit("3:"), F.col("id").cast("string")), 256)
    first = vectors.orderBy(digest.asc_nulls_last(), "x").limit(CENTROIDS).collect()
    starts = np.array([r["x"] for r in first], dtype=np.int64).reshape(-1, DIM)
    if not len(starts):
        empty = vectors.select(F.col("id").alias("vec_id"), F.lit(0).alias("cluster"), *(F.lit(0).cast("bigint").alias(c) for c in ("distance", "cluster_inertia", "inertia")), F.lit("").alias("centroid_sha256"))
        return empty.where("false")
    found, last = clustered(vectors, starts, ROUNDS)
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in last.tolist()]
    facts = spark.createDataFrame([(k, s, sum(sums.values()), digests[k]) for k, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    distance = "list_sum(list_transform(list_zip(a.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    near = "SELECT a.vec_id, a.v, c.k, CAST({d} AS BIGINT) AS d FROM kept a, c{i} c QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY CAST({d} AS BIGINT), c.k) = 1"
    parts = [
        f"kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS k, v FROM kept ORDER BY sha256('3:' || vec_id) LIMIT {CENTROIDS})",
    ]
    for i in range(ROUNDS + 1):
        parts.append(f"a{i} AS MATERIALIZED ({near.format(d=distance, i=i)})")
        if i < ROUNDS:
            parts.append(f"m{i} AS MATERIALIZED (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS v FROM (SELECT k, j, sum(v[j]) AS s, count(*) AS n FROM a{i}, range(1, {DIM + 1}) r(j) GROUP BY k, j) GROUP BY k)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m ON m.k = c.k)")
    last = ROUNDS
    return f"WITH {', '.join(parts)} SELECT a.vec_id, CAST(a.k AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{last} a JOIN c{last} c ON c.k = a.k"


OP12_SQL = _sql()
