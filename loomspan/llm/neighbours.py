"""Approximate nearest neighbours by randomly rotated one-bit codes.

Index: every vector, less a common centre, is rotated by a random orthogonal matrix, after zeros have made it
``LEAST_BITS`` components long where it is shorter, and the signs of its components are packed into words of 64 bits; more bits
make estimates sharper. Beside them stand correction scalars: the length of the difference, its agreement with
its own code (inner product of the two unit vectors), and its inner product with the centre.

Search: a query is rotated too and cut to ``QUERY_BITS`` bits a component, so that its product with a code is a sum of bit
counts. Divided by the agreement this estimates the inner product without bias, and the error of a code is below
``EPSILON`` times its standard deviation with a chance of over 0.999 a vector. Vectors whose estimate plus bound reaches the
query's k-th best exact product so far are reranked exactly, on the original components in double precision. So neighbours
that are missed are rare; the tests measure recall against brute force.

The centre is the mean of at most ``SAMPLE`` vectors, those with the smallest hash of id and vector; it moves estimates and
bounds, not what is indexed: every vector is. Queries are taken in chunks of about ``CHUNK`` and sent to all tasks, each a
bounded broadcast; a chunk reads the index once, where its rows are, in blocks of vectors and of queries, and a task returns
its k best for a query. There is no cap on candidates.

Cases: null vectors, those of length zero, and those with null or non-finite components take no part, nor do vectors of
another number of components than the query; copies are candidates each, and ties go to the smaller id, a null id last; rows
with one id are one query (the least vector), and all rows with the query's id are its own, so not candidates; a null id
is no query; fewer candidates than k: all of them; no queries or no vectors: no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table

EPSILON = 3.3
QUERY_BITS = 5
LEAST_BITS = 256
SAMPLE = 4096
CHUNK = 16_384
ROWS, QUERIES, PAIRS = 4096, 128, 16_384
CODE = "id long, x array<double>, code binary, size double, agreement double, along double"


@lru_cache(maxsize=4)
def rotation(dim: int, seed: int = 13) -> np.ndarray:
    """The columns of a random orthogonal matrix that meet the components of a vector; the others meet zeros."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).normal(size=(max(dim, LEAST_BITS), dim)))
    return (q * np.sign(np.diag(r))).T


def packed(positive: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    n, dim = positive.shape
    wide = np.zeros((n, -(-dim // 64) * 64), dtype=bool)
    wide[:, :dim] = positive
    return np.packbits(wide, axis=1, bitorder="little").view("<u8")


def encode(x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes and correction scalars of the rows of x."""
    z = (x - centre) @ rotation(x.shape[1])
    size = np.sqrt((z * z).sum(1))
    agreement = np.where(size > 0, np.abs(z).sum(1) / np.maximum(size, 1e-300) / np.sqrt(z.shape[1]), 1.0)
    return packed(z > 0), size, np.minimum(agreement, 1.0), x @ centre


class Queries:
    """Queries of one dimension, rotated and cut to bit planes, with the k best that a task has found so far."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, centre: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        z = (x - centre) @ rotation(x.shape[1])
        self.bits = z.shape[1]
        self.length = np.sqrt((z * z).sum(1))
        self.base, self.total = x @ centre - centre @ centre, z.sum(1)
        self.low = z.min(1)
        self.step = np.maximum((z.max(1) - self.low) / ((1 << QUERY_BITS) - 1), 1e-300)
        level = np.rint((z - self.low[:, None]) / self.step[:, None]).astype(np.int64)
        rest = z - self.low[:, None] - level * self.step[:, None]
        self.rest = np.sqrt((rest * rest).sum(1))
        self.planes = [packed((level >> b & 1).astype(bool)) for b in range(QUERY_BITS)]
        self.score = np.full((len(ids), k), -np.inf)
        self.found = np.zeros((len(ids), k), dtype=np.int64)
        self.unnamed = np.zeros((len(ids), k), dtype=bool)  # the candidate's id is null

    def estimates(self, part: slice, code: np.ndarray, size: np.ndarray, agreement: np.ndarray, along: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products of a block of queries and a block of vectors, and their error bounds."""
        root = np.sqrt(self.bits)
        bits = np.bitwise_count(code).sum(1).astype(np.float32)
        sums = np.zeros((part.stop - part.start, len(code)), dtype=np.float32)
        for b, plane in enumerate(self.planes):
            own = np.zeros(sums.shape, dtype=np.uint16)
            for w in range(code.shape[1]):
                own += np.bitwise_count(plane[part, w, None] & code[None, :, w])
            sums += own * np.float32(1 << b)
        low, step = self.low[part, None].astype(np.float32), self.step[part, None].astype(np.float32)
        scale = (size / agreement / root).astype(np.float32)
        product = (2 * (low * bits + step * sums) - self.total[part, None].astype(np.float32)) * scale + along.astype(np.float32) + self.base[part, None].astype(np.float32)
        code_error = size * np.sqrt(np.maximum(1 - agreement**2, 0)) / agreement / np.sqrt(max(self.bits - 1, 1))
        query_error = size / agreement / root
        bound = EPSILON * (self.length[part, None].astype(np.float32) * code_error.astype(np.float32) + self.rest[part, None].astype(np.float32) * query_error.astype(np.float32))
        return product, bound + np.float32(1e-5) * (np.abs(product) + self.length[part, None].astype(np.float32) * size.astype(np.float32))

    def exact(self, q: np.ndarray, x: np.ndarray, v: np.ndarray) -> np.ndarray:
        out = np.empty(len(q))
        for a in range(0, len(q), PAIRS):
            out[a : a + PAIRS] = np.einsum("ij,ij->i", self.x[q[a : a + PAIRS]], x[v[a : a + PAIRS]])
        return out

    def offer(self, ids: np.ndarray, unnamed: np.ndarray, x: np.ndarray, code: np.ndarray, size: np.ndarray, agreement: np.ndarray, along: np.ndarray) -> int:
        """Takes what a block of vectors has for the k best of every query; returns how many pairs were reranked."""
        ranked = 0
        for a in range(0, len(self.ids), QUERIES):
            part = slice(a, min(a + QUERIES, len(self.ids)))
            near, bound = self.estimates(part, code, size, agreement, along)
            own = (self.ids[part, None] == ids[None, :]) & ~unnamed[None, :]
            near[own] = -np.inf
            least = self.score[part, -1]
            top = min(2 * self.k, len(ids))
            if len(ids) > self.k:  # the best by estimate give a bound at once
                first = np.argpartition(-near, top - 1, axis=1)[:, :top]
                q = np.repeat(np.arange(part.start, part.stop), top)
                got = self.exact(q, x, first.ravel()).reshape(-1, top)
                got[np.take_along_axis(own, first, 1)] = -np.inf
                ranked += len(q)
                if top >= self.k:
                    least = np.maximum(least, -np.partition(-got, self.k - 1, axis=1)[:, self.k - 1])
            slack = 1e-12 * (1 + np.abs(np.where(np.isfinite(least), least, 0)))
            q, v = np.nonzero((near + bound >= (least - slack)[:, None]) & ~own)
            ranked += len(q)
            score = self.exact(q + a, x, v)
            good = score >= (least - slack)[q]
            q, v = q[good], v[good]
            if not len(q):
                continue
            score = np.empty(len(q))
            for c in range(0, len(q), PAIRS):  # added in the order of components
                score[c : c + PAIRS] = np.cumsum(self.x[q[c : c + PAIRS] + a] * x[v[c : c + PAIRS]], axis=1)[:, -1]
            self.merge(a, q, score, ids[v], unnamed[v])
        return ranked

    def merge(self, a: int, q: np.ndarray, score: np.ndarray, ids: np.ndarray, unnamed: np.ndarray) -> None:
        rows = np.unique(q)
        held = np.repeat(rows, self.k)
        q, score = np.r_[held, q], np.r_[self.score[rows + a].ravel(), score]
        ids, unnamed = np.r_[self.found[rows + a].ravel(), ids], np.r_[self.unnamed[rows + a].ravel(), unnamed]
        by = np.lexsort((ids, unnamed, -score, q))
        begin = np.flatnonzero(np.diff(q[by], prepend=-1))
        best = by[(begin[:, None] + np.arange(self.k)).ravel()]
        self.score[rows + a] = score[best].reshape(-1, self.k)
        self.found[rows + a] = ids[best].reshape(-1, self.k)
        self.unnamed[rows + a] = unnamed[best].reshape(-1, self.k)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x): the vectors that take part."""
    x = F.transform(vector_col, lambda c: c.cast("double"))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), x.alias("x"))
    return rows.where(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("x", lambda c: c != 0))


def centres(vectors: DataFrame, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """The mean of a bounded sample for each number of components."""
    rows = vectors.orderBy(F.xxhash64("id", "x"), "id", "x").limit(sample).select("x").collect()
    found: dict[int, list] = {}
    for r in rows:
        found.setdefault(len(r["x"]), []).append(r["x"])
    return {d: np.array(x).mean(0) for d, x in found.items()}


def by_length(batch: pa.RecordBatch, most: int) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """Blocks of up to ``most`` rows with one number of components, and these."""
    length = pc.list_value_length(batch.column("x")).to_numpy()
    for dim in np.unique(length).tolist():
        rows = batch if (length == dim).all() else batch.filter(pa.array(length == dim))
        for a in range(0, rows.num_rows, most):
            part = rows.slice(a, most)
            yield dim, part, part.column("x").flatten().to_numpy().reshape(-1, dim)


def index(vectors: DataFrame, means: dict[int, np.ndarray] | None = None) -> DataFrame:
    """The kept index: code and correction scalars beside every vector (id, x)."""
    means = centres(vectors) if means is None else means

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part, x in by_length(batch, ROWS):
                code, size, agreement, along = encode(x, means.get(dim, np.zeros(dim)))
                yield pa.record_batch([part.column("id"), part.column("x"), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(size), pa.array(agreement), pa.array(along)], names=["id", "x", "code", "size", "agreement", "along"])

    return staged(vectors.mapInArrow(run, CODE), "codes")


def searched(kept: DataFrame, means: dict[int, np.ndarray], chunk: list, k: int) -> DataFrame:
    """(query_id, vec_id, score): for one chunk of queries the k best of every task."""
    shared = kept.sparkSession.sparkContext.broadcast({d: (np.array([r["id"] for r in own], dtype=np.int64), np.array([r["x"] for r in own])) for d in {len(r["x"]) for r in chunk} if (own := [r for r in chunk if len(r["x"]) == d])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = {d: Queries(ids, x, means.get(d, np.zeros(d)), k) for d, (ids, x) in shared.value.items()}
        for batch in batches:
            for dim, part, x in by_length(batch, ROWS):
                if dim in asked:
                    code = np.frombuffer(b"".join(part.column("code").to_pylist()), "<u8").reshape(len(x), -1)
                    scalars = [part.column(c).to_numpy() for c in ("size", "agreement", "along")]
                    asked[dim].offer(part.column("id").fill_null(0).to_numpy(), part.column("id").is_null().to_numpy(zero_copy_only=False), x, code, *scalars)
        for q in asked.values():
            row, col = np.nonzero(q.score > -np.inf)
            yield pa.record_batch([pa.array(q.ids[row]), pa.array(q.found[row, col], pa.int64(), mask=q.unnamed[row, col]), pa.array(q.score[row, col])], names=["query_id", "vec_id", "score"])

    return kept.mapInArrow(run, "query_id long, vec_id long, score double")


def search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest of ``vectors`` (id, x) for each of ``queries`` (id, x), by inner product."""
    means = centres(vectors)
    kept = index(vectors, means)
    asked = staged(queries.where("id is not null").groupBy("id").agg(F.min("x").alias("x")), "asked")
    parts = -(-asked.count() // CHUNK)
    best = None
    for i in range(parts):
        chunk = asked.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == i).collect()
        found = searched(kept, means, chunk, k)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
        found = staged(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "nearest")
        best = found if best is None else best.unionByName(found)
    if best is None:
        best = asked.select(F.col("id").alias("query_id"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"), F.lit(1).alias("rank")).where("false")
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op13_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return search(vectors, vectors.where("id % 20 = 0"), 20)


OP13_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings
    WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.x, v.x) AS score FROM v q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id AND len(q.x) = len(v.x))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""
