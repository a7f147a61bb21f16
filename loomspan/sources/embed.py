"""Embedders behind one function: texts to vectors. Without a model at hand, words are hashed.

``hashed_vectors`` is deterministic: the digest of each lower-case word, tiled over the dimensions and centred,
summed and scaled to length 1. Any other embedder is a function from a list of texts to a 2-d array.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 384
#: Tasks a core in which texts are embedded.
PARTS_A_CORE = 4


@lru_cache(maxsize=50_000)
def _digest(word: str) -> bytes:
    return hashlib.sha256(word.encode()).digest()


def hashed_vectors(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """Sums grow word by word in float32; those of all texts take their next word at once, in the columns before the digest comes again."""
    index: dict[str, int] = {}
    own = [[index.setdefault(w, len(index)) for w in text.lower().split()] for text in texts]
    raw = np.frombuffer(b"".join(map(_digest, index)), dtype=np.uint8).reshape(len(index), -1)[:, :dimensions] if index else np.zeros((0, min(dimensions, 32)), dtype=np.uint8)
    vectors = raw / 255.0 - 0.5
    order = sorted(range(len(own)), key=lambda k: -len(own[k]))
    lengths = np.array([len(own[k]) for k in order], dtype=np.int64)
    words = np.fromiter((i for k in order for i in own[k]), dtype=np.int64, count=int(lengths.sum()))
    begin = np.cumsum(lengths) - lengths
    sums = np.zeros((len(own), vectors.shape[1]), dtype=np.float32)
    longest = int(lengths[0]) if len(own) else 0
    for j, n in enumerate(np.searchsorted(-lengths, -np.arange(longest)).tolist()):  # the n texts with more than j words
        sums[:n] += vectors[words[begin[:n] + j]]
    out = np.zeros((len(own), dimensions), dtype=np.float32)
    out[order] = np.resize(sums.T, (dimensions, len(own))).T
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def halving(embed: Callable[[list[str]], np.ndarray], error: type[Exception] = ValueError) -> Callable[[list[str]], np.ndarray]:
    """An embedder that tries a refused batch again in halves, and a refused text with half of it."""

    def run(texts: list[str]) -> np.ndarray:
        try:
            return embed(texts)
        except error:
            if len(texts) > 1:
                half = len(texts) // 2
                return np.concatenate([run(texts[:half]), run(texts[half:])])
            if len(texts[0]) < 2:
                raise
            return run([texts[0][: len(texts[0]) // 2]])

    return run


def embedded(rows: DataFrame, text: str, embed: Callable[[list[str]], np.ndarray] = hashed_vectors, batch: int = 64) -> DataFrame:
    """Adds ``embedding``; each distinct text of a batch is embedded once, by texts about as long as each other, empty texts have none."""

    @F.pandas_udf("array<float>")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            distinct = sorted((x for x in dict.fromkeys(s) if x), key=len)
            found: dict[str, list[float]] = {}
            for k in range(0, len(distinct), batch):
                part = distinct[k : k + batch]
                found.update(zip(part, embed(part).tolist()))
            yield pd.Series([found.get(x) for x in s], dtype=object)

    return rows.withColumn("embedding", run(text))


def cached(rows: DataFrame, cache: DataFrame, text: str, salt: str, embed: Callable[[list[str]], np.ndarray] = hashed_vectors) -> DataFrame:
    """Rows with content_hash, embedding and ``hit``; only texts that the cache lacks are embedded."""
    own = rows.withColumn("content_hash", F.sha2(F.concat(F.lit(f"{salt}:"), F.col(text)), 256))
    known = own.join(cache.select("content_hash", F.col("embedding").alias("known")), "content_hash", "left")
    # A given number of parts, since embedding takes long for few bytes, which Spark would put together in few tasks.
    parts = PARTS_A_CORE * rows.sparkSession.sparkContext.defaultParallelism
    lacking = known.where("known is null").select("content_hash", text).repartition(parts, "content_hash").dropDuplicates(["content_hash"])
    fresh = embedded(lacking, text, embed).select("content_hash", F.col("embedding").alias("fresh"))
    return known.join(fresh, "content_hash", "left").withColumn("hit", F.col("known").isNotNull()).withColumn("embedding", F.coalesce("known", "fresh")).drop("known", "fresh")
