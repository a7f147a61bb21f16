"""Compressing chunks for serving: pass-through, cache, an optional summariser, and truncation.

chunks: id, content, chunk_type, confidence_score, embedding. The cache has (chunk_id, level, compressed).
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import TRUNCATION
from ..functions.text import fallback, keeps_identifiers, signature

PASS_SCORE = 0.8
#: What a summariser is asked for, by kind of chunk.
ASKED = {"decision": "what was decided, why, and the outcome", "module": "what it does, its role and its dependencies", "doc": "the key information without boilerplate", "code": "name, purpose, inputs, outputs and side effects"}


def kind(chunk_type: str) -> str:
    return chunk_type if chunk_type in ASKED else "code"


def shortened(chunks: DataFrame, level: str) -> DataFrame:
    """Adds ``short``: the signature of functions and classes, the head of others."""
    limit = TRUNCATION.get(level, TRUNCATION["standard"])
    own = F.when(F.col("chunk_type").isin("function", "class"), signature(F.col("content"), limit)).otherwise(fallback(F.col("content"), F.lit(level)))
    return chunks.withColumn("short", own)


def compressed(chunks: DataFrame, level: str, cache: DataFrame | None = None, summarise: Callable[[str, str], str] | None = None) -> DataFrame:
    """Adds ``compressed_content`` and ``origin`` (passed, cached, summary or short).

    At level full, confident chunks and those without an embedding pass. A summary counts only if it names enough
    of the chunk's identifiers, and none is asked for at level minimal.
    """
    own = shortened(chunks, level)
    passes = (F.col("confidence_score") > PASS_SCORE) | F.col("embedding").isNull() if level == "full" else F.lit(False)
    if cache is None:
        own = own.withColumn("cached", F.lit(None).cast("string"))
    else:
        known = cache.where(F.col("level") == level).select(F.col("chunk_id").alias("id"), F.col("compressed").alias("cached"))
        own = own.join(known, "id", "left")
    summary = F.lit(None).cast("string")
    if summarise is not None and level != "minimal":

        @F.pandas_udf("string")
        def ask(content: pd.Series, chunk_type: pd.Series) -> pd.Series:
            return pd.Series([None if c is None else summarise(ASKED[kind(t)], c) for c, t in zip(content, chunk_type)])

        wanted = ~passes & F.col("cached").isNull()
        summary = ask(F.when(wanted, F.col("content")), F.col("chunk_type"))
    own = own.withColumn("passes", passes).withColumn("summary", summary)
    good = F.col("summary").isNotNull() & keeps_identifiers(F.col("content"), F.coalesce("summary", F.lit("")))
    origin = F.when(F.col("passes"), "passed").when(F.col("cached").isNotNull(), "cached").when(good, "summary").otherwise("short")
    own = own.withColumn("origin", origin)
    text = F.when(F.col("origin") == "passed", F.col("content")).when(F.col("origin") == "cached", F.col("cached")).when(F.col("origin") == "summary", F.col("summary")).otherwise(F.col("short"))
    return own.withColumn("compressed_content", text).drop("short", "cached", "passes", "summary")


def cache_rows(done: DataFrame, level: str) -> DataFrame:
    """What a compression adds to the cache."""
    return done.where("origin in ('summary', 'short') and compressed_content <> ''").select(F.col("id").alias("chunk_id"), F.lit(level).alias("level"), F.col("compressed_content").alias("compressed"))
