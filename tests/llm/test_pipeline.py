"""The pipeline's stages against brute force, and on odd and empty tables."""

import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from loomspan.llm import quality
from loomspan.llm.common import staged
from loomspan.llm.tokenize import chunk_tokenizer, public_path

from .conftest import SF
from .test_dedup import brute_classes


def kept_by_quality(spark, docs):
    """What the fitted ranking says of each text, one at a time."""
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    return [r for r in docs.collect() if model.score(quality.features([r.text or ""]))[0] >= quality.THRESHOLD]


def grams(text, n=5):
    words = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", text.lower())
    return words, [tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []


def leaks(text, items):
    """Whether a window of the text is a benchmark item by weighted similarity; windows from every word on."""
    from math import log1p

    held = {}
    for x in items:
        for s in set(grams(x)[1]):
            held[s] = held.get(s, 0) + 1
    weight = lambda s: log1p(len(items) / held.get(s, 1))
    words, _ = grams(text)
    for x in items:
        own, shingles = grams(x)
        n = min(len(own), len(words))
        target = set(shingles)
        if not target or not n or not target & set(grams(text)[1]):
            continue
        for k in range(len(words) - n + 1):
            window = {tuple(words[k + i : k + i + 5]) for i in range(max(1, n - 4))}
            if window & target and sum(map(weight, window & target)) >= 0.8 * sum(map(weight, window | target)):
                return True
    return False


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = kept_by_quality(spark, docs)
    first = {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r)
    rows = list(first.values())
    classes, _ = brute_classes([(r.doc_id, r.text or "") for r in rows])
    rows = [r for r in rows if classes[r.doc_id] == r.doc_id]
    items = [r.text or "" for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [r for r in rows if not leaks(r.text or "", items)]
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert set(got.doc_id) == {r.doc_id for r in rows} and len(rows) > 20
    own = chunk_tokenizer(public_path("byte_bpe_50k.json"), False).tokenizer
    sizes = {r.doc_id: len(own.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in rows}
    assert got.groupby("doc_id").length.sum().to_dict() == sizes
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.cumsum(g.length) - g.length).all() and g.length.sum() <= 1024


def through(spark, docs):
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = staged(stage(spark, docs, SF), "odd-stage")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        docs = out
    return docs


def test_pipeline_of_odd_and_empty_tables(spark, odd_docs, no_docs):
    assert through(spark, no_docs).count() == 0
    out = through(spark, odd_docs).toPandas()
    assert out.doc_id.value_counts(dropna=False).index.size <= odd_docs.select("doc_id").distinct().count()
    nulls = odd_docs.select("doc_id", F.lit(None).cast("string").alias("text"), F.lit(1).alias("labels"))
    assert through(spark, nulls).count() in (0, 1)
