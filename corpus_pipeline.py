"""The corpus pipeline: documents through five stages to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes what a stage returns as Parquet
in the shared folder and reads it again as the next one's documents. All stages but the last return rows of
the documents they keep, with all columns unchanged.

1. quality: the Bradley-Terry ranking is fitted on labelled rows; documents below the threshold go.
2. exact dedup: of equal texts the row with the smallest doc_id stays.
3. near dedup: of each class of texts with Jaccard similarity of 0.8 or more one stays.
4. decontamination: documents that hold a benchmark item go.
5. packing: byte-level BPE ids of the rest in sequences of 1024 tokens.

Cases: a null text counts as empty, has a quality score like any other, and is packed as the end id alone; a null doc_id
stands last where the smallest id stays, and is packed as null; of repeated rows one stays; ties go to the smallest
row id; an empty table goes through all stages as one; columns of any name are kept up to packing.

SQL can express neither the fitted ranking nor the tokenizer, so there is no ORACLE_SQL; tests hold the
stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import decontaminate, exact_dedup, near_dedup, packing, quality
from loomspan.llm.common import staged, table
from loomspan.llm.tokenize import public_path

ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = packing.pack(docs, public_path("byte_bpe_50k.json"), end_id=0)
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_dedup_stage),
    ("n-gram Jaccard join", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that all stages keep."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"stage-{k}")
    return docs
