import random

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta omega river stone cloud night light paper glass metal green early".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(f"{r.choice(WORDS)}{r.randrange(40)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns with clashing names."""
    rows = [(1, "same text here for all of us"), (2, "same  text\there for all of us"), (1, "same text here for all of us"), (None, "no id at all in this row"), (5, None), (6, ""), (7, prose(1, 30_000)), (8, " \n\n "), (9, "ß ü É 漢字 \u00a0 x"), (10, "!!! ***")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("n", "key", "keys", "component", "digest", "keep_id", "score", "label", "lo", "hi", "line", "k"):
        df = df.withColumn(name, F.lit(f"own {name}"))
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")
