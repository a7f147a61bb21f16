"""Quality classifier by Bradley-Terry ranking of preference pairs.

A document's score is a linear function of features of its text; the chance that one document is preferred to
another is the logistic function of the difference of their scores. Each pair of a good and a bad labelled
document is a preference, and the weights minimise the logistic loss on the differences of features.

The score is reported on a scale from 0 to 1 on which the accepting threshold stands at a quantile of the training
scores: that of the share of bad ones among the labels, so a fixed cut means the same rank whatever the features are.

The model is fitted on at most ``max_rows`` labelled rows, those with the smallest hash of the id, one text an id;
texts of all documents are read whole and scored where they are read, with nothing shuffled.

Cases: null text counts as empty; an empty text has a score like any other; rows without a label, with a null
label or of the held-out fold teach nothing, nor do ids with labels of both kinds; of labelled rows with one id the least
text teaches; with labels of one kind only, every document scores the threshold itself; repeated rows are scored each;
other columns are kept by ``scored``, but for one that has the name of the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold_of, pieces, table, texts
from .shingles import words

THRESHOLD = 0.7
MAX_ROWS = 20_000
PAIRS_EACH = 20
SYMBOLS = [c for c in range(33, 127) if not chr(c).isalnum()]
NAMES = [f"share of {chr(c)}" for c in SYMBOLS] + ["letters", "capitals", "digits", "beyond ASCII", "blanks", "line ends", "controls", "word length", "distinct words", "top word", "repeated neighbours", "distinct pairs", "length", "words a line", "capitals of letters"]


def features(batch: list[str]) -> np.ndarray:
    """A row of features for each text, from its bytes and word hashes."""
    raw = [x.encode() for x in batch]
    n = np.array([len(x) for x in raw], dtype=np.int64)
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    owner = np.repeat(np.arange(len(raw)), n)
    counts = np.bincount(owner * 256 + data, minlength=256 * len(raw)).reshape(-1, 256).astype(float)
    size = np.maximum(n, 1)
    share = counts / size[:, None]
    capital, small = share[:, 65:91].sum(1), share[:, 97:123].sum(1)
    digit, high = share[:, 48:58].sum(1), share[:, 128:].sum(1)
    lines = counts[:, 10] + 1
    w = words(batch)
    m = np.diff(w.offsets)
    many = np.maximum(m, 1)
    text = np.repeat(np.arange(len(m)), m)
    order = np.lexsort((w.hashes, text))
    h, o = w.hashes[order], text[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    begin = np.flatnonzero(new)
    run = np.diff(np.append(begin, len(h)))
    top = np.zeros(len(m))
    np.maximum.at(top, o[begin], run)
    distinct = np.bincount(o[begin], minlength=len(m))
    same = text[1:] == text[:-1]
    twice = np.bincount(text[1:][same & (w.hashes[1:] == w.hashes[:-1])], minlength=len(m))
    pair = w.hashes[1:] * np.uint64(3) + w.hashes[:-1]
    pairs = np.unique(np.stack([text[1:][same].astype(np.uint64), pair[same]]), axis=1)[0].astype(np.int64) if same.any() else np.zeros(0, dtype=np.int64)
    pairs = np.bincount(pairs, minlength=len(m))
    log = lambda v: np.log1p(100 * v)
    columns = [log(share[:, c]) for c in SYMBOLS]
    columns += [small + capital, log(capital), log(digit), high, share[:, 32], log(share[:, 10]), log(share[:, :32].sum(1) - share[:, 10]), np.log1p(size / many), distinct / many, log(top / many), log(twice / many), pairs / np.maximum(many - 1, 1), np.log1p(n), np.log1p(m / lines), capital / np.maximum(small + capital, 1e-9)]
    return np.stack(columns, axis=1)


@dataclass(frozen=True)
class Ranking:
    """Weights of standardised features, and the score at the accepting threshold."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; THRESHOLD at the cut."""
        edge = float(np.log(THRESHOLD / (1 - THRESHOLD)))
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.cut + edge, -30, 30)))


def best_cut(scores: np.ndarray, good: np.ndarray) -> float:
    """Middle of the widest gap between scores among the quantiles that part the labels best."""
    order = np.argsort(scores, kind="stable")
    s, y = scores[order], good[order]
    right = np.concatenate([[y.sum()], y.sum() - np.cumsum(y) + np.cumsum(~y)])
    bounds = np.concatenate([[s[0] - 2], s, [s[-1] + 2]])
    gap = np.where(right == right.max(), np.diff(bounds), -1)
    k = int(gap.argmax())
    return float((bounds[k] + bounds[k + 1]) / 2)


def fit(x: np.ndarray, label: np.ndarray, pairs_each: int = PAIRS_EACH, penalty: float = 1e-3) -> Ranking:
    """Newton steps on the mean logistic loss of feature differences; each row is in ``pairs_each`` pairs or more."""
    mean, scale = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(len(NAMES)), np.ones(len(NAMES)))
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    weights = np.zeros(len(NAMES))
    if not len(good) or not len(bad):
        return Ranking(mean, scale, weights, 0.0)
    z = np.clip((x - mean) / scale, -8, 8)
    draw = np.random.default_rng(0)
    most = pairs_each * max(len(good), len(bad))
    first = np.tile(draw.permutation(good), -(-most // len(good)))[:most]
    second = draw.permuted(np.tile(bad, -(-most // len(bad)))[:most])
    for _ in range(20):
        slope, bend = -penalty * weights, penalty * np.eye(len(weights))
        for k in range(0, most, 50_000):
            d = z[first[k : k + 50_000]] - z[second[k : k + 50_000]]
            p = 1 / (1 + np.exp(-np.clip(d @ weights, -30, 30)))
            slope = slope + d.T @ (1 - p) / most
            bend = bend + (d * (p * (1 - p))[:, None]).T @ d / most
        step = np.linalg.solve(bend, slope)
        weights = weights + step
        if np.abs(step).max() < 1e-6:
            break
    return Ranking(mean, scale, weights, float(np.quantile(z @ weights, np.mean(label == 0), method="midpoint")))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> Ranking:
    """Fits the ranking on labelled rows (doc_id, quality) outside the held-out fold."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    known = known.where("doc_id is not null and label in (0, 1)").where(fold_of() != 2)
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 20):
            yield pa.record_batch([pa.array(features(texts(batch)).tolist(), pa.list_(pa.float64())), batch.column("label")], names=["x", "label"])

    found = rows.mapInArrow(run, "x array<double>, label int").toPandas()
    x = np.array(found["x"].tolist(), dtype=float).reshape(-1, len(NAMES))
    order = np.lexsort((*x.T[:5], found["label"].to_numpy()))
    return fit(x[order], found["label"].to_numpy()[order])


def scored(docs: DataFrame, model: Ranking, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with a column of scores from 0 to 1."""
    held = [c for c in docs.columns if c != out_col]
    schema = T.StructType([*(docs.schema[c] for c in held), T.StructField(out_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col, 1 << 20):
            yield pa.record_batch([*(batch.column(c) for c in held), pa.array(model.score(features(texts(batch, text_col))), pa.float64())], names=[*held, out_col])

    return docs.mapInArrow(run, schema)


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns."""
    return scored(docs, train(docs, labels), out_col="__score").where(F.col("__score") >= THRESHOLD).drop("__score")


def op4_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(fold_of() == 2, F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
