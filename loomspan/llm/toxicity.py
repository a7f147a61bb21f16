"""Toxicity by maximum-scoring segments of token log-odds.

1. Log-odds: for each term of the labelled texts, the difference of its log-odds in toxic and in clean ones, both
   smoothed by an informative Dirichlet prior whose shape is the term's share of the whole corpus, with its sign. Terms
   are words and beginnings of words; each is shrunk by its own noise towards the term's longest beginning (and that
   towards 0), so what is within ``LEAST_Z`` standard errors of it, as a word never seen, scores like its beginning.
   Near copies among the labelled texts count once.
2. Segments: a word scores its log-odds less a drift, any other word, and one that repeats the word before it, the drift alone, so clean text has a negative
   mean; one linear scan finds all maximal scoring segments of a text.
3. Calibration: maximal segment scores of random text follow an extreme-value law. Lambda solves
   sum p_i exp(lambda s_i) = 1 for the scores s_i of clean text; K comes from the mean score that clean
   training texts reach. A segment of score S in a text of n words has E = K n exp(-lambda S) expected equals.
   Segments with E below ``significant`` are the toxic passages; the text's score rises with -log of the chance of
   the least E, on a scale where the threshold stands at the best separating value of the training texts. For all of
   this each of ``PARTS`` parts of the labelled texts is scored by log-odds that the other parts gave.

The labelled sample is bounded by ``max_rows`` (smallest hashes of ids, one text an id). Terms are counted on
executors, and those of the sample's terms that stand in ``LEAST_TEXTS`` of its texts come to the driver. Corpus
counts cover all documents: tasks count these terms where they read texts and send one row a term.

Cases: null text counts as empty and scores near 0; rows without a label, with a null label, with labels of
both kinds or of the held-out fold teach nothing; without toxic or without clean examples all score 0; of labelled
rows with one id the least text teaches; repeated rows are scored each; other columns are kept by ``scored``, but for
those that have the names of its own two.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from math import exp, expm1, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold_of, pieces, staged, table, texts
from .quality import best_cut
from .shingles import numbers, shingle_sets

THRESHOLD = 0.3
MAX_ROWS = 20_000
WORD = re.compile(r"\w+")
PRIOR = 500.0
DRIFT = 0.05
LEAST_TEXTS = 3
#: Log-odds within so many of their standard errors of the beginning's are taken to be those.
LEAST_Z = 2.5
PARTS = 4
BEGINNINGS = (6, 5, 4)


def tokens(text: str) -> list[str]:
    return WORD.findall(text.lower())


def beginnings(word: str) -> list[str]:
    """What stands for a word that has no score of its own, the longest first."""
    return [word[:n] + "*" for n in BEGINNINGS if len(word) > n]


def terms(words: Iterable[str]) -> set[str]:
    """The words of a text and their beginnings, once each."""
    distinct = set(words)
    return distinct.union(*map(beginnings, distinct))


def maximal_segments(scores: list[tuple[int, float]], gap: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score), in order, by one linear scan.

    ``scores`` has the places with their own score; every place between them scores ``gap`` (below 0).
    Each segment keeps where the search from it ended, so no segment is passed over twice.

    >>> maximal_segments([(0, 4.0), (2, 3.0), (9, 5.0)], -1.0)
    [(0, 2, 6.0), (9, 9, 5.0)]
    """
    first: list[int] = []
    last: list[int] = []
    low: list[float] = []  # the running sum before and with each segment
    high: list[float] = []
    lower: list[int] = []  # the nearest segment before with a lower ``low``, or -1
    total, at = 0.0, 0
    for place, score in scores:
        total += gap * (place - at)
        at = place + 1
        before = total
        total += score
        if score <= 0:
            continue
        start, k = place, len(first) - 1
        while True:
            while k >= 0 and low[k] >= before:
                k = lower[k]
            if k < 0 or high[k] >= total:
                break
            start, before, up = first[k], low[k], lower[k]
            for column in (first, last, low, high, lower):
                del column[k:]
            k = up
        first.append(start)
        last.append(place)
        low.append(before)
        high.append(total)
        lower.append(k)
    return [(a, b, y - x) for a, b, x, y in zip(first, last, low, high)]


@dataclass
class Lexicon:
    """Scores of terms, the score of any other word, and the calibration."""

    words: dict[str, float] = field(default_factory=dict)
    other: float = -DRIFT
    lam: float = 1.0
    k: float = 1.0
    cut: float = 0.0
    slope: float = 1.0
    significant: float = 0.01
    known: dict[str, float | None] = field(default_factory=dict, repr=False, compare=False)

    def of(self, word: str) -> float | None:
        """The word's score; None if it has that of any other word."""
        found = self.words.get(word)
        if found is None:
            found = next((s for b in beginnings(word) if (s := self.words.get(b)) is not None), None)
        return found

    def segments(self, text: str) -> tuple[int, list[tuple[int, int, float]], Counter]:
        """(words, maximal segments, how often each score comes up) of a text."""
        own = tokens(text)
        known, found = self.known, []
        if len(known) > 500_000:
            known.clear()
        before = ""
        for i, w in enumerate(own):
            if w == before:
                continue  # the same word over and over tells once
            before = w
            s = known.get(w, self)
            if s is self:
                s = known[w] = self.of(w)
            if s is not None:
                found.append((i, s - DRIFT))
        return len(own), maximal_segments(found, self.other) if found else [], Counter(s for _, s in found)

    def judged(self, text: str) -> tuple[float, list[tuple[int, int, float, float]]]:
        """(score from 0 to 1, [(first word, last word, segment score, E)]) of a text."""
        if not self.words:
            return 0.0, []
        n, found, _ = self.segments(text)
        rated = [(a, b, s, self.expected(n, s)) for a, b, s in found]
        evidence = surprise(min((e for *_, e in rated), default=None))
        edge = log(THRESHOLD / (1 - THRESHOLD))
        score = 1 / (1 + exp(-min(max(self.slope * (evidence - self.cut) + edge, -30.0), 30.0)))
        return score, [r for r in rated if r[3] < self.significant]

    def expected(self, words: int, score: float) -> float:
        return self.k * words * exp(-self.lam * min(score, 600.0 / self.lam))


def surprise(least: float | None) -> float:
    """-log of the chance that random clean text holds a segment of that many expected equals or fewer; 0 or more."""
    if least is None:
        return 0.0
    return -log(-expm1(-least)) if least > 1e-12 else -log(max(least, 1e-280))


def log_odds(counts: dict[str, tuple[int, int]], corpus: dict[str, int], corpus_total: int) -> dict[str, float]:
    """Signed log-odds of terms from (toxic texts, clean texts), by an informative Dirichlet prior.

    Each is shrunk by its noise towards the score of the term's longest beginning, or 0; terms that tell no more than that are left out.
    """
    n1, n0 = (sum(c[k] for c in counts.values()) for k in (0, 1))
    out: dict[str, float] = {}
    for term in sorted(counts, key=lambda t: (not t.endswith("*"), len(t))):
        toxic, clean = counts[term]
        a = PRIOR * max(corpus.get(term, 1), 1) / max(corpus_total, 1) + 0.5
        y1, y0 = toxic + a, clean + a
        delta = log(y1 / max(n1 + PRIOR - y1, 1e-9)) - log(y0 / max(n0 + PRIOR - y0, 1e-9))
        base = next((x for t in beginnings(term.removesuffix("*")) if (x := out.get(t)) is not None), 0.0)
        noise = (1 / y1 + 1 / y0) / max((delta - base) ** 2, 1e-12)
        if (kept := 1 - LEAST_Z**2 * noise) > 0:
            out[term] = base + (delta - base) * kept
    return out


def law(scores: Counter, words: int) -> float:
    """Lambda of clean text, from how often each score came up in so many words."""
    p = np.array([n / max(words, 1) for n in scores.values()])
    s = np.array([x for x in scores])
    rest = max(1 - p.sum(), 0.0)
    low, high = 1e-6, 50.0
    if not (s > 0).any():
        return 1.0
    for _ in range(100):
        mid = (low + high) / 2
        value = rest * np.exp(-mid * DRIFT) + (p * np.exp(np.minimum(mid * s, 500))).sum()
        low, high = (mid, high) if value < 1 else (low, mid)
    return max(low, 1e-3)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, part, toxic texts, clean texts) of labelled texts."""
    count: Counter = Counter()
    for batch in pieces(batches, "text", 1 << 20):
        for x, part, label in zip(texts(batch), batch.column("part").to_pylist(), batch.column("label").to_pylist()):
            count.update((t, part, label) for t in terms(tokens(x)))
    columns = list(zip(*((t, h, n * y, n * (1 - y)) for (t, h, y), n in count.items()))) or [()] * 4
    for k in range(0, len(columns[0]), 50_000):
        yield pa.record_batch([pa.array(c[k : k + 50_000], t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.int64()))], names=["term", "part", "toxic", "clean"])


def _bands(batches: Iterator[pa.RecordBatch], bands: int = 8, width: int = 3) -> Iterator[pa.RecordBatch]:
    """(doc_id, band key) of MinHash values; near copies share one in all likelihood."""
    factor = numbers(31, bands * width)
    for batch in pieces(batches, "text", 1 << 20):
        h, offsets = shingle_sets(texts(batch))
        out = []
        for doc, a, b in zip(batch.column("doc_id").to_pylist(), offsets.tolist(), offsets[1:].tolist()):
            if b > a:
                sign = (h[a:b, None] * factor[None, :]).min(axis=0).reshape(bands, width)
                out += [(doc, f"{k}:{v.tobytes().hex()}") for k, v in enumerate(sign)]
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string()))], names=["doc_id", "band"])


def sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, text, label, part) of at most ``max_rows`` labelled ids outside the held-out fold, without near copies of one with a smaller id."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
    known = known.where("doc_id is not null and label in (0, 1)").where(fold_of() != 2)
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    found = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    found = staged(found, "labelled")
    bands = found.select("doc_id", "text").mapInArrow(_bands, "doc_id bigint, band string")
    copies = bands.join(bands.groupBy("band").agg(F.min("doc_id").alias("first")), "band").where("first < doc_id").select("doc_id").distinct()
    part = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(PARTS)).cast("int").alias("part")
    return staged(found.join(copies, "doc_id", "left_anti").select("doc_id", "text", "label", part), "sample")


def corpus_counts(docs: DataFrame, vocabulary: set[str]) -> tuple[dict[str, int], int]:
    """How often each term of the vocabulary stands in the whole corpus, and the number of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        count: Counter = Counter()
        total = 0

        def spread() -> None:
            for w, n in words.items():
                for t in (w, *beginnings(w)):
                    if t in vocabulary:
                        count[t] += n
            words.clear()

        for batch in pieces(batches, "text", 1 << 20):
            for x in texts(batch):
                own = tokens(x)
                total += len(own)
                words.update(own)
            if len(words) > 200_000:
                spread()
        spread()
        yield pa.record_batch([pa.array([None, *count], pa.string()), pa.array([total, *count.values()], pa.int64())], names=["term", "n"])

    found = docs.select("text").mapInArrow(run, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    count = {r["term"]: r["n"] for r in found}
    return count, count.pop(None, 0)


def fit(rows: DataFrame, docs: DataFrame) -> Lexicon:
    """The lexicon of labelled texts (doc_id, text, label, part), with the prior of all ``docs`` (text)."""
    counted = rows.select("text", "part", "label").mapInArrow(_counted, "term string, part int, toxic bigint, clean bigint")
    sums = [F.sum(F.when(F.col("part") == k, F.col(c)).otherwise(0)).alias(f"{c}{k}") for c in ("toxic", "clean") for k in range(PARTS)]
    often = counted.groupBy("term").agg(*sums, F.sum(F.col("toxic") + F.col("clean")).alias("n")).where(F.col("n") >= LEAST_TEXTS).drop("n").collect()
    kinds = {r["label"] for r in rows.select("label").distinct().collect()}
    if kinds != {0, 1}:
        return Lexicon()
    corpus, total = corpus_counts(docs, {r["term"] for r in often})

    def without(part: int | None) -> dict[str, float]:
        counts = {term: (sum(n[:PARTS]) - (n[part] if part is not None else 0), sum(n[PARTS:]) - (n[PARTS + part] if part is not None else 0)) for term, *n in often}
        return log_odds(counts, corpus, total)

    model, others = Lexicon(without(None)), [without(k) for k in range(PARTS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = [Lexicon(x) for x in others]
        for batch in pieces(batches, "text", 1 << 20):
            out, seen = [], Counter()
            for x, part, label in zip(texts(batch), batch.column("part").to_pylist(), batch.column("label").to_pylist()):
                n, found, scores = models[part].segments(x)
                out.append((label, n, max((s for *_, s in found), default=0.0)))
                if not label:
                    seen += scores
            out += [(None, n, round(s, 3)) for s, n in seen.items()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.float64()))], names=["label", "n", "score"])

    judged = rows.select("text", "part", "label").mapInArrow(run, "label int, n bigint, score double")
    scores = {r["score"]: r["n"] for r in judged.where("label is null").groupBy("score").agg(F.sum("n").alias("n")).collect()}
    best = [(r["label"], r["n"], r["score"]) for r in judged.where("label is not null").orderBy("label", "n", "score").collect()]
    model.lam = law(Counter(scores), sum(n for label, n, _ in best if not label))
    # Of the extreme-value law, the mean of lambda S - log n is log K plus Euler's constant.
    centre = [model.lam * s - log(n) for label, n, s in best if not label and n]
    model.k = exp(min(float(np.mean(centre)) - 0.5772156649, 0.0)) if centre else 1.0
    values = np.array([surprise(model.expected(n, s)) if s > 0 else 0.0 for _, n, s in best])
    model.cut = max(best_cut(values, np.array([label for label, *_ in best]) == 1), 1e-6)
    model.slope = 4.0 / max(model.cut, 1.0)
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> Lexicon:
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return fit(sample(rows, labels, max_rows), rows)


def scored(docs: DataFrame, model: Lexicon, text_col: str = "text", out_col: str = "score", passages_col: str = "passages") -> DataFrame:
    """``docs`` with the score, and the significant passages as (first word, last word, score, e)."""
    held = [c for c in docs.columns if c not in (out_col, passages_col)]
    more = T.StructType.fromDDL("s double, p array<struct<first: int, last: int, score: double, e: double>>")
    own = [T.StructField(out_col, more["s"].dataType), T.StructField(passages_col, more["p"].dataType)]
    schema = T.StructType([*(docs.schema[c] for c in held), *own])
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64()), ("e", pa.float64())]))
    model = Lexicon(**{k: v for k, v in vars(model).items() if k != "known"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col, 1 << 20):
            found = [model.judged(x) for x in texts(batch, text_col)]
            spans = [[{"first": a, "last": b, "score": s, "e": e} for a, b, s, e in own] for _, own in found]
            yield pa.record_batch([*(batch.column(c) for c in held), pa.array([s for s, _ in found], pa.float64()), pa.array(spans, kind)], names=[*held, out_col, passages_col])

    return docs.mapInArrow(run, schema)


def op7_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(fold_of() == 2, F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
