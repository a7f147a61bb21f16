"""Periodic runs of words: stretches that repeat themselves, found by heavy/light lag counting.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) that no neighbouring word
extends, of at least ``min_length`` words and two periods. A run with period q needs q matches in a row at lag q, so:

1. Lags are counted exactly: for each lag q up to half of a text, how many words are equal to the one q places on. Words
   that are frequent in a text are counted together by an autocorrelation with the fast Fourier transform, rare ones
   by the differences of their places. A word is frequent where its pairs would cost more than a transform, so a text
   of n words costs n * sqrt(n log n) at most, whatever its words are.
2. Only lags with enough matches for a run are looked at. At lag q an island of m = max(q, min_length - q) matches or more
   holds a multiple of m, so every m-th place is probed, with a look at its neighbours.
3. Islands are scanned to both ends from the probes that are left. Where a run with a period that divides q fills the
   place, the lag adds nothing and its probes go before the scan, so a text of one word is not scanned for each lag.

Texts are read whole; one text is one worker's, with memory of some numbers a word. Nothing is shuffled.

Cases: a null or empty text has no words, no runs and an empty collapsed text; repeated rows have a result each; ids are
not looked at; all columns are kept but those with the names of the results. A table without rows gives none.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces, table

MIN_LENGTH = 12
BATCH_BYTES = 1 << 20
#: A word is frequent if its squared count exceeds this share of N log N of a transform of N places (measured).
HEAVY = 0.125
RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")]), False)


def repeated(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and index of each of n[0] + n[1] + ... items."""
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)


def transformed(places: list[np.ndarray], n: int, most: int) -> np.ndarray:
    """Matches at lags 0 to ``most`` of words with these places in a text of n words, by autocorrelation."""
    size = 1 << int(n + most).bit_length()
    power = np.zeros(size // 2 + 1)
    for at in places:
        line = np.zeros(size)
        line[at] = 1
        spectrum = np.fft.rfft(line)
        power += spectrum.real**2 + spectrum.imag**2
    return np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)


def lag_counts(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """At offsets[t] + q: the matches at lag q, up to half of text t. Codes of different texts are different."""
    n = np.diff(offsets)
    found = np.zeros(len(codes) + 1, dtype=np.int64)
    order = np.argsort(codes, kind="stable")
    key = codes[order]
    text = np.repeat(np.arange(len(n)), n)[order]
    begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=np.int64)
    often = np.diff(np.r_[begin, len(key)])
    size = np.maximum(n[text[begin]], 2) * 1.5
    heavy = often.astype(float) ** 2 > HEAVY * size * np.log2(size) + 64
    frequent = defaultdict(list)
    for i in np.flatnonzero(heavy):
        t = int(text[begin[i]])
        frequent[t].append(order[begin[i] : begin[i] + often[i]] - offsets[t])
    for t, places in frequent.items():
        half = int(n[t]) // 2
        found[offsets[t] + 1 : offsets[t] + half + 1] += transformed(places, int(n[t]), half)[1:]
    left = np.flatnonzero(~np.repeat(heavy, often))
    for k in count(1):
        left = left[left < len(key) - k]
        left = left[key[left + k] == key[left]]
        if not len(left):
            return found
        lag = order[left + k] - order[left]
        t = text[left]
        near = lag * 2 <= n[t]
        at = offsets[t][near] + lag[near]
        if len(at) * 8 > len(found):
            found += np.bincount(at, minlength=len(found))
        else:
            np.add.at(found, at, 1)


def probed(codes: np.ndarray, offsets: np.ndarray, min_length: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(text, lag, places) that may lie in an island long enough for a run, lags of a text in ascending order."""
    n = np.diff(offsets)
    counts = lag_counts(codes, offsets)
    text, lag = repeated(np.minimum(n // 2 + 1, n))
    least = np.maximum(lag, min_length - lag)
    enough = (lag > 0) & (counts[offsets[text] + lag] >= least)
    text, lag, least = text[enough], lag[enough], least[enough]
    held = 0
    probes = -(-(n[text] - lag) // least)
    for cut in [*(np.flatnonzero(np.diff(np.cumsum(probes) >> 22)) + 1), len(text)]:  # some millions of probes at once
        t, q, m = text[held:cut], lag[held:cut], least[held:cut]
        owner, index = repeated(probes[held:cut])
        held = cut
        end = (offsets[t + 1] - q)[owner]
        low, at = offsets[t][owner], offsets[t][owner] + index * m[owner]
        hit = codes[at] == codes[at + q[owner]]
        owner, at, low, end = owner[hit], at[hit], low[hit], end[hit]
        q_at = q[owner]
        near = np.minimum((m[owner] - 1) // 2, 3)
        side = []
        for sign in (1, -1):
            ok = np.ones(len(at), dtype=bool)
            for step in (1, 2, 3):
                there = np.clip(at + sign * step, low, end - 1)
                ok &= (step > near) | ((there == at + sign * step) & (codes[there] == codes[there + q_at]))
            side.append(ok)
        ok = side[0] | side[1]
        owner, at = owner[ok], at[ok]
        cuts = np.flatnonzero(np.diff(owner, prepend=-1)) if len(owner) else []
        for i, a in enumerate(cuts):
            b = cuts[i + 1] if i + 1 < len(cuts) else len(owner)
            yield int(t[owner[a]]), int(q[owner[a]]), at[a:b]


def reach(codes: np.ndarray, at: int, q: int, stop: int, sign: int) -> int:
    """The first place from ``at`` on, in the direction of ``sign``, without a match at lag q, or ``stop``."""
    step = 32
    while at != stop:
        to = at + sign * min(step, abs(stop - at))
        a, b = (at, to) if sign > 0 else (to + 1, at + 1)
        other = codes[a:b] != codes[a + q : b + q]
        if other.any():
            return at + int(other.argmax()) if sign > 0 else at - int(other[::-1].argmax())
        at, step = to, step * 2
    return stop


def runs_of(codes: np.ndarray, offsets: np.ndarray, min_length: int = MIN_LENGTH) -> dict[int, list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each text that has some, by start, then period."""
    found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    seen: set[tuple[int, int]] = set()
    wide = np.zeros((0, 3), dtype=np.int64)
    last = -1
    for text, q, places in probed(codes, offsets, min_length):
        if text != last:
            seen, wide, last = set(), wide[:0], text
        begin, end = int(offsets[text]), int(offsets[text + 1])
        wide = wide[wide[:, 1] >= 2 * q]
        for start, length, period in wide:
            if q % period == 0:
                places = places[(places < start) | (places > start + length - 1 - q)]
        new, past = [], begin
        for at in places.tolist():
            if at < past:
                continue
            past = reach(codes, at, q, end - q, 1)
            first = reach(codes, at, q, begin - 1, -1) + 1
            length = past - first + q
            if past - first >= max(q, min_length - q) and (first, length) not in seen:
                seen.add((first, length))
                new.append((first, length, q))
        if new:
            found[text] += [(a - begin, n, q) for a, n, q in new]
            wide = np.concatenate([wide, np.array(new, dtype=np.int64)])
    return {t: sorted(r, key=lambda x: (x[0], x[2])) for t, r in found.items()}


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Without the words that a run holds after its first period."""
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def with_runs(docs: DataFrame, text_col: str = "text", min_length: int = MIN_LENGTH, runs_col: str = "runs", collapsed_col: str = "collapsed") -> DataFrame:
    """``docs`` with every run of each text (start, length, period; numbers of words) and the text with each run cut to its first period.

    Words are what stands between blanks, tabs and line ends (9 to 13); the collapsed text joins them by one blank.
    """
    held = [c for c in docs.columns if c not in (runs_col, collapsed_col)]
    schema = T.StructType([*(docs.schema[c] for c in held), T.StructField(runs_col, RUNS), T.StructField(collapsed_col, T.StringType())])
    runs_type = pa.list_(pa.field("element", pa.struct([pa.field(c, pa.int64(), False) for c in ("start", "length", "period")]), False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col, BATCH_BYTES):
            words = [(x or b"").split() for x in batch.column(text_col).cast(pa.binary()).to_pylist()]
            offsets = np.cumsum([0, *map(len, words)])
            codes = np.empty(offsets[-1], dtype=np.int64)
            for t, w in enumerate(words):
                codes[offsets[t] : offsets[t + 1]] = np.fromiter(map({}.setdefault, w, count(int(offsets[t]))), np.int64, len(w))
            found = runs_of(codes, offsets, min_length)
            runs = pa.array([[dict(zip(("start", "length", "period"), r)) for r in found.get(t, ())] for t in range(len(words))], runs_type)
            collapsed = pa.array([b" ".join(kept_words(w, found[t]) if t in found else w) for t, w in enumerate(words)], pa.binary()).cast(pa.string())
            yield pa.record_batch([*(batch.column(c) for c in held), runs, collapsed], names=[*held, runs_col, collapsed_col])

    return docs.mapInArrow(run, schema)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "")


def looped(docs: DataFrame) -> DataFrame:
    """The rewriting that the query asks for: where crc32(doc_id) ends in 0, a loop of words from a place on. Null ids: none."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    split = docs.withColumn("__words", F.when(h % 10 == 0, words_of(F.col("text"))))
    n = F.size("__words").cast("bigint")
    a = F.when(n > 0, g % n)
    split = split.withColumns({"__n": n, "__a": a, "__p": 1 + F.floor((n - a) / (3 + g % 8))})
    text = F.expr("array_join(concat(slice(__words, 1, int(__a)), slice(flatten(array_repeat(slice(__words, int(__a) + 1, int(__p)), int(ceil((__n - __a) / __p)))), 1, int(__n - __a))), ' ')")
    return split.select("doc_id", F.when(F.col("__a").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = looped(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = with_runs(docs).select("doc_id", "runs", "collapsed")
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    found = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), longest.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    best = F.col("best")
    return found.select(
        "doc_id",
        "n_runs",
        (-best["start"]).alias("start"),
        best["length"].alias("length"),
        (-best["period"]).alias("period"),
        F.floor(1000 * best["length"] / -best["period"]).alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )
