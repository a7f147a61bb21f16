"""Periodic runs against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspan.llm import periodic_runs
from loomspan.llm.periodic_runs import lag_counts, op11_periodic_runs, runs_of, with_runs

from .conftest import SF


def plain_runs(words, least=12):
    """By definition: maximal stretches for every period, without those that have a smaller one."""
    n, found = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, 2 * q):
                part = words[i : i + length]
                if not any(part[p:] == part[:-p] for p in range(1, q)):
                    found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def encoded(texts):
    offsets = np.cumsum([0, *map(len, texts)])
    codes = np.array([first for t, w in enumerate(texts) for first in (offsets[t] + w.index(x) for x in w)], dtype=np.int64)
    return codes, offsets


loop = st.builds(lambda w, k, cut: (w * k)[: max(1, len(w) * k - cut)], st.lists(st.sampled_from("abc"), min_size=1, max_size=9), st.integers(1, 9), st.integers(0, 5))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(loop, max_size=5).map(lambda x: sum(x, [])), max_size=4), st.sampled_from([12, 5, 2]))
def test_runs_equal_the_definition(texts, least):
    found = runs_of(*encoded(texts), least)
    assert [found.get(t, []) for t in range(len(texts))] == [plain_runs(x, least) for x in texts]


@pytest.mark.parametrize("heavy", [0.0, 0.125, 1e9])
def test_lag_counts_by_transform_and_by_differences(monkeypatch, heavy):
    monkeypatch.setattr(periodic_runs, "HEAVY", heavy)
    r = random.Random(3)
    texts = [[r.choice("aaaaaabbbcdefghijklmnop") for _ in range(n)] for n in (0, 1, 700, 2, 333)]
    codes, offsets = encoded(texts)
    found = lag_counts(codes, offsets)
    for t, w in enumerate(texts):
        for q in range(1, len(w) // 2 + 1):
            assert found[offsets[t] + q] == sum(a == b for a, b in zip(w, w[q:]))


def test_long_texts_of_few_words_are_cheap():
    one = np.zeros(300_000, dtype=np.int64)
    assert runs_of(one, np.array([0, len(one)])) == {0: [(0, 300_000, 1)]}
    nested = np.tile(np.r_[np.tile(np.arange(3), 20), 7, 8], 1000)
    found = runs_of(nested, np.array([0, len(nested)]))[0]
    assert found[0] == (0, 60, 3) and (0, 62_000, 62) in found and len(found) == 1001


def test_query_equals_the_contract(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = {r.doc_id: r for r in op11_periodic_runs(spark, SF).collect()}
    assert len(rows) == len(docs)
    for d in docs:
        if len(d.text or "") > 12_000:
            continue
        words = (d.text or "").encode().split()
        h, n = zlib.crc32(str(d.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(words)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        r = rows[d.doc_id]
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None,) * 3
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()


def test_odd_tables(spark, odd_docs, no_docs):
    odd = odd_docs.withColumn("runs", odd_docs["n"]).unionByName(odd_docs.limit(0).withColumn("runs", odd_docs["n"]))
    rows = with_runs(odd).collect()
    assert len(rows) == odd_docs.count() and rows[0].n == "own n"
    assert all(r.runs == [] and r.collapsed == " ".join((r.text or "").split()) for r in rows if not (r.text or "").startswith("ß") and r.doc_id != 7)
    assert with_runs(no_docs).count() == 0
    long = spark.createDataFrame([(1, "so it goes \n" * 40_000)], "doc_id long, text string")
    assert with_runs(long).select("runs", "collapsed").first() == ([(0, 120_000, 3)], "so it goes")
