"""Phrases found in sequences of words: all phrases at once, in one pass over each document.

A document's windows are hashed for each length that a phrase has, and those whose hash a phrase has are counted by their words. So
the work grows with the documents and the phrases, not with their product, and only windows that are phrases become rows. Hashes of the
phrases are told to the tasks up to ``MOST_PHRASES``; beyond it all windows are rows, which are met by their words. A hash only thins: windows
are counted and met by their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_PHRASES = 1_000_000
#: Documents taken at once, and bits of the table that is looked into before hashes are compared.
DOCS, BITS = 512, 22


def asked_phrases(queries: DataFrame) -> DataFrame:
    """(query_id, phrase) of queries (query_id, text) that have terms; terms are joined by a space, which none of them holds."""
    from ..functions.text import index_terms

    return queries.select("query_id", index_terms(F.col("text")).alias("terms")).where("size(terms) > 0").select("query_id", F.array_join("terms", " ").alias("phrase"))


def _hashes(terms: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(terms, dtype=object), categorize=False)


def _factor(place: int) -> np.uint64:
    return np.uint64((0x9E3779B97F4A7C15 * (2 * place + 1) | 1) % (1 << 64))


def told(asked: DataFrame) -> dict[int, np.ndarray | None]:
    """Lengths of the phrases of ``asked`` and their sorted hashes; without hashes if phrases are too many."""
    distinct = asked.select("phrase").distinct()
    if distinct.limit(MOST_PHRASES + 1).count() > MOST_PHRASES:
        lengths = distinct.select(F.size(F.split("phrase", " ")).alias("n")).distinct().collect()  # a row a length
        return {r["n"]: None for r in lengths}
    by: dict[int, list[list[str]]] = {}
    for r in distinct.collect():  # bounded above
        terms = r["phrase"].split(" ")
        by.setdefault(len(terms), []).append(terms)
    out = {}
    for n, own in by.items():
        known = _hashes([t for terms in own for t in terms]).reshape(-1, n)
        out[n] = np.unique(sum((known[:, j] * _factor(j) for j in range(n)), np.zeros(len(own), dtype=np.uint64)))
    return out


def _table(hashes: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << BITS, dtype=bool)
    table[hashes & np.uint64(len(table) - 1)] = True
    return table


def counted(doc: np.ndarray, place: np.ndarray, code: np.ndarray, names: pa.Array, wanted: dict) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
    """(document, phrase, how often) of words by document and place; ``wanted``: length to hashes and their table."""
    known = _hashes(names.to_pylist())
    for n, (hashes, table) in wanted.items():
        m = len(code) - n + 1
        if m <= 0:
            continue
        at = np.flatnonzero((doc[n - 1 :] == doc[:m]) & (place[n - 1 :] - place[:m] == n - 1))
        if hashes is not None:
            h = np.zeros(len(at), dtype=np.uint64)
            for j in range(n):
                h += known[code[at + j]] * _factor(j)
            near = np.flatnonzero(table[h & np.uint64(len(table) - 1)])
            at, h = at[near], h[near]
            at = at[hashes[np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)] == h]
        if not len(at):
            continue
        keys = [code[at + j] for j in range(n)] + [doc[at]]
        by = np.lexsort(keys)
        new = np.ones(len(by), dtype=bool)
        new[1:] = np.any([k[by][1:] != k[by][:-1] for k in keys], axis=0)
        first = np.flatnonzero(new)
        words = [names.take(pa.array(k[by][first])) for k in keys[:n]]
        yield doc[at][by][first], pc.binary_join_element_wise(*words, " ") if n > 1 else words[0], np.diff(np.append(first, len(by)))


def _rows(batch: pa.RecordBatch, length: np.ndarray, found: Iterator) -> Iterator[pa.RecordBatch]:
    for doc, phrase, n_hits in found:
        yield pa.record_batch([batch.column("id").take(pa.array(doc)), pa.array(length[doc].astype(np.int64)), phrase.cast(pa.string()), pa.array(n_hits.astype(np.int64))], names=["id", "length", "phrase", "n_hits"])


def _schema(rows: DataFrame) -> str:
    return f"id {rows.schema['id'].dataType.simpleString()}, length bigint, phrase string, n_hits bigint"


def _wanted(hashes: dict) -> dict:
    return {n: (h, None if h is None else _table(h)) for n, h in hashes.items()}


def in_words(words: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, length, phrase, n_hits) of documents (id, words) by phrases (phrase)."""
    held = words.sparkSession.sparkContext.broadcast(told(asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = _wanted(held.value)
        for whole in batches:
            for s in range(0, whole.num_rows, DOCS):
                batch = whole.slice(s, DOCS)
                lists = batch.column("words")
                length = np.diff(lists.offsets.to_numpy())
                coded = lists.flatten().dictionary_encode()
                doc = np.repeat(np.arange(len(length)), length)
                place = np.arange(len(doc)) - np.repeat(np.cumsum(length) - length, length)
                yield from _rows(batch, length, counted(doc, place, coded.indices.to_numpy(), coded.dictionary, wanted))

    # Without a test for empty ones, for which Spark would cut texts into words a second time.
    return words.select("id", "words").mapInArrow(run, _schema(words))


def in_places(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, length, phrase, n_hits) of postings (id, term, length, deltas) that have all terms of the phrases (phrase)."""
    held = rows.sparkSession.sparkContext.broadcast(told(asked))
    own = rows.groupBy("id").agg(F.max("length").alias("length"), F.collect_list(F.struct("term", "deltas")).alias("own"))  # one document's

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = _wanted(held.value)
        for whole in batches:
            for s in range(0, whole.num_rows, DOCS):
                batch = whole.slice(s, DOCS)
                lists = batch.column("own")
                parts = lists.flatten()
                coded = parts.field("term").dictionary_encode() if len(parts) else pa.array([], pa.string()).dictionary_encode()
                deltas = parts.field("deltas")
                many = np.diff(deltas.offsets.to_numpy())
                if not many.sum():
                    continue
                flat = np.cumsum(deltas.flatten().to_numpy().astype(np.int64))
                begin = np.cumsum(many) - many
                base = np.where(begin > 0, flat[np.maximum(begin - 1, 0)], 0)
                place = flat - np.repeat(base, many)
                doc = np.repeat(np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy())), many)
                code = np.repeat(coded.indices.to_numpy(), many)
                by = np.lexsort((place, doc))
                doc, place, code = doc[by], place[by], code[by]
                once = np.ones(len(doc), dtype=bool)
                once[1:] = (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])
                yield from _rows(batch, batch.column("length").to_numpy(), counted(doc[once], place[once], code[once], coded.dictionary, wanted))

    return own.mapInArrow(run, _schema(rows))
