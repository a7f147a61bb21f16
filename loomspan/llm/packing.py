"""Vector bin packing of documents into training sequences.

A piece has a vector of demands (tokens, one segment, loss-bearing tokens), a sequence a vector of limits.
Sequences are filled one after the other: of the pieces that fit under every limit, the one whose demand has
the largest dot product with what is still free (both as shares of the limits) comes next. Documents may be
cut: of each, whole sequences are taken off first, and the rest is a piece. When nothing more fits, the free
tokens are filled with the head of another piece, whose tail stays in the pool.

Each task packs the documents it reads; nothing is shuffled. What remains for the task's last sequences is
cut into lengths that are powers of two, which need no padding. The pool is bounded: pieces wait until
``pool`` of them are there.

Which tokens bear loss is given by ``loss_col``, token spans of a document (the answers of instruction data); where
none are given all do, and the limit of loss binds no earlier than that of tokens unless it is set lower.

Cases: null text counts as empty and has the end id alone; repeated rows are packed each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, table, texts
from .tokenize import chunk_tokenizer, public_path

PIECE = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, segment int, loss_tokens bigint"


@dataclass(frozen=True)
class Limits:
    """Of one sequence. A segment's first token bears no loss: nothing in its segment predicts it."""

    tokens: int = 1024
    segments: int = 64
    loss: int = 1024


class Packer:
    """Packs pieces (doc, start, ids, doc_tokens, loss) one sequence at a time; ``out`` gets rows of PIECE.

    ``loss`` has at k how many of the document's first k tokens bear loss; None: all of them.
    """

    def __init__(self, limits: Limits, first_sequence: int):
        self.limits, self.sequence = limits, first_sequence
        self.pool: list[tuple] = []
        self.out: list[tuple] = []
        self.scale = np.array([1 / limits.tokens, 1 / limits.segments, 1 / limits.loss])

    def _emit(self, parts: list[tuple]) -> None:
        offset = 0
        for segment, part in enumerate(parts):
            doc, start, ids, total, _ = part
            n = len(ids) // 4
            self.out.append((doc, start, n, ids, total, self.sequence, offset, segment, self._loss(part)))
            offset += n
        self.sequence += 1

    def add(self, doc: int, ids: bytes, total: int, loss: np.ndarray | None = None) -> None:
        piece = (doc, 0, ids, total, loss)
        while piece[2]:
            n = self._most(piece, self.limits.tokens, self.limits.loss)
            head, rest = self._cut(piece, n)
            if not rest[2] and n < self.limits.tokens and self._loss(head) < self.limits.loss:
                self.pool.append(piece)
                break
            self._emit([head])
            piece = rest

    @staticmethod
    def _cut(piece: tuple, n: int) -> tuple[tuple, tuple]:
        doc, start, ids, total, loss = piece
        return (doc, start, ids[: 4 * n], total, loss), (doc, start + n, ids[4 * n :], total, loss)

    @staticmethod
    def _loss(piece: tuple) -> int:
        """Loss-bearing tokens of a piece as one segment."""
        _, start, ids, _, loss = piece
        n = len(ids) // 4
        return n - 1 if loss is None else int(loss[start + n] - loss[start + 1])

    @staticmethod
    def _most(piece: tuple, tokens: int, loss: int) -> int:
        """The most first tokens of a piece within both limits."""
        _, start, ids, _, own = piece
        n = min(len(ids) // 4, tokens)
        if own is None:
            return min(n, loss + 1)
        return int(np.searchsorted(own[start + 1 : start + n + 1], own[start + 1] + loss, side="right")) if n else 0

    def _whole(self) -> int:
        """Tokens of a sequence that any pieces may fill."""
        return min(self.limits.tokens, self.limits.loss + 1)

    def pack(self, rest: int) -> None:
        """Fills sequences while more than ``rest`` pieces wait; 0: also those that nothing can fill up."""
        pool = self.pool
        lengths = np.array([len(p[2]) // 4 for p in pool], dtype=np.int64)
        waits = np.ones(len(pool), dtype=bool)
        losses = np.array([self._loss(p) for p in pool], dtype=np.int64)
        demand = np.stack([lengths, np.ones_like(lengths), losses], axis=1) * self.scale
        left, total = len(pool), int(lengths.sum())
        while left > rest and total >= self.limits.tokens:
            free = np.array([self.limits.tokens, self.limits.segments, self.limits.loss], dtype=np.int64)
            parts: list[tuple] = []
            while free[0] > 0 and free[1] > 0 and left:
                fits = waits & (lengths <= free[0]) & (losses <= free[2])
                if fits.any():
                    gain = np.where(fits, demand @ (free * self.scale), -1.0)
                    k = int(gain.argmax())
                    parts.append(pool[k])
                    waits[k] = False
                    left -= 1
                    n = int(lengths[k])
                else:
                    k = int(np.where(waits, lengths, -1).argmax())
                    n = self._most(pool[k], int(free[0]), int(free[2]))
                    if n <= 0:
                        break
                    head, pool[k] = self._cut(pool[k], n)
                    parts.append(head)
                    lengths[k] -= n
                    losses[k] = self._loss(pool[k])
                    demand[k] = np.array([lengths[k], 1, losses[k]]) * self.scale
                free -= [n, 1, self._loss(parts[-1])]
                total -= n
            self._emit(parts)
        self.pool = [p for p, w in zip(pool, waits) if w]

    def finish(self) -> None:
        """The last pieces, in sequences whose lengths are powers of two."""
        self.pack(0)
        self.pool.sort(key=lambda p: -len(p[2]))
        total = sum(len(p[2]) // 4 for p in self.pool)
        while total:
            room = 1 << (min(total, self._whole()).bit_length() - 1)
            parts: list[tuple] = []
            while room and len(parts) < self.limits.segments:
                piece = self.pool.pop(0)
                n = min(room, len(piece[2]) // 4)
                head, rest = self._cut(piece, n)
                parts.append(head)
                if rest[2]:
                    self.pool.insert(0, rest)
                room -= n
                total -= n
            self._emit(parts)


def bearing(spans: list[dict] | None, total: int) -> np.ndarray | None:
    """How many of the first k tokens lie in the spans, for k up to ``total``; None without spans."""
    if spans is None:
        return None
    inside = np.zeros(total + 1, dtype=np.int64)
    for span in spans:
        if span and span["start"] is not None and span["end"] is not None:
            inside[max(span["start"], 0) + 1 : max(span["end"], 0) + 1] = 1
    return np.cumsum(inside)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", words: bool = False, pool: int = 800, loss_col: str | None = None) -> DataFrame:
    """Pieces of all documents with their ids, sequences and places (schema PIECE).

    ``loss_col`` has arrays of (start, end), spans of a document's tokens that bear loss, the end id among them; null is all.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("segment", pa.int32()), ("loss_tokens", pa.int64())])
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = chunk_tokenizer(tokenizer_path, words).ids
        packer = Packer(limits, TaskContext.get().partitionId() << 40)

        def rows() -> Iterator[pa.RecordBatch]:
            if packer.out:
                yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*packer.out), schema)], schema=schema)
                packer.out.clear()

        for batch in pieces(batches, "text", 4 << 20):
            spans = batch.column("loss").to_pylist() if loss_col else [None] * batch.num_rows
            for doc, ids, own in zip(batch.column("doc_id").to_pylist(), encode(texts(batch)), spans):
                ids += end
                packer.add(doc, ids, len(ids) // 4, bearing(own, len(ids) // 4))
                if len(packer.pool) >= pool:
                    packer.pack(pool // 2)
            yield from rows()
        packer.finish()
        yield from rows()

    loss = [F.col(loss_col).cast("array<struct<start: bigint, end: bigint>>").alias("loss")] if loss_col else []
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), *loss).mapInArrow(run, PIECE)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pack(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"), end_id=0)
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
