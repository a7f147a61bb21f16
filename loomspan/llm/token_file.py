"""Token files: Simple-8b word-aligned coding with per-block offsets.

A 64-bit word holds a 4-bit selector in its top bits and 60 bits of payload. Selector 0 is the escape: the
next word is one raw 64-bit id. Selector 1 is a run of 120 zeros; the others hold COUNT ids of WIDTH bits.

File format: a folder of Parquet files, one row per block, ascending by (part, block); Spark's committer
makes writes safe against lost and repeated tasks, and any store that Spark knows can hold them.

    part int, block int       place of the block; blocks stand in ascending order of doc_id
    first long                ids in the part before this block
    n_ids int                 ids in the block
    words binary              little-endian 64-bit words
    doc_ids array<long>       the documents of the block
    id_offsets binary         little-endian u32: where each document's ids begin in the block, and n_ids
    word_offsets binary       little-endian u32: for each 1024 words, how many ids precede them

A document is never split between blocks, so a block may be longer than ``block_ids``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, shared_dir, table, texts
from .tokenize import chunk_tokenizer, public_path

ESCAPE, ZEROS = 0, 1
COUNT = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], dtype=np.int64)
WIDTH = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], dtype=np.int64)
STRIDE = 1024
BLOCK = "part int, block int, first bigint, n_ids int, words binary, doc_ids array<bigint>, id_offsets binary, word_offsets binary"


def _bits(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs, 0 to 64."""
    out = np.zeros(len(ids), dtype=np.uint8)
    top = int(ids.max()) if len(ids) else 0
    for k in range(top.bit_length()):
        out += ids >= np.uint64(1 << k)
    return out


def encode(ids: np.ndarray) -> np.ndarray:
    """Simple-8b words of unsigned 64-bit ids; each word takes as many ids as its selector can hold."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, dtype="<u8")
    bits = np.concatenate([_bits(ids), np.zeros(120, dtype=np.uint8)])  # past the end anything fits
    chosen = np.zeros(n, dtype=np.uint8)
    window, span = bits, 1
    for s in range(15, 0, -1):  # from few wide to many narrow ids
        while span < COUNT[s]:
            step = min(span, int(COUNT[s]) - span)
            window, span = np.maximum(window[: len(window) - step], window[step:]), span + step
        chosen[window[:n] <= WIDTH[s]] = s
    # A word that no selector's zeros, ones and so on fits better is not searched: the last match is the longest.
    best = chosen.tobytes()
    steps = [int(c) for c in COUNT]
    starts: list[int] = []
    at = 0
    while at < n:
        starts.append(at)
        at += steps[best[at]]
    first = np.array(starts, dtype=np.int64)
    selector = chosen[first].astype(np.int64)
    place = np.arange(len(first)) + np.concatenate([[0], np.cumsum(selector == ESCAPE)[:-1]])
    words = np.zeros(len(first) + int((selector == ESCAPE).sum()), dtype=np.uint64)
    words[place] = selector.astype(np.uint64) << np.uint64(60)
    words[place[selector == ESCAPE] + 1] = ids[first[selector == ESCAPE]]
    padded = np.concatenate([ids, np.zeros(120, dtype=np.uint64)])
    for s in range(2, 16):
        rows = np.flatnonzero(selector == s)
        if len(rows):
            value = np.zeros(len(rows), dtype=np.uint64)
            for k in range(int(COUNT[s])):
                value |= padded[first[rows] + k] << np.uint64(k * WIDTH[s])
            words[place[rows]] |= value
    return words.astype("<u8")


def decode(words: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` ids of the words."""
    words = words.astype(np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    if (selector == ESCAPE).any():  # raw words follow escapes; find them one after the other
        raw = np.zeros(len(words), dtype=bool)
        last = -2
        for k in np.flatnonzero(selector == ESCAPE):
            if k != last + 1 or not raw[k]:
                if k + 1 < len(words):
                    raw[k + 1] = True
                last = k
        heads = np.flatnonzero(~raw)
    else:
        heads = np.arange(len(words))
    kinds = selector[heads]
    ends = np.cumsum(COUNT[kinds])
    out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint64)
    starts = ends - COUNT[kinds]
    for s in range(16):
        rows = np.flatnonzero(kinds == s)
        if not len(rows) or s == ZEROS:
            continue
        if s == ESCAPE:
            out[starts[rows]] = words[heads[rows] + 1]
            continue
        mask = np.uint64((1 << int(WIDTH[s])) - 1)
        for k in range(int(COUNT[s])):
            out[starts[rows] + k] = (words[heads[rows]] >> np.uint64(k * WIDTH[s])) & mask
    return out[:n]


def _word_offsets(words: np.ndarray) -> bytes:
    """Ids before each STRIDE-th word, counted by selectors; a raw word counts none."""
    selector = (words.astype(np.uint64) >> np.uint64(60)).astype(np.int64)
    count = COUNT[selector]
    if (selector == ESCAPE).any():
        after = False
        for k in range(len(words)):
            if after:
                count[k], after = 0, False
            elif selector[k] == ESCAPE:
                after = True
    before = np.concatenate([[0], np.cumsum(count)[:-1]]) if len(count) else np.zeros(0)
    return before[::STRIDE].astype("<u4").tobytes()


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, words: bool = True, block_ids: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes all documents in ascending order of doc_id; null ids come first, ties in any order.

    A null text counts as empty and has the end id alone. The borders of the parts come from quantiles of
    doc_id alone; a part is a shuffle partition, and rows of one doc_id meet in one part. Texts are tokenised
    after the shuffle, where their blocks are made.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63)))
    borders = docs.select(key.cast("double").alias("k")).approxQuantile("k", [i / parts for i in range(1, parts)], 0.25 / parts)
    borders = sorted({int(b) for b in borders})
    part = F.lit(0)
    if borders:
        held = F.array(*[F.lit(b).cast("bigint") for b in borders])
        part = F.size(F.filter(held, lambda b: b < key)).cast("int")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), part.alias("part"))
    sent = rows.repartitionById(len(borders) + 1, F.col("part")).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    sent.mapInArrow(_blocks(tokenizer_path, words, end_id, block_ids), BLOCK).write.parquet(path)


def _blocks(tokenizer_path: str, words: bool, end_id: int, block_ids: int):
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int32()), ("words", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("id_offsets", pa.binary()), ("word_offsets", pa.binary())])
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = chunk_tokenizer(tokenizer_path, words)
        held: list[tuple] = []
        size, block, first, part = 0, 0, 0, 0

        def flush() -> pa.RecordBatch:
            n = [len(x[1]) // 4 for x in held]
            code = encode(np.frombuffer(b"".join(x[1] for x in held), dtype="<u4"))
            offsets = np.concatenate([[0], np.cumsum(n)]).astype("<u4").tobytes()
            return pa.record_batch([pa.array(c, t.type) for c, t in zip(([part], [block], [first], [sum(n)], [code.tobytes()], [[x[0] for x in held]], [offsets], [_word_offsets(code)]), schema)], schema=schema)

        for batch in pieces(batches, "text", 4 << 20):
            for doc, ids, own in zip(batch.column("doc_id").to_pylist(), tokenizer.ids(texts(batch)), batch.column("part").to_pylist()):
                n = len(ids) // 4 + 1
                if held and size + n > block_ids:
                    yield flush()
                    first, block, size = first + size, block + 1, 0
                    held.clear()
                part = own
                held.append((doc, ids + end))
                size += n
        if held:
            yield flush()

    return run


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (little-endian u32), decoded from the files."""
    blocks = spark.read.schema(BLOCK).parquet(path)
    sizes = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()  # a row per part
    before, base = 0, []
    for part, n in sorted((r["part"], r["n"]) for r in sizes):
        base.append((part, before))
        before += n
    starts = F.broadcast(spark.createDataFrame(base, "part int, base bigint"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, base, n, words, docs, offsets in zip(*(batch.column(c).to_pylist() for c in ("first", "base", "n_ids", "words", "doc_ids", "id_offsets"))):
                ids = decode(np.frombuffer(words, dtype="<u8"), n).astype("<u4")
                at = np.frombuffer(offsets, dtype="<u4").astype(np.int64)
                yield pa.record_batch([pa.array(docs, pa.int64()), pa.array(at[:-1] + (first + base), pa.int64()), pa.array([ids[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())], schema=schema)

    return blocks.join(starts, "part").mapInArrow(run, "doc_id bigint, start bigint, ids binary")


def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), path, public_path("word_bpe_49k.json"), end_id=2)
    found = read(spark, path)
    return found.select("doc_id", "start", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
