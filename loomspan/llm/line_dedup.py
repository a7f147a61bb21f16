"""Line deduplication by a segment-partition edit join.

Lines are compared after trimming and with each run of white space as one blank. Equal lines, and lines of
``MIN_CHARS`` characters or more within an edit distance of ``TAU``, are linked; of each connected class the
first line in order of (doc_id, line number) stays.

1. A line is cut into TAU + 1 segments; if two lines are within TAU edits, one of the shorter one's segments
   stands unchanged in the longer one. The inverted index holds (length, segment number, content) of each line;
   for every length from its own down to TAU less, a line probes the few substrings that the positions of
   edits on either side leave possible. A probe that equals the line's own segment is one row with it.
2. Rows of one content meet in sorted order. A pair goes on if the counts of its characters differ by no more
   than TAU edits can change; of each meeting only a spanning forest goes on. Contents with very many rows are told
   by a count over one in ``SAMPLED`` documents; their rows are cut into tiles, and each pair of tiles meets apart.
3. Texts of these candidates are fetched from their first document, and each component is verified: pairs of
   near lengths by banded bit-parallel edit distance. Large components are cut into blocks and dealt out.
4. Components of verified links and equal lines are the classes.

Equal lines are one row each task from the start. Cases: null text counts as empty; blank lines are neither
counted as lines nor dropped; a line repeated in one document stays once; null doc_id sorts last; repeated
rows are documents of their own; an empty table gives an empty result; other columns are kept by ``cleaned``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checked_broadcast, dealt, pieces, settled, staged, table, texts, with_row_id
from .components import Forest, connected_components
from .shingles import mixed, numbers, powers

TAU, MIN_CHARS = 2, 20
BLOCK_LINES = 2_000
#: The two lowest bits of an index row's key: whether the line's own segment is at its place, and the side in a pair of tiles.
INDEX, SIDE = 1, 2
#: A content with so many rows in the sampled documents counts as hot, and gets tiles of about TILE_ROWS rows.
SAMPLED, HOT_ROWS, TILE_ROWS = 64, 32, 2_048
SMALL_RUN = 64


def normal(line: str) -> str:
    return " ".join(line.split())


def within(a: str, b: str, k: int) -> bool:
    """Whether the edit distance is k at most: bit vectors over the band of 2k + 1 diagonals.

    >>> within("kitten", "sitting", 3), within("kitten", "sitting", 2)
    (True, False)
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > k:
        return False
    if a == b:
        return True
    while b and a[0] == b[0]:
        n = 1
        while n * 2 <= len(b) and a[: n * 2] == b[: n * 2]:
            n *= 2
        a, b = a[n:], b[n:]
    while b and a[-1] == b[-1]:
        n = 1
        while n * 2 <= len(b) and a[-n * 2 :] == b[-n * 2 :]:
            n *= 2
        a, b = a[:-n], b[:-n]
    if not b:
        return len(a) <= k
    if len(a) <= k:
        return True  # substitutions and deletions suffice
    # Columns are b, rows are a; bit ``top`` of the window is row column + k. Differences between neighbours
    # are single bits, and the window moves down a row with each column.
    width = 2 * k + 2
    full, top = (1 << width) - 1, 1 << (width - 1)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    plus, minus = full ^ ((1 << (width - k - 1)) - 1), 0
    distance, along = k, top >> 1
    for j, c in enumerate(b):
        start = j + 1 + k - width
        rows = where.get(c, 0)
        same = (rows >> start if start >= 0 else rows << -start) & full
        zero = ((((same & plus) + plus) ^ plus) | same | minus) & full
        right_plus = (minus | ~(zero | plus)) & full
        right_minus = zero & plus
        if j + k < len(a):
            distance += not zero & top
        else:
            distance += bool(right_plus & along) - bool(right_minus & along)
            along >>= 1
        plus = (right_minus | ~((zero >> 1) | right_plus)) & full
        minus = (zero >> 1) & right_plus
    if len(b) + k < len(a):
        return False
    return distance <= k


def probes(tau: int = TAU) -> list[tuple[int, int, int]]:
    """(missing length, segment, shift from the segment's place) of every substring to probe."""
    out = []
    for less in range(tau + 1):
        for i in range(tau + 1):
            low, high = max(-i, less - (tau - i)), min(i, less + (tau - i))
            out += [(less, i, shift) for shift in range(low, high + 1)]
    return out


def segments(length: np.ndarray, i: int, tau: int = TAU) -> tuple[np.ndarray, np.ndarray]:
    """(place, size) of the i-th of tau + 1 even segments; the later ones are longer by one if needed."""
    size, extra = np.divmod(length, tau + 1)
    longer = np.maximum(i - (tau + 1 - extra), 0)
    return i * size + longer, size + (i >= tau + 1 - extra)


def index_rows(lines: list[str], tau: int = TAU) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, key, bag) of all index and probe rows of the lines."""
    points = np.frombuffer("".join(lines).encode("utf-32-le"), dtype="<u4")
    n = np.array([len(x) for x in lines], dtype=np.int64)
    begin = np.cumsum(n) - n
    up, down = powers(len(points) + 1)
    sums = np.zeros(len(points) + 1, dtype=np.uint64)
    np.cumsum(points.astype(np.uint64) * up[: len(points)], out=sums[1:])
    counts = np.bincount(np.repeat(np.arange(len(n)), n) * 16 + (points & 15), minlength=16 * len(n)).reshape(-1, 16) & 15
    bags = (counts.astype(np.uint64) << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=1, dtype=np.uint64)
    owners, keys = [], []
    salt = numbers(41, 3)
    for less, i, shift in probes(tau):
        length = n - less
        place, size = segments(length, i, tau)
        place = place + shift
        ok = np.flatnonzero((length >= MIN_CHARS) & (place >= 0) & (place + size <= n))
        s = begin[ok] + place[ok]
        h = (sums[s + size[ok]] - sums[s]) * down[s]
        content = mixed(h * salt[0] + length[ok].astype(np.uint64) * salt[1] + np.uint64(i) * salt[2])
        keys.append(content & ~np.uint64(INDEX | SIDE) | np.uint64(INDEX if less == 0 and shift == 0 else 0))
        owners.append(ok)
    owner = np.concatenate(owners)
    return owner, np.concatenate(keys), bags[owner]


def bag_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """At most how many character counts differ by one, at least; each edit changes two at most."""
    total = np.zeros(np.broadcast(a, b).shape, dtype=np.int64)
    for k in range(0, 64, 4):
        d = ((a >> np.uint64(k)) - (b >> np.uint64(k))) & np.uint64(15)
        total += np.minimum(d, np.uint64(16) - d).astype(np.int64)
    return total


def line_keys(lines: list[str]) -> np.ndarray:
    """128-bit content keys as rows of two integers."""
    raw = b"".join(hashlib.blake2b(x.encode(), digest_size=16).digest() for x in lines)
    return np.frombuffer(raw, dtype="<i8").reshape(-1, 2)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text", 1 << 19):
        numbers_, his, los = [], [], []
        own = [[(i, x) for i, raw in enumerate(t.split("\n")) if (x := normal(raw))] for t in texts(batch)]
        keys = line_keys([x for doc in own for _, x in doc])
        at = 0
        for doc in own:
            numbers_.append([i for i, _ in doc])
            his.append(keys[at : at + len(doc), 0].tolist())
            los.append(keys[at : at + len(doc), 1].tolist())
            at += len(doc)
        lists = (pa.array(x, pa.list_(t)) for x, t in ((numbers_, pa.int32()), (his, pa.int64()), (los, pa.int64())))
        yield pa.record_batch([batch.column("doc_id"), batch.column("__rid"), *lists], names=["doc_id", "__rid", "line", "hi", "lo"])


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for batch in pieces(batches, "text", 1 << 18):
        long = [x for t in texts(batch) for raw in t.split("\n") if len(x := normal(raw)) >= MIN_CHARS]
        fresh, los = [], []
        for x, lo in zip(long, line_keys(long)[:, 1].tolist()):
            if lo not in seen:
                seen.add(lo)
                fresh.append(x)
                los.append(lo)
        if len(seen) > 300_000:
            seen.clear()
        if fresh:
            owner, key, bag = index_rows(fresh)
            yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(np.array(los)[owner]), pa.array(bag.view(np.int64))], names=["key", "lo", "bag"])


def _bits(bag: np.ndarray) -> np.ndarray:
    """The 16 counts of each bag."""
    return ((bag[:, None] >> (np.arange(16, dtype=np.uint64) * np.uint64(4))[None, :]) & np.uint64(15)).astype(np.uint8)


class Meeting:
    """Candidate links of rows (key, lo, bag) with one content."""

    def __init__(self, most: int = 200_000):
        self.most = most
        self.forest = Forest()
        self.out: list[tuple[int, int]] = []

    def link(self, a: int, b: int) -> None:
        if self.forest.join(a, b):
            self.out.append((a, b))

    def add(self, key: np.ndarray, lo: np.ndarray, bag: np.ndarray) -> None:
        """Links a block of whole runs of one content."""
        content = key >> 2
        begin = np.flatnonzero(np.concatenate([[True], content[1:] != content[:-1]]))
        size = np.diff(np.append(begin, len(key)))
        mixed_ = np.maximum.reduceat(lo, begin) != np.minimum.reduceat(lo, begin)
        for k in np.flatnonzero(mixed_ & (size > SMALL_RUN)).tolist():
            self._large(*(x[begin[k] : begin[k] + size[k]] for x in (key, lo, bag)))
        small = np.repeat(mixed_ & (size <= SMALL_RUN), size)
        if small.any():
            run = np.repeat(np.arange(len(size)), size)[small]
            self._small(run, key[small], lo[small], bag[small])
        if len(self.forest.up) > self.most:
            self.forest = Forest()

    def _small(self, run: np.ndarray, key: np.ndarray, lo: np.ndarray, bag: np.ndarray) -> None:
        held = np.flatnonzero(key & INDEX)
        start, stop = np.searchsorted(run[held], run), np.searchsorted(run[held], run, side="right")
        n = stop - start
        p = np.repeat(np.arange(len(run)), n)
        q = held[np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)]
        apart = lo[p] != lo[q]
        p, q = p[apart], q[apart]
        near = bag_distance(bag[p], bag[q]) <= 2 * TAU
        for a, b in zip(lo[p[near]].tolist(), lo[q[near]].tolist()):
            self.link(a, b)

    def _large(self, key: np.ndarray, lo: np.ndarray, bag: np.ndarray) -> None:
        lo, first, same = np.unique(lo, return_index=True, return_inverse=True)  # a line may come from many tasks
        index = np.zeros(len(lo), dtype=bool)
        index[same[(key & INDEX) > 0]] = True
        side, counts = key[first] & SIDE, _bits(bag[first])
        across = side.min() != side.max()
        held = np.flatnonzero(index)
        group = np.arange(len(held))
        for k in range(0, len(lo) if len(held) else 0, 256):
            own = counts[k : k + 256]
            total = np.zeros((len(own), len(held)), dtype=np.uint8)
            for c in range(16):
                d = (own[:, None, c] - counts[held][None, :, c]) & 15
                total += np.minimum(d, 16 - d)
            near = total <= 2 * TAU
            if across:
                near &= side[k : k + 256, None] != side[held][None, :]
            for x in np.flatnonzero(near.any(axis=1)).tolist():
                mine = np.flatnonzero(near[x])
                mine = mine[held[mine] != k + x]
                if len(mine):
                    self.link(int(lo[k + x]), int(lo[held[mine[0]]]))
                    names = np.unique(group[mine])
                    if len(names) > 1:
                        for name in names[1:].tolist():
                            self.link(int(lo[held[names[0]]]), int(lo[held[name]]))
                        group[np.isin(group, names)] = names[0]

    def batch(self) -> pa.RecordBatch:
        a, b = zip(*self.out)
        self.out = []
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate links of rows sorted by key; a run of rows may reach over batches."""
    meeting = Meeting()
    kept: list[tuple] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        own = (batch.column("key").to_numpy(), batch.column("lo").to_numpy(), batch.column("bag").to_numpy().view(np.uint64))
        if kept and own[0][0] >> 2 == own[0][-1] >> 2 == kept[0][0][-1] >> 2:
            kept.append(own)
            continue
        own = tuple(np.concatenate(x) for x in zip(*kept, own))
        cut = int(np.searchsorted(own[0], own[0][-1] >> 2 << 2))
        if cut:
            meeting.add(*(x[:cut] for x in own))
        kept = [tuple(x[cut:] for x in own)]
        if meeting.out:
            yield meeting.batch()
    if kept:
        meeting.add(*(np.concatenate(x) for x in zip(*kept)))
        if meeting.out:
            yield meeting.batch()


def tiled(rows: DataFrame) -> DataFrame:
    """Index rows (key, lo, bag) of (__rid, text); the rows of a hot content stand once for each pair of tiles, under that pair's key."""
    kind = "key bigint, lo bigint, bag bigint"
    index = rows.select("text").mapInArrow(_index, kind)
    some = rows.where(F.pmod(F.xxhash64("__rid"), F.lit(SAMPLED)) == 0).select("text").mapInArrow(_index, kind)
    content = F.shiftright("key", 2).alias("content")
    hot = staged(some.groupBy(content).count().where(F.col("count") >= HOT_ROWS).select("content", F.ceil(F.col("count") * SAMPLED / TILE_ROWS).cast("int").alias("g")), "hot-keys")
    if not (count := hot.count()):
        return index
    known = index.withColumn("content", content).join(checked_broadcast(hot, count, 500_000), "content", "left")
    own = F.pmod(F.xxhash64("lo"), F.coalesce("g", F.lit(1))).cast("int")
    units = known.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("g", F.lit(1)) - 1)))
    pair = F.shiftleft(F.xxhash64("content", F.least("own", "other"), F.greatest("own", "other")), 2)
    side = F.when(F.col("own") > F.col("other"), SIDE).otherwise(0)
    return units.select(F.when(F.col("g") > 1, pair.bitwiseOR(F.col("key").bitwiseAND(INDEX)).bitwiseOR(side)).otherwise(F.col("key")).alias("key"), "lo", "bag")


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, wanted in zip(texts(batch), batch.column("wanted").to_pylist()):
            lines = text.split("\n")
            out += [(w["component"], w["hi"], w["lo"], normal(lines[w["line"]])) for w in wanted]
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["component", "hi", "lo", "text"])


def near_pairs(lines: list[str], side: list[int], tau: int = TAU) -> Iterator[tuple[int, int]]:
    """Pairs of different lines within tau edits; with two sides only pairs across them."""
    order = sorted(range(len(lines)), key=lambda k: len(lines[k]))
    size = np.array([len(lines[k]) for k in order])
    points = [np.bincount(np.frombuffer(lines[k].encode("utf-32-le"), dtype="<u4") & 15, minlength=16) for k in order]
    counts = np.array(points).reshape(-1, 16)
    both = len(set(side)) == 2
    sides = np.array([side[k] for k in order])
    for x in range(len(order)):
        last = int(np.searchsorted(size, size[x] + tau, side="right"))
        if last <= x + 1:
            continue
        ok = np.abs(counts[x + 1 : last] - counts[x]).sum(axis=1) <= 2 * tau
        if both:
            ok &= sides[x + 1 : last] != sides[x]
        for y in (np.flatnonzero(ok) + x + 1).tolist():
            if within(lines[order[x]], lines[order[y]], tau):
                yield order[x], order[y]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, uid, side, text = None, [], [], []

    def done() -> Iterator[pa.RecordBatch]:
        if len(uid) > 1 and (key[1] == key[2] or len(set(side)) == 2):
            forest, out, count = Forest(), [], [0] * len(uid)
            for x, y in near_pairs(text, side):
                count[x] += 1
                count[y] += 1
                if forest.join(uid[x], uid[y]):
                    out.append((uid[x], uid[y], 0))
            out += [(u, None, n) for u, n in zip(uid, count) if n]
            if out:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b", "links"])

    for batch in batches:
        for c, i, j, u, own, x in zip(*(batch.column(c).to_pylist() for c in ("component", "i", "j", "uid", "own", "text"))):
            if (c, i, j) != key:
                if key:
                    yield from done()
                key, uid, side, text = (c, i, j), [], [], []
            uid.append(u)
            side.append(own)
            text.append(x)
    if key:
        yield from done()


def near_classes(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """(hi, lo, class_hi, class_lo, n_links) of the lines with a near line; rows: (doc_id, __rid, text)."""
    edges = dealt(tiled(rows), F.shiftright("key", 2)).sortWithinPartitions("key").mapInArrow(_meet, "a bigint, b bigint")
    candidates = staged(connected_components(edges, "line-candidates", thin=False), "line-candidates")
    some = checked_broadcast(candidates, candidates.count(), 500_000)
    each = lines.select("__rid", F.explode(F.arrays_zip("line", "hi", "lo")).alias("x")).select("__rid", "x.*")
    first = each.join(some.withColumnRenamed("node", "lo"), "lo").groupBy("hi", "lo", "component").agg(F.min(F.struct("__rid", "line")).alias("first"))
    wanted = staged(first.groupBy(F.col("first.__rid").alias("__rid")).agg(F.collect_list(F.struct("component", "hi", "lo", F.col("first.line").alias("line"))).alias("wanted")), "wanted")
    texts_ = rows.select("__rid", "text").join(checked_broadcast(wanted, wanted.count(), 200_000), "__rid")
    found = staged(texts_.mapInArrow(_fetch, "component bigint, hi bigint, lo bigint, text string").withColumn("uid", F.monotonically_increasing_id()), "candidate-lines")
    blocks = found.groupBy("component").agg(F.ceil(F.count("*") / BLOCK_LINES).cast("int").alias("g"))
    units = found.join(blocks, "component").withColumn("own", F.pmod(F.hash("uid"), "g"))
    spread = units.select("*", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("other")).select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "uid", "own", "text")
    links = staged(dealt(spread, "component", "i", "j").sortWithinPartitions("component", "i", "j", "uid").mapInArrow(_verify, "a bigint, b bigint, links bigint"), "line-links")
    classes = connected_components(links.where("b is not null").select("a", "b"), "line-classes").withColumnRenamed("node", "uid")
    counts = links.where("b is null").groupBy(F.col("a").alias("uid")).agg(F.sum("links").alias("n_links"))
    named = found.select("uid", "hi", "lo")
    heads = named.select(F.col("uid").alias("component"), F.col("hi").alias("class_hi"), F.col("lo").alias("class_lo"))
    return classes.join(named, "uid").join(heads, "component").join(counts, "uid", "left").select("hi", "lo", "class_hi", "class_lo", "n_links")


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, __rid, n_lines, n_kept, n_near, n_links, dropped (line numbers, ascending)."""
    docs = settled(docs)
    rows = with_row_id(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))).select("doc_id", "__rid", "text")
    lines = staged(rows.mapInArrow(_lines, "doc_id bigint, __rid bigint, line array<int>, hi array<bigint>, lo array<bigint>"), "lines")
    near = staged(near_classes(rows, lines), "near-lines")
    each = lines.select("doc_id", "__rid", F.explode(F.arrays_zip("line", "hi", "lo")).alias("x")).select("doc_id", "__rid", "x.*")
    named = each.join(checked_broadcast(near, near.count(), 500_000), ["hi", "lo"], "left").withColumn("class_hi", F.coalesce("class_hi", "hi")).withColumn("class_lo", F.coalesce("class_lo", "lo"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__rid", "line")
    first = named.groupBy("class_hi", "class_lo").agg(F.min(F.struct(place.alias("place"), "hi", "lo")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = named.join(staged(first, "first-lines"), ["class_hi", "class_lo"]).select("__rid", "line", "n_links", F.struct("__rid", "line") != F.struct("first.place.__rid", "first.place.line"), ((F.col("hi") != F.col("first.hi")) | (F.col("lo") != F.col("first.lo"))).alias("near")).toDF("__rid", "line", "n_links", "gone", "near")
    dropped = again.groupBy("__rid").agg(F.array_sort(F.collect_list(F.when(F.col("gone"), F.col("line")))).alias("dropped"), F.sum((F.col("gone") & F.col("near")).cast("bigint")).alias("n_near"), F.sum(F.coalesce("n_links", F.lit(0))).alias("n_links"))
    out = lines.select("doc_id", "__rid", F.size("line").cast("bigint").alias("n_lines")).join(dropped, "__rid", "left")
    none = F.lit(0).cast("bigint")
    return out.select("doc_id", "__rid", "n_lines", (F.col("n_lines") - F.coalesce(F.size("dropped"), F.lit(0))).alias("n_kept"), F.coalesce("n_near", none).alias("n_near"), F.coalesce("n_links", none).alias("n_links"), F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the lines that repeat an earlier one; texts are otherwise unchanged."""
    docs = settled(docs)
    gone = assign(docs, id_col, text_col).where("size(dropped) > 0").select("__rid", F.col("dropped").alias("__dropped"))
    rows = with_row_id(docs).join(gone, "__rid", "left")
    kept = F.filter(F.split(text_col, "\n"), lambda x, i: ~F.array_contains("__dropped", i))
    text = F.when(F.col("__dropped").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    return rows.withColumn(text_col, text).select(*docs.columns)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = assign(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_kept", "n_near", "n_links", F.concat_ws(",", "dropped").alias("dropped_lines"))
