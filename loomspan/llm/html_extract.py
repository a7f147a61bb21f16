"""Main text of web pages by wrapper induction.

Pages of one host share a template. The trees of a host's pages, each distinct structure once, are aligned one
after the other by simple tree matching: nodes of one key match, and the largest ordered matching of their kids
is found by dynamic programming. Merged, they are the host's wrapper; structures are dealt into ``BUCKETS`` of a
host, whose merged trees are merged again, so that no task meets all of a large host.

Each page is then aligned with the wrapper, and (host, node, text) is counted over all pages, copies once. A text that stands
in one node on at least half of the pages that have the node, and on three at least, is template; everything
else in that node is a slot's content.

The main region of a page is where the varying text of its slots gathers, each text counted once and links not, so that
teasers that come again from page to page weigh little. ``article`` and ``main`` are hints: see ``main_nodes``. Of each
page, text blocks are kept where they are in the region and not template; template headings stay between and beside
blocks that are kept ("Ingredients", "Method"). What a page itself marks as something else
(menus, headers, footers, asides, forms, adverts, notices, comments) is left out by tag, role and names of class
and id before that; see ``dom.names_region``. Alignments and regions are found once for each structure of pages.

Pages are read three times and never sampled; what is shuffled are structures and hashes of texts. Wrappers are
broadcast only if their counted size is small, else joined by host with Spark's skew handling.

Cases: null html is empty text; null or odd urls have the host '', which has no wrapper; hosts with fewer than
three different pages have no template texts; copies of a page and repeated rows count once where template
texts are learnt (of copies that differ around the main text, one is taken), and are extracted each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checked_broadcast, dealt, host_of, pieces, staged, table, texts
from .dom import HEADINGS, Page, parse

BUCKETS = 16
PLACED = "host string, content bigint, texts array<struct<slot: int, mark: bigint, chars: bigint>>"
LEAST_PAGES, SHARE, REGION = 3, 0.5, 0.8
CONTAINERS = {"html", "body", "div", "section", "article", "main", "center", "table", "tbody", "tr", "td", "details", "fieldset"}


class Tree:
    """Keys and kids by node."""

    def __init__(self, keys: list[str], parents: list[int]):
        self.keys, self.parents = list(keys), list(parents)
        self.kids: list[list[int]] = [[] for _ in keys]
        for k, p in enumerate(parents):
            if p >= 0:
                self.kids[p].append(k)

    def add(self, key: str, parent: int, place: int) -> int:
        self.keys.append(key)
        self.parents.append(parent)
        self.kids.append([])
        self.kids[parent].insert(place, len(self.keys) - 1)
        return len(self.keys) - 1


def tree_match(a: Tree, b: Tree) -> dict[int, int]:
    """Nodes of ``a`` to nodes of ``b`` in the largest top-down ordered matching of equal keys."""
    pairs = [(0, 0)] if a.keys[0] == b.keys[0] else []  # that may match, parents before their kids
    at: dict[tuple[int, int], int] = {p: k for k, p in enumerate(pairs)}
    for x, y in pairs:
        for u in a.kids[x]:
            for v in b.kids[y]:
                if a.keys[u] == b.keys[v] and (u, v) not in at:
                    at[u, v] = len(pairs)
                    pairs.append((u, v))
    size = [1] * len(pairs)

    def rows(x: int, y: int) -> list[list[int]]:
        ys = b.kids[y]
        m = [[0] * (len(ys) + 1)]
        for u in a.kids[x]:
            row, above = [0], m[-1]
            for j, v in enumerate(ys):
                best = row[j] if row[j] > above[j + 1] else above[j + 1]
                k = at.get((u, v))
                if k is not None and above[j] + size[k] > best:
                    best = above[j] + size[k]
                row.append(best)
            m.append(row)
        return m

    for k in range(len(pairs) - 1, -1, -1):
        x, y = pairs[k]
        if a.kids[x] and b.kids[y]:
            size[k] = 1 + rows(x, y)[-1][-1]
    found: dict[int, int] = {}
    todo = pairs[:1]
    while todo:
        x, y = todo.pop()
        found[x] = y
        m = rows(x, y)
        i, j = len(m) - 1, len(m[0]) - 1
        while i and j:
            u, v = a.kids[x][i - 1], b.kids[y][j - 1]
            k = at.get((u, v))
            if k is not None and m[i][j] == m[i - 1][j - 1] + size[k]:
                todo.append((u, v))
                i, j = i - 1, j - 1
            elif m[i][j] == m[i - 1][j]:
                i -= 1
            else:
                j -= 1
    return found


def merge(wrapper: Tree, page: Tree) -> dict[int, int]:
    """Adds what the wrapper lacks of the page; returns the page's nodes in it."""
    found = tree_match(page, wrapper)
    for x in range(len(page.keys)):
        if x not in found:
            parent = page.parents[x]
            before = page.kids[parent]
            k = before.index(x)
            place = wrapper.kids[found[parent]].index(found[before[k - 1]]) + 1 if k else 0
            found[x] = wrapper.add(page.keys[x], found[parent], place)
    return found


def mark(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def shape(trees: Iterable[Tree]) -> Tree:
    """The trees merged into one, its nodes in page order."""
    wrapper = Tree([""], [-1])
    for tree in trees:
        merge(wrapper, tree)
    keys, parents, todo = [], [], [(0, -1)]
    while todo:
        node, parent = todo.pop()
        keys.append(wrapper.keys[node])
        parents.append(parent)
        todo += [(c, len(keys) - 1) for c in reversed(wrapper.kids[node])]
    return Tree(keys, parents)


def totals(tree: Tree, varying: Mapping[int, float]) -> list[float]:
    """The varying text at or below each node."""
    below = [varying.get(k, 0) for k in range(len(tree.keys))]
    for k in range(len(below) - 1, 0, -1):
        below[tree.parents[k]] += below[k]
    return below


def region(tree: Tree, below: list[float]) -> int:
    """The deepest container that has most of the varying text at or below it."""
    node, least = 0, REGION * below[0]
    inner = lambda k: [c for c in tree.kids[k] if tree.keys[c].split(".")[0] in CONTAINERS]
    while (best := max(inner(node), key=lambda c: below[c], default=None)) is not None and below[best] >= least > 0:
        node = best
    return node


def hinted(key: str) -> bool:
    tag, *names = key.split(".")
    return tag in ("article", "main") or "main" in names


def main_nodes(tree: Tree, varying: Mapping[int, float]) -> tuple[frozenset[int], bool]:
    """The nodes of the main region, and whether ``article`` or ``main`` bounds it.

    The region of the varying text counts. One inside such an element is widened to it, for the headline, without
    other articles beside it; one around such elements is narrowed to them if they have half of the text.
    """
    below, hints = totals(tree, varying), [hinted(k) for k in tree.keys]
    node = top = region(tree, below)
    path = {node}
    while top >= 0 and not hints[top]:
        top = tree.parents[top]
        path.add(top)
    under: set[int] = set()
    outer = []
    for x, p in enumerate(tree.parents):
        if x == node or p in under:
            under.add(x)
            if hints[x] and not any(hints[y] for y in _above(tree, x, node)):
                outer.append(x)
    if top >= 0:
        roots, skip = {top}, {x for x, h in enumerate(hints) if h and x not in path and x not in under}
    elif outer and sum(below[x] for x in outer) >= SHARE * below[0]:
        roots, skip = set(outer), set()
    else:
        roots, skip = {node}, set()
    inside: set[int] = set()
    for x, p in enumerate(tree.parents):
        if (x in roots or p in inside) and x not in skip:
            inside.add(x)
    return frozenset(inside), roots != {node} or hints[node]


def _above(tree: Tree, x: int, top: int) -> Iterator[int]:
    while x != top:
        x = tree.parents[x]
        yield x


class Wrapper:
    """The wrapper of one host: its tree, and of each slot (node, weight of the varying text, marks of the template texts)."""

    def __init__(self, code: dict):
        self.tree = Tree(**code["tree"])
        self.fixed = {(x["slot"], t) for x in code["slots"] for t in x["marks"]}
        self.weight = {x["slot"]: x["weight"] for x in code["slots"]}
        self.places = lru_cache(4_000)(self._places)

    def _places(self, structure: tuple) -> tuple[dict[int, int], frozenset[int], bool]:
        """The wrapper's node of each node of pages of that structure, and what main_nodes finds among the page's slots."""
        page = Tree([k for k, _ in structure], [p for _, p in structure])
        found = tree_match(page, self.tree)
        return found, *main_nodes(page, {x: self.weight.get(w, 0) for x, w in found.items()})

    def text(self, page: Page) -> str:
        found, inside, marked = self.places(page.structure())
        fresh = [(found.get(b[0], -1), mark(b[1])) not in self.fixed for b in page.blocks]
        varying = [i for i, b in enumerate(page.blocks) if fresh[i] and b[0] in inside]
        if varying:  # a heading that comes again from page to page, amid the article's own texts and beside some, is the article's
            homes = {page.parents[page.blocks[i][0]] for i in varying}
            for i in range(varying[0] + 1, varying[-1]):
                node = page.blocks[i][0]
                fresh[i] |= node in inside and page.parents[node] in homes and page.keys[node].split(".")[0] in HEADINGS
        return joined([b for b, own in zip(page.blocks, fresh) if own], page, inside, marked)


def joined(blocks: list[tuple[int, str, bool, int]], page: Page, inside: frozenset[int], marked: bool) -> str:
    own = [b for b in blocks if b[0] in inside]
    if not own and not (marked and any(b[0] in inside for b in page.blocks)):
        own = blocks
    return "\n".join(b[1] for b in own)


def alone(page: Page) -> str:
    """The main text of a page whose host has no wrapper."""
    varying = Counter()
    for node, text, _, linked in page.blocks:
        varying[node] += max(len(text) - linked, 0)
    return joined(page.blocks, page, *main_nodes(Tree(page.keys, page.parents), varying))


def _structures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, structure) of the pages, each once a task as far as memory goes."""
    seen: set[tuple[str, int]] = set()
    for batch in pieces(batches, "html", 2 << 20):
        out = []
        for host, source in zip(batch.column("host").to_pylist(), texts(batch, "html")):
            page = parse(source)
            code = json.dumps({"keys": page.keys, "parents": page.parents})
            if (host, key := mark(code)) not in seen:
                seen.add((host, key))
                out.append((host, code))
        if len(seen) > 200_000:
            seen.clear()
        if out:
            yield pa.record_batch([pa.array(c, pa.string()) for c in zip(*out)], names=["host", "structure"])


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One merged tree for each run of rows of one (host, bucket)."""

    def rows() -> Iterator[tuple[tuple, Tree]]:
        for batch in batches:
            for host, bucket, code in zip(*(batch.column(c).to_pylist() for c in ("host", "bucket", "structure"))):
                yield (host, bucket), Tree(**json.loads(code))

    for (host, _), own in groupby(rows(), key=lambda r: r[0]):
        tree = shape(t for _, t in own)
        yield pa.record_batch([pa.array([host]), pa.array([json.dumps({"keys": tree.keys, "parents": tree.parents})])], names=["host", "structure"])


def shapes(pages: DataFrame) -> DataFrame:
    """(host, tree): every distinct structure of a host's pages, merged in buckets first and then over the buckets."""
    found = pages.select("host", "html").mapInArrow(_structures, "host string, structure string").distinct()
    for bucket in (F.pmod(F.xxhash64("structure"), F.lit(BUCKETS)).cast("int"), F.lit(0)):
        keyed = dealt(found.withColumn("bucket", bucket), "host", "bucket").sortWithinPartitions("host", "bucket", "structure")
        found = keyed.mapInArrow(_shapes, "host string, structure string")
    return staged(found.withColumnRenamed("structure", "tree"), "shapes")


def content(page: Page) -> int:
    """The same for copies: a hash of the texts that are not mostly links, in ``article`` or ``main`` if most of them are there."""
    plain = [b for b in page.blocks if b[3] <= 0.5 * len(b[1])] or page.blocks
    inside = [b for b in plain if b[2]]
    if 2 * sum(len(b[1]) for b in inside) > sum(len(b[1]) for b in plain):
        plain = inside
    return mark("\n".join(b[1] for b in plain))


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, content, texts) of each page: (slot, mark, characters outside links) of its texts, each once, and (slot, null, 0) of its slots."""
    known = lru_cache(2_000)(lambda code: Wrapper({"tree": json.loads(code), "slots": []}))
    kind = pa.list_(pa.struct([("slot", pa.int32()), ("mark", pa.int64()), ("chars", pa.int64())]))
    for batch in pieces(batches, "html", 2 << 20):
        contents, out = [], []
        for source, code in zip(texts(batch, "html"), batch.column("tree").to_pylist()):
            page = parse(source)
            contents.append(content(page))
            found = known(code).places(page.structure())[0]
            own = sorted({(found[b[0]], mark(b[1]), max(len(b[1]) - b[3], 0)) for b in page.blocks})
            out.append([{"slot": s, "mark": t, "chars": n} for s, t, n in own] + [{"slot": s, "mark": None, "chars": 0} for s in sorted({x[0] for x in own})])
        yield pa.record_batch([batch.column("host"), pa.array(contents, pa.int64()), pa.array(out, kind)], names=["host", "content", "texts"])


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper) of every host but '', from all its pages."""
    pages = pages.where("host <> ''")
    trees = shapes(pages)
    size = trees.agg(F.coalesce(F.sum(F.length("tree")), F.lit(0))).first()[0]
    placed = pages.join(checked_broadcast(trees, size, 16 << 20), "host").select("host", "html", "tree").mapInArrow(_placed, PLACED)
    distinct = placed.groupBy("host", "content").agg(F.min("texts").alias("texts"))
    each = distinct.select("host", F.explode("texts").alias("t")).select("host", "t.*")
    counts = staged(each.groupBy("host", "slot", "mark").agg(F.count("*").alias("n"), F.max("chars").alias("chars")), "counts")

    slots = counts.groupBy("host", "slot").agg(F.max(F.when(F.col("mark").isNull(), F.col("n"))).alias("held"), F.sum("chars").alias("chars"))
    slots = staged(slots, "slots")
    often = counts.where(F.col("mark").isNotNull() & (F.col("n") >= LEAST_PAGES)).join(checked_broadcast(slots.select("host", "slot", "held"), slots.count(), 500_000), ["host", "slot"])
    fixed = often.where(F.col("n") >= SHARE * F.col("held")).groupBy("host", "slot").agg(F.sum("chars").alias("fixed_chars"), F.array_sort(F.collect_list("mark")).alias("marks"))
    weight = ((F.col("chars") - F.coalesce("fixed_chars", F.lit(0))) / F.col("held")).alias("weight")
    judged = slots.join(fixed, ["host", "slot"], "left").select("host", F.struct("slot", weight, F.coalesce("marks", F.array().cast("array<bigint>")).alias("marks")).alias("s"))
    listed = judged.groupBy("host").agg(F.to_json(F.array_sort(F.collect_list("s"))).alias("slots"))
    return trees.join(listed, "host").select("host", F.concat(F.lit('{"tree": '), "tree", F.lit(', "slots": '), "slots", F.lit("}")).alias("wrapper"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every row of (page_id, url, html)."""
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    learnt = staged(wrappers(rows), "wrappers")
    size = learnt.agg(F.coalesce(F.sum(F.length("wrapper")), F.lit(0))).first()[0]
    joined_rows = rows.join(checked_broadcast(learnt, size, 16 << 20), "host", "left").select("page_id", "url", "html", "host", "wrapper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(2_000)(lambda code: Wrapper(json.loads(code)))
        for batch in pieces(batches, "html", 2 << 20):
            codes = batch.column("wrapper").to_pylist()
            out = [known(code).text(parse(x)) if code else alone(parse(x)) for x, code in zip(texts(batch, "html"), codes)]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    return joined_rows.mapInArrow(run, "page_id bigint, url string, text string")


def op10_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages").select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html"))
    return found.withColumn("n_chars", F.length("text").cast("bigint"))
