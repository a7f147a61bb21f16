"""Cover trees over integer vectors, and the nearest centroid of every vector by a walk over two trees at once."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

BASE = 1.3
#: Below it, squared distances of 64 components are exact in doubles; above, whole numbers of 64 bits are used.
FLOAT_LIMIT = 1 << 22


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of a to those of b (int64)."""
    most = max((int(np.abs(x).max(initial=0)) for x in (a, b)), default=0)
    if 4 * a.shape[-1] * most**2 >= 1 << 63:
        raise ValueError("the components are too large: a squared distance does not fit in 64 bits")
    if most <= FLOAT_LIMIT and 4 * a.shape[-1] * most**2 < 1 << 53:
        a, b = a.astype(np.float64), b.astype(np.float64)
    return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)).astype(np.int64)


def squared_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of row i of a to row i of b."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


@dataclass
class Tree:
    """Distinct points in the order of the tree, and its nodes; the points of a node stand together.

    A node has a point as its centre and holds points low to high; all lie within ``radius`` of the centre. Kids of a
    node of radius r are the centres of a net: more than s apart and every point of the node within s of one, where s is
    the largest power of BASE below r; the node's own centre is one of them. ``kids`` is 0 for leaves.
    """

    points: np.ndarray
    order: np.ndarray  # for each row given, its point
    center: np.ndarray
    low: np.ndarray
    high: np.ndarray
    radius: np.ndarray
    child: np.ndarray
    kids: np.ndarray

    @staticmethod
    def over(rows: np.ndarray, leaf: int) -> Tree:
        """Of one row or more; nodes of up to ``leaf`` distinct points are not divided."""
        points, given = np.unique(rows, axis=0, return_inverse=True)
        distance = np.sqrt(squared(points, points).astype(np.float64))
        todo = [(0, np.arange(len(points)))]
        radius, child, kids = [], [], []
        for node, (c, held) in enumerate(todo):  # grows while it is read
            near = distance[c, held]
            r = float(near.max())
            radius.append(r)
            child.append(len(todo))
            if len(held) <= leaf:
                kids.append(0)
                continue
            s = BASE ** (math.ceil(math.log(r, BASE)) - 1)
            s = s if s < r else s / BASE
            centers, owner = [c], np.zeros(len(held), dtype=np.int64)
            while near[far := int(near.argmax())] > s:
                d = distance[held[far], held]
                owner[d < near] = len(centers)
                near = np.minimum(near, d)
                centers.append(int(held[far]))
            by = np.argsort(owner, kind="stable")
            parts = np.split(held[by], np.flatnonzero(np.diff(owner[by])) + 1)
            todo += zip(centers, parts)
            kids.append(len(centers))
        sizes = np.array([len(held) for _, held in todo])
        low = np.zeros(len(todo), dtype=np.int64)
        place = np.zeros(len(points), dtype=np.int64)
        for node, (_, held) in enumerate(todo):
            if kids[node]:
                own = slice(child[node], child[node] + kids[node])
                low[own] = low[node] + np.cumsum(sizes[own]) - sizes[own]
            else:
                place[held] = low[node] + np.arange(len(held))
        back = np.empty_like(place)
        back[place] = np.arange(len(place))
        return Tree(points[back], place[given.reshape(-1)], place[[c for c, _ in todo]], low, low + sizes, np.array(radius), np.array(child), np.array(kids))

    def packed(self) -> dict[str, bytes]:
        wide = "<i4" if np.abs(self.points).max() < 1 << 31 else "<i8"
        nodes = np.stack([self.center, self.low, self.high, self.child, self.kids]).astype("<i4")
        return {"points": self.points.astype(wide).tobytes(), "order": self.order.astype("<i4").tobytes(), "nodes": nodes.tobytes(), "radius": self.radius.astype("<f8").tobytes()}

    @staticmethod
    def unpacked(points: bytes, order: bytes, nodes: bytes, radius: bytes, dim: int) -> Tree:
        radii, given = np.frombuffer(radius, "<f8"), np.frombuffer(order, "<i4").astype(np.int64)
        center, low, high, child, kids = np.frombuffer(nodes, "<i4").astype(np.int64).reshape(5, -1)
        distinct = int(high[0])
        x = np.frombuffer(points, "<i4" if len(points) == 4 * distinct * dim else "<i8").astype(np.int64).reshape(distinct, dim)
        return Tree(x, given, center, low, high, radii, child, kids)


@dataclass
class Centroids:
    """Centroids and a tree over the distinct ones; of equal ones the first counts."""

    rows: np.ndarray
    tree: Tree
    number: np.ndarray  # of each point of the tree

    @staticmethod
    def of(rows: np.ndarray) -> Centroids:
        tree = Tree.over(rows, 1)
        number = np.full(len(tree.points), len(rows))
        np.minimum.at(number, tree.order, np.arange(len(rows)))
        return Centroids(rows, tree, number)


def spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)


def nearest(t: Tree, c: Centroids) -> tuple[np.ndarray, int]:
    """Number of the nearest centroid of every point of ``t`` (ties: the smaller), and how many distances that took.

    Pairs of a node of vectors v and a node of centroids u are refined level by level, all pairs of v together. Every vector
    of v is within d + radius(v) of u's centre, which is a centroid, and no nearer than d - radius(v) - radius(u) to any
    centroid of u; pairs whose least distance exceeds the least such bound of v go. A node of vectors with one centroid
    left takes it as a whole; leaves are compared exactly.
    """
    u = c.tree
    found = np.empty(len(t.points), dtype=np.int64)
    v, w = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    done = 0
    while len(v):
        d = np.sqrt(squared_pairs(t.points[t.center[v]], u.points[u.center[w]]).astype(np.float64))
        done += len(v)
        begin = np.flatnonzero(np.diff(v, prepend=-1))
        least = np.repeat(np.minimum.reduceat(d, begin), np.diff(np.r_[begin, len(v)]))
        keep = d - u.radius[w] <= (least + 2 * t.radius[v]) * (1 + 1e-12) + 1e-6
        v, w = v[keep], w[keep]
        begin = np.flatnonzero(np.diff(v, prepend=-1))
        n = np.diff(np.r_[begin, len(v)])
        node, inner = v[begin], u.kids[w] > 0
        mixed = np.logical_or.reduceat(inner, begin)
        bottom = t.kids[node] == 0
        for i in np.flatnonzero(~mixed & (n == 1)):
            found[t.low[node[i]] : t.high[node[i]]] = c.number[u.center[w[begin[i]]]]
        part = np.repeat(~mixed & (n > 1) & bottom, n)
        if part.any():
            owner, at = spread((t.high - t.low)[v[part]])
            point = t.low[v[part]][owner] + at
            other = u.center[w[part]][owner]
            exact = squared_pairs(t.points[point], u.points[other])
            done += len(point)
            first = np.lexsort((c.number[other], exact, point))
            first = first[np.flatnonzero(np.diff(point[first], prepend=-1))]
            found[point[first]] = c.number[other[first]]
        widest = np.maximum.reduceat(np.where(inner, u.radius[w], -1.0), begin)
        down = mixed & (bottom | (widest >= t.radius[node]))  # refine the centroids' side
        across = ~down & ~bottom & (mixed | (n > 1))  # refine the vectors' side
        a, b = np.repeat(down, n), np.repeat(across, n)
        own, at = spread(np.where(inner[a], u.kids[w[a]], 1))
        side = np.where(inner[a][own], u.child[w[a]][own] + at, w[a][own])
        kid, put = spread(t.kids[v[b]])
        v, w = np.r_[v[a][own], t.child[v[b]][kid] + put], np.r_[side, w[b][kid]]
        by = np.argsort(v, kind="stable")
        v, w = v[by], w[by]
    return found, done
