"""Exact top-k inner products by dual-tree search over cover trees."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Points of one cover tree; queries of one group; trees that one task searches in turn.
TREE_ROWS, QUERY_ROWS, TREES_PER_TASK = 2048, 8192, 4
LEAF_ROWS, BASE = 256, 1.3
#: Children of fewer points are pooled into leaves.
LEAST_CHILD = 32
#: Score of a free slot; real scores are above it.
FREE = -(2**62)


class Node:
    __slots__ = ("center", "norm", "radius", "points", "children")

    def __init__(self, x, center, points, radius):
        self.center, self.norm, self.points, self.radius, self.children = x[center], float(np.linalg.norm(x[center])), points, radius, []


def build_cover_tree(x: np.ndarray) -> Node:
    """Cover tree of the rows of ``x``.

    The children of a node are centres farther apart than the covering radius of the next level
    (this node's radius divided by ``BASE``), each with the points nearest to it.  Children of fewer
    than ``LEAST_CHILD`` points, which many dimensions make of most points, are pooled in order of
    their centres into leaves of up to ``LEAF_ROWS`` points, so that a pair of leaves is worth one
    matrix product.
    """

    def grow(points: np.ndarray, center: int) -> Node:
        d = np.sqrt(((x[points] - x[center]) ** 2).sum(1))
        node = Node(x, center, points, float(d.max(initial=0.0)))
        if len(points) <= LEAF_ROWS or node.radius == 0:
            return node
        reach, owner, centers = node.radius / BASE, np.zeros(len(points), np.int64), [center]
        while d.max() > reach and len(centers) < len(points):
            far = int(points[d.argmax()])
            new = np.sqrt(((x[points] - x[far]) ** 2).sum(1))
            closer = new < d
            owner[closer], d = len(centers), np.where(closer, new, d)
            centers.append(far)
        if len(centers) == 1:
            return node
        sizes = np.bincount(owner, minlength=len(centers))
        small = sizes[owner] < LEAST_CHILD
        node.children = [grow(points[owner == k], c) for k, c in enumerate(centers) if sizes[k] >= LEAST_CHILD]
        pooled = points[small][np.argsort(owner[small], kind="stable")]
        if not node.children and len(pooled) <= LEAF_ROWS:
            return node
        for at in range(0, len(pooled), LEAF_ROWS):
            part = pooled[at : at + LEAF_ROWS]
            leaf = Node(x, int(part[0]), part, float(np.sqrt(((x[part] - x[part[0]]) ** 2).sum(1)).max()))
            node.children.append(leaf)
        return node

    return grow(np.arange(len(x)), int(((x - x.mean(0)) ** 2).sum(1).argmin()))


class TopK:
    """Best ``k`` (score, id) of each query: higher scores first, ties to the smaller id.

    ``scores`` and ``ids`` have a row per query; free slots score below every candidate.
    """

    def __init__(self, q: np.ndarray, qid: np.ndarray, k: int):
        self.q, self.qid, self.k = q, qid, k
        self.scores = np.full((len(q), k), FREE, np.int64)
        self.ids = np.full((len(q), k), np.iinfo(np.int64).max)
        self.worst = np.full(len(q), -np.inf)
        self.largest = np.abs(q).max(initial=0)

    def offer(self, qi: np.ndarray, x: np.ndarray, ids: np.ndarray) -> None:
        most = self.largest * np.abs(x).max(initial=0) * max(1, x.shape[1])
        if most >= 2.0**62:
            raise OverflowError("scores of these vectors can exceed 62 bits")
        exact = most < 2.0**53
        s = (self.q[qi] @ x.T).astype(np.int64) if exact else self.q[qi].astype(np.int64) @ x.T.astype(np.int64)
        s[self.qid[qi][:, None] == ids[None, :]] = FREE
        better = s.max(1) >= self.worst[qi]
        if not better.any():
            return
        qi, s = qi[better], s[better]
        s = np.concatenate([self.scores[qi], s], 1)
        i = np.concatenate([self.ids[qi], np.where(s[:, self.k :] == FREE, np.iinfo(np.int64).max, ids)], 1)
        order = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.scores[qi], self.ids[qi] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        last = self.scores[qi, -1]
        self.worst[qi] = np.where(last == FREE, -np.inf, last)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query ids, candidate ids and scores of the filled slots."""
        a, b = np.nonzero(self.scores != FREE)
        return self.qid[a], self.ids[a, b], self.scores[a, b]

    def search(self, qnode: Node, rnode: Node, x: np.ndarray, ids: np.ndarray) -> None:
        """Descends pairs of nodes, best bound first; a pair goes if its bound is under the group's worst kth score."""
        stack = [(self.bound(qnode, rnode), qnode, rnode)]
        while stack:
            bound, a, b = stack.pop()
            if bound < self.worst[a.points].min():
                continue
            if not a.children and not b.children:
                self.offer(a.points, x[b.points], ids[b.points])
                continue
            if b.children and (not a.children or b.radius >= a.radius):
                below = [(self.bound(a, c), a, c) for c in b.children]
            else:
                below = [(self.bound(c, b), c, b) for c in a.children]
            stack += sorted(below, key=lambda p: p[0])

    @staticmethod
    def bound(a: Node, b: Node) -> float:
        """No point pair of the two nodes has a greater inner product (a little above, for rounding)."""
        best = float(a.center @ b.center) + a.radius * b.norm + b.radius * a.norm + a.radius * b.radius
        return best + 1e-6 * (1 + abs(best))


def top_k(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, every: int = 20, scale: float = 64.0) -> DataFrame:
    """The ``k`` highest integer inner products of each query: ``query_id, rank, vec_id, score``.

    Components become ``floor(scale * x)``.  Queries are the rows whose id is divisible by ``every``;
    candidates are all rows of another id.  Queries and candidates are dealt by a hash of the id to
    groups of bounded size; each (query group, candidate group) pair is searched by itself, carrying
    the worst kth scores from tree to tree, and passes on at most ``k`` rows per query, whose best
    ``k`` are the result.

    Null vectors, vectors that hold null or non-finite components, and rows of null id take no part;
    vectors of different lengths are not compared; rows that agree in id and vector count once, rows
    of the query's own id never count.  Fewer than ``k`` candidates give fewer rows; empty tables
    give an empty result; scores that may exceed 62 bits raise an error; other columns are not read.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    rows = rows.select("id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"), F.size("v").alias("dim")).distinct()
    total = rows.count()
    nq, nb = max(1, -(-total // (every * QUERY_ROWS))), max(1, -(-total // (TREE_ROWS * TREES_PER_TASK)))
    queries = rows.where(F.pmod("id", F.lit(every)) == 0).select("id", "v", "dim", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(nq)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(nb - 1))).alias("cb"))
    data = rows.select("id", "v", "dim", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("qb"), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(nb)).cast("int").alias("cb"))

    def search(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        q, c = q.sort_values("id"), c.sort_values("id")
        qx, x, qid, ids = np.stack(q.v.to_list()), np.stack(c.v.to_list()), q.id.to_numpy(), c.id.to_numpy()
        best, qtree = TopK(qx, qid, k), build_cover_tree(qx)
        for at in range(0, len(x), TREE_ROWS):
            part = slice(at, at + TREE_ROWS)
            best.search(qtree, build_cover_tree(x[part]), x[part], ids[part])
        query, found, score = best.rows()
        return pd.DataFrame({"query_id": query, "vec_id": found, "score": score})

    keys = ["dim", "qb", "cb"]
    found = queries.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
