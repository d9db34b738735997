"""Exact top-k inner products by dual-tree search over cover trees.

Vectors are made integer (floor of 1024 times each component). Data and queries are dealt into blocks by a hash of their id, and every block of
queries meets every block of data: that is the work that an exact search over all rows has, in tasks of bounded size. In a task both
sides are indexed by cover trees: a node has a centre and a covering radius, its children cover it with half the radius. A pair of nodes is
dropped if no product between them can reach the worst k-th score of the query node's queries:
``<q, p> <= <cq, cp> + |cq| rp + |cp| rq + rq rp``. Blocks return k candidates per query, which are ranked once more.

Defined cases: a null id, a null vector or one with null or non-finite components takes no part; rows that share an id count once, with their
smallest vector; vectors of different length do not meet; scores beyond 64 bits are clipped to them; ties go to the smaller id; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import written

SCALE = 1024
LEAF = 24
DATA_ROWS, QUERY_ROWS = 16_384, 2_048
LEAST_BLOCKS = 32
_LOW = np.iinfo(np.int64).min


class Tree:
    """A cover tree; the points below a node are a range of ``order``."""

    def __init__(self, points: np.ndarray):
        self.points, self.order = points, np.arange(len(points))
        self.centre, self.radius, self.range, self.children = [], [], [], []
        start = int(np.argmin(((points - points.mean(axis=0)) ** 2).sum(axis=1)))
        self._node(0, len(points), start)
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)
        self.norm = np.sqrt((self.centre ** 2).sum(axis=1))

    def _node(self, lo: int, hi: int, centre: int) -> int:
        """Points order[lo:hi] around the point ``centre``. Works from a list, as copies of a vector make deep chains."""
        todo, first = [(lo, hi, centre, -1)], len(self.radius)
        while todo:
            lo, hi, centre, parent = todo.pop()
            members, number = self.order[lo:hi], len(self.radius)
            far = np.sqrt(((self.points[members] - self.points[centre]) ** 2).sum(axis=1))
            self.centre.append(self.points[centre])
            self.radius.append(float(far.max()))
            self.range.append((lo, hi))
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(number)
            if hi - lo <= LEAF or far.max() == 0:
                continue
            # Children have half the radius; the centre is the first of them, then any point that is not covered yet.
            reach, left, groups, pick = far.max() / 2, members, [], centre
            while len(left):
                near = ((self.points[left] - self.points[pick]) ** 2).sum(axis=1) <= reach * reach
                groups.append((pick, left[near]))
                left = left[~near]
                pick = int(left[0]) if len(left) else -1
            at = lo
            for pick, group in groups:
                self.order[at:at + len(group)] = group
                todo.append((at, at + len(group), pick, number))
                at += len(group)
        return first


class Search:
    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int):
        self.q, self.qid, self.p, self.pid, self.k = queries, query_ids, data, data_ids, k
        top = max(np.abs(queries).max(initial=0), 1) * max(np.abs(data).max(initial=0), 1) * max(queries.shape[1], 1)
        self.exact = float if top < 2 ** 53 else object
        self.scores = np.full((len(queries), k), _LOW, np.int64)
        self.ids = np.full((len(queries), k), np.iinfo(np.int64).max, np.int64)
        self.floor = np.full(len(queries), -np.inf)

    def products(self, rows: np.ndarray, points: np.ndarray) -> np.ndarray:
        """Integer products, own rows lowest."""
        a, b = self.q[rows], self.p[points]
        if self.exact is float:
            made = (a @ b.T).astype(np.int64)
        else:
            whole = np.array([[int(x) for x in r] for r in a], object) @ np.array([[int(x) for x in r] for r in b], object).T
            made = np.array([[min(max(x, _LOW + 1), 2 ** 63 - 1) for x in r] for r in whole], np.int64).reshape(len(a), len(b))
        made[self.qid[rows][:, None] == self.pid[points][None, :]] = _LOW
        return made

    def take(self, rows: np.ndarray, points: np.ndarray) -> None:
        made = self.products(rows, points)
        ids = np.where(made == _LOW, np.iinfo(np.int64).max, np.broadcast_to(self.pid[points], made.shape))
        scores, ids = np.concatenate([self.scores[rows], made], axis=1), np.concatenate([self.ids[rows], ids], axis=1)
        best = np.lexsort((ids, ~scores), axis=1)[:, : self.k]  # ~x falls as x rises and never overflows
        self.scores[rows], self.ids[rows] = np.take_along_axis(scores, best, 1), np.take_along_axis(ids, best, 1)
        worst = self.scores[rows, -1]
        self.floor[rows] = np.maximum(self.floor[rows], np.where(worst == _LOW, -np.inf, worst.astype(float)))

    def bounds(self, qn: int, dn: np.ndarray) -> np.ndarray:
        rq, rd = self.qt.radius[qn], self.dt.radius[dn]
        made = self.dt.centre[dn] @ self.qt.centre[qn] + self.qt.norm[qn] * rd + self.dt.norm[dn] * rq + rq * rd
        return made + 1 + 1e-9 * (np.abs(made) + (self.qt.norm[qn] + rq) * (self.dt.norm[dn] + rd))

    def rows(self, qn: int) -> np.ndarray:
        lo, hi = self.qt.range[qn]
        return self.qt.order[lo:hi]

    def run(self) -> None:
        if not len(self.q) or not len(self.p):
            return
        self.qt, self.dt = Tree(self.q), Tree(self.p)
        if len(self.p) > 2 * self.k:
            # Scores with a few points give every query a floor before any pair of nodes is looked at.
            some = np.unique(np.linspace(0, len(self.p) - 1, 8 * self.k).astype(int))
            seen = np.sort(self.products(np.arange(len(self.q)), some), axis=1)
            if seen.shape[1] >= self.k:
                low = seen[:, -self.k]
                self.floor = np.where(low == _LOW, -np.inf, low.astype(float))
        todo = [(0, np.array([0]))]
        while todo:
            qn, dn = todo.pop()
            dn = dn[self.bounds(qn, dn) >= self.floor[self.rows(qn)].min()]
            if not len(dn):
                continue
            if not self.qt.children[qn]:
                self.leaf(qn, dn)
                continue
            wide = self.qt.radius[qn] / 2
            lower = [c for n in dn for c in (self.dt.children[n] if self.dt.children[n] and self.dt.radius[n] > wide else [n])]
            todo += [(child, np.array(lower)) for child in self.qt.children[qn]]

    def leaf(self, qn: int, dn: np.ndarray) -> None:
        """Best pairs first: once the best bound is below the group's worst k-th score, the rest is pruned."""
        rows = self.rows(qn)
        heap = [(-b, int(n)) for b, n in zip(self.bounds(qn, dn), dn)]
        heapq.heapify(heap)
        points: list[np.ndarray] = []
        while heap:
            bound, n = heapq.heappop(heap)
            if -bound < self.floor[rows].min():
                break
            if self.dt.children[n]:
                kids = np.array(self.dt.children[n])
                for b, c in zip(self.bounds(qn, kids), kids):
                    heapq.heappush(heap, (-b, int(c)))
            else:
                lo, hi = self.dt.range[n]
                points.append(self.dt.order[lo:hi])
                if sum(map(len, points)) >= 128:
                    self.take(rows, np.concatenate(points))
                    points = []
        if points:
            self.take(rows, np.concatenate(points))


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and v, the integer components as doubles, one row per id."""
    # floor() of a double is a long; beyond its range the double is a whole number already.
    whole = F.transform("embedding", lambda c: F.when(F.abs(c.cast("double")) < 2.0 ** 52, F.floor(c.cast("double") * SCALE).cast("double")).otherwise(c.cast("double") * SCALE))
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.where(F.coalesce(usable, F.lit(False))).select("vec_id", whole.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def top_products(queries: DataFrame, data: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer products of each query with rows of other ids. Both sides have vec_id and v."""
    n_data, n_queries = data.count(), queries.count()
    data_blocks = max(LEAST_BLOCKS, math.ceil(n_data / DATA_ROWS))
    query_blocks = max(1, math.ceil(n_queries / QUERY_ROWS))

    def block(n: int):
        return F.pmod(F.xxhash64(F.lit(5), "vec_id"), F.lit(n))

    side = data.select("vec_id", "v", F.lit(False).alias("asks"), block(data_blocks).alias("db"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(query_blocks - 1).cast("bigint"))).alias("qb"))
    asked = queries.select("vec_id", "v", F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(data_blocks - 1).cast("bigint"))).alias("db"), block(query_blocks).alias("qb"))

    def search(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        ids = table.column("vec_id").to_numpy()
        values = table.column("v").combine_chunks()
        flat = np.asarray(values.flatten(), dtype=float).reshape(len(ids), -1) if len(ids) else np.zeros((0, 0))
        found = Search(flat[asks], ids[asks], flat[~asks], ids[~asks], k)
        found.run()
        rows, cols = np.nonzero(found.scores != _LOW)
        return pa.table({"query_id": ids[asks][rows], "vec_id": found.ids[rows, cols], "score": found.scores[rows, cols]})

    near = side.unionByName(asked).groupBy(F.size("v").alias("dims"), "db", "qb").applyInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def self_top_products(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """The rows whose id is divisible by ``every`` as queries against all rows."""
    data = written(integer_vectors(vectors), "int-vectors")
    return top_products(data.where(F.col("vec_id") % every == 0), data, k)
