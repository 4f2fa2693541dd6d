"""Approximate nearest neighbours by vantage-point trees, one a shard.

Vectors are scaled to unit length, where the euclidean distance orders like the
cosine.  Distinct rows are dealt to shards by a hash of id and vector, so
neither equal nor near vectors nor a repeated id crowd a shard.  A shard's rows
come to its task first and become one tree, built once; then the queries stream
through it.  A node has a vantage point and the median distance to it; the near
half lies inside.  A query first goes to the leaf that is nearest all the way
down, then through the tree: always to the nearer side, to the other only if the
triangle inequality leaves room there for something nearer than its k-th best so
far, whose distance is multiplied by ``factor``: 1 gives exact search, less
prunes more.  All queries of a slice go through a tree together.

Scores are cosines in double precision, computed where a leaf holds something
that may be among the best; ties go to the smaller id, exactly: vectors that
differ by a power of two only have equal scores and are one point of the tree,
with its k + 1 least ids.  A query's k best in each shard are merged by a window
over shards * k rows.

Vectors that are null, zero, or hold null or non-finite components take no
part, nor do rows without an id.  Equal rows (id and vector) count once; a
repeated id with several vectors is as many rows, each a query of its own and a
candidate of the others.  Shards grow in number with the table, so a tree's
size is bounded; every query visits every shard, as a shard is a random part of
the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, materialize

#: Rows a shard, points a leaf.
SHARD, LEAF = 16_384, 64
#: Share of the k-th distance that must fit for a branch to be searched.
FACTOR = 0.8
#: Room for rounding in the pruning test, and in scores before they are computed exactly.
EPS, NEARLY = 1e-6, 1e-9


@dataclass
class Node:
    lo: int
    hi: int
    point: np.ndarray | None = None
    radius: float = 0.0
    inside: Node | None = None
    outside: Node | None = None


class VpTree:
    """A tree over rows of one length; ``order`` permutes points so that a node is a range.  ``compared`` counts the distances that were computed."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, seed: int = 1):
        by_id = np.argsort(ids, kind="stable")
        scaled, exponents = scale(vectors[by_id])
        _, first, point_of = np.unique(as_bytes(scaled), return_index=True, return_inverse=True)
        self.k, self.scaled = k, scaled[first]
        self.unit = self.scaled / np.sqrt((self.scaled * self.scaled).sum(axis=1, keepdims=True))
        # the k + 1 least ids of each point (by_id is sorted, and the sort below stable)
        rows = np.argsort(point_of, kind="stable")
        starts = np.searchsorted(point_of[rows], np.arange(len(first)))
        self.held = np.minimum(np.diff(np.append(starts, len(rows))), k + 1)
        self.start, self.ids, self.exponents = starts, ids[by_id][rows], exponents[rows]
        self.order = np.arange(len(first))
        self.rng = np.random.default_rng(seed)
        self.compared = 0
        self.root = self._build(0, len(first))
        self.rows = self.unit[self.order]  # leaves are contiguous

    def _build(self, lo: int, hi: int) -> Node:
        if hi - lo <= LEAF:
            return Node(lo, hi)
        own = self.order[lo:hi]
        point = self.unit[own[self.rng.integers(len(own))]]
        d = distances(self.unit[own], point[None])[:, 0]
        half = len(own) // 2
        part = np.argpartition(d, half)
        self.order[lo:hi] = own[part]
        return Node(lo, hi, point, float(d[part[half]]), self._build(lo, lo + half), self._build(lo + half, hi))

    def search(self, ids: np.ndarray, vectors: np.ndarray, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the k nearest found of each query (a row is not its own neighbour), best first; missing ones have score -inf."""
        k = self.k
        scaled, exponents = scale(vectors)
        unit = scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
        best = np.full((len(ids), k), -np.inf)
        found = np.full((len(ids), k), np.iinfo(np.int64).max)

        def leaf(node: Node, q: np.ndarray) -> None:
            if not len(q):
                return
            near = unit[q] @ self.rows[node.lo : node.hi].T
            self.compared += near.size
            least = best[q, -1]
            if near.shape[1] > k + 1:
                least = np.maximum(least, np.partition(near, -(k + 1), axis=1)[:, -(k + 1)])
            at, col = np.nonzero(near >= least[:, None] - NEARLY)
            if not len(at):
                return
            at, point = q[at], self.order[node.lo + col]
            score = cosines(scaled[at], self.scaled[point])
            times = self.held[point]
            row = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(self.start[point], times)
            own = np.repeat((scaled[at] == self.scaled[point]).all(axis=1), times) & (self.ids[row] == np.repeat(ids[at], times)) & (self.exponents[row] == np.repeat(exponents[at], times))
            at, score, row = np.repeat(at, times)[~own], np.repeat(score, times)[~own], row[~own]
            met = np.unique(at)
            who = np.concatenate([np.repeat(met, k), at])
            scores, names = np.concatenate([best[met].ravel(), score]), np.concatenate([found[met].ravel(), self.ids[row]])
            order = np.lexsort((names, -scores, who))
            rank = np.arange(len(order)) - np.searchsorted(who[order], who[order])
            top = order[rank < k]
            best[met], found[met] = scores[top].reshape(-1, k), names[top].reshape(-1, k)

        home = np.full(len(ids), -1)

        def gaps(node: Node, q: np.ndarray) -> np.ndarray:
            self.compared += len(q)
            return distances(unit[q], node.point[None])[:, 0] - node.radius

        def descend(node: Node, q: np.ndarray) -> None:
            """Each query to the leaf that is always nearer, for a first bound."""
            if not len(q):
                return
            if node.point is None:
                home[q] = node.lo
                leaf(node, q)
                return
            near = gaps(node, q) < 0
            descend(node.inside, q[near])
            descend(node.outside, q[~near])

        def visit(node: Node, q: np.ndarray) -> None:
            """All leaves but the first that may hold something nearer, each once for all queries that get there."""
            if not len(q):
                return
            if node.point is None:
                leaf(node, q[home[q] != node.lo])
                return
            gap = gaps(node, q)
            for side, nearer in ((node.inside, gap < 0), (node.outside, gap >= 0)):
                reach = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * best[q, -1])) * factor + EPS
                visit(side, q[nearer | (np.abs(gap) <= reach)])

        everyone = np.arange(len(ids))
        descend(self.root, everyone)
        visit(self.root, everyone)
        return best, found


def scale(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors times a power of two each, so that the largest component lies in [0.5, 1), and the exponents; cosines stay the same to the last bit, and no square overflows."""
    exponents = np.frexp(np.abs(vectors).max(axis=1))[1]
    return np.ldexp(vectors, -exponents[:, None]) + 0.0, exponents


def as_bytes(vectors: np.ndarray) -> np.ndarray:
    """One value a row, equal for equal rows."""
    flat = np.ascontiguousarray(vectors)
    return flat.view(np.dtype((np.void, flat.itemsize * flat.shape[1]))).reshape(-1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of unit vectors."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows, in double precision, summed component by component: the same bits wherever a row stands, and as a plain loop gives."""

    def dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for k in range(x.shape[1]):
            total += x[:, k] * y[:, k]
        return total

    return dot(a, b) / (np.sqrt(dot(a, a)) * np.sqrt(dot(b, b)))


def usable(vector: str) -> Column:
    v = F.col(vector)
    good = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & good & F.exists(v, lambda x: x != 0)


def by_width(batch: pa.RecordBatch, vector: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors of each length that occurs; vectors of different lengths can't be compared."""
    column = batch.column(batch.schema.get_field_index(vector))
    widths = np.diff(column.offsets.to_numpy())
    for width in np.unique(widths):
        same = np.flatnonzero(widths == width)
        yield same, column.take(pa.array(same)).flatten().to_numpy().reshape(-1, width)


def nearest(rows: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", factor: float = FACTOR) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row for which queries (a condition on the id column) holds, itself excepted."""
    own = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), queries.alias("is_query")).where(F.col("id").isNotNull() & usable("v"))
    own = materialize(own.dropDuplicates(["id", "v"]), "vectors")
    shards = max(1, -(-own.count() // SHARD))
    base = own.select(F.pmod(F.xxhash64(F.lit(3), "id", "v"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("q"), "id", "v")
    asks = own.where("is_query").select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("q"), "id", "v")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, trees = None, [], None
        for batch in batches:
            place = batch.column(0).to_numpy() * 2 + batch.column(1).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(place[1:] != place[:-1]) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(lo, hi - lo)
                now, asking = divmod(int(place[lo]), 2)
                if now != shard:
                    shard, held, trees = now, [], None
                if not asking:
                    held.append(part)
                    continue
                if trees is None:
                    trees = {}
                    if held:
                        data = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                        ids = data.column(2).to_numpy()
                        trees = {v.shape[1]: VpTree(ids[at], v, k) for at, v in by_width(data, "v")}
                    held = []
                ids = part.column(2).to_numpy()
                for at, v in by_width(part, "v"):
                    if v.shape[1] not in trees:
                        continue
                    score, found = trees[v.shape[1]].search(ids[at], v, factor)
                    who, col = np.nonzero(score > -np.inf)
                    key = [int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "little", signed=True) for x in v]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at][who]), pa.array(np.array(key, np.int64)[who]), pa.array(found[who, col]), pa.array(score[who, col])], ["query_id", "query_row", "vec_id", "score"])

    dealt = base.unionByName(asks).repartition("shard").sortWithinPartitions("shard", "q")
    found = map_batches(dealt, kernel, "query_id long, query_row long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
