"""Exact top-k search by inner product (operator 4): KD-trees per shard.

Vectors become integer vectors, floor(scale * x). They are dealt into shards
of bounded size; a task builds each shard's KD-tree - median splits along the
widest side, a tight bounding box per node, leaves in one block of memory -
and the trees are written as a table, one row per shard. Queries are packed
into blocks. A block meets a shard by an equi-join on the block number, so
every query meets every shard exactly once, in blocks, and the search inside
a pair is a best-first traversal: nodes are opened by the largest inner
product their box allows, and the traversal ends when no open box can reach
the query's kth score. That kth score is propagated: a first round against
one shard per block gives every query a lower bound, which starts the second
round against all shards, and a task passes it on from shard to shard.

Defined cases: vectors that are null, empty or hold null or non-finite
components take no part, neither do rows without an id; rows that share an id
are rows of their own, candidates each, and what queries of one id find is
ranked together; vectors meet only those of their own length; ties go to the smaller id; scores must fit a long. Empty tables
give an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

SHARD_ROWS = 8192
BLOCK_ROWS = 512
LEAF_ROWS = 64
_PACKED = "dim int, ids binary, points binary, floor binary"


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v): integer vectors of the rows that take part."""
    v = F.col(vector_col)
    fine = F.size(v).cast("int") > 0
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    ints = F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    return (df.where(F.col(id_col).isNotNull() & v.isNotNull() & fine & finite)
            .select(F.col(id_col).cast("long").alias("id"), ints.alias("v")))


def _packed(frames: Iterator[pd.DataFrame], rows: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(dim, ids, points, floor) of at most ``rows`` vectors of one length."""
    held: dict[int, list] = {}
    for f in frames:
        floors = f["floor"] if "floor" in f else [None] * len(f)
        for i, v, low in zip(f["id"], f["v"], floors):
            part = held.setdefault(len(v), [])
            part.append((i, v, np.iinfo(np.int64).min if low is None or low != low else int(low)))
            if len(part) == rows:
                yield _arrays(held.pop(len(v)))
    for part in held.values():
        yield _arrays(part)


def _arrays(part):
    return (len(part[0][1]), np.array([p[0] for p in part], np.int64),
            np.array([p[1] for p in part], np.int64).reshape(len(part), -1), np.array([p[2] for p in part], np.int64))


class Tree:
    """Balanced tree in heap order: node n covers rows [start[n], stop[n]),
    its children are 2n + 1 and 2n + 2. It can be rebuilt from the ordered
    points alone."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, ordered: bool = False):
        depth = max(0, math.ceil(math.log2(max(1, len(ids) / LEAF_ROWS))))
        self.leaves = 1 << depth
        order = np.arange(len(ids))
        self.start, self.stop = np.zeros(2 * self.leaves - 1, np.int64), np.zeros(2 * self.leaves - 1, np.int64)
        self.stop[0] = len(ids)
        for n in range(self.leaves - 1):
            a, b = self.start[n], self.stop[n]
            mid = (a + b) // 2
            if not ordered and b - a > 1:
                part = points[order[a:b]]
                axis = (part.max(axis=0) - part.min(axis=0)).argmax()
                order[a:b] = order[a:b][np.argpartition(part[:, axis], mid - a)]
            self.start[2 * n + 1], self.stop[2 * n + 1] = a, mid
            self.start[2 * n + 2], self.stop[2 * n + 2] = mid, b
        self.ids, self.points = ids[order], points[order]
        # tight boxes, leaves first; an empty node keeps an impossible box
        self.low = np.full((len(self.start), points.shape[1]), np.iinfo(np.int64).max)
        self.high = np.full((len(self.start), points.shape[1]), np.iinfo(np.int64).min)
        for n in range(len(self.start) - 1, -1, -1):
            if self.stop[n] > self.start[n]:
                if n >= self.leaves - 1:
                    part = self.points[self.start[n]:self.stop[n]]
                    self.low[n], self.high[n] = part.min(axis=0), part.max(axis=0)
                else:
                    kids = slice(2 * n + 1, 2 * n + 3)
                    self.low[n], self.high[n] = self.low[kids].min(axis=0), self.high[kids].max(axis=0)

    def search(self, query_ids, queries, floors, k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """Per query (row, ids, scores) of its best rows with a score of at
        least its floor; raises the floors to the kth scores found."""
        filled = self.stop > self.start
        reach = max(int(np.abs(self.points).max(initial=0)), 1) * max(int(np.abs(queries).max(initial=0)), 1)
        kind = np.float64 if reach * queries.shape[1] < 1 << 52 else np.int64  # exact either way
        points, q = self.points.astype(kind), queries.astype(kind)
        low, high = (np.where(filled[:, None], x, 0).astype(kind) for x in (self.low, self.high))
        bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
        out = []
        for row in range(len(q)):
            bound = bounds[row].tolist()
            ids, scores = np.empty(0, np.int64), np.empty(0, np.int64)
            floor = int(floors[row])
            open_ = [(-bound[0], 0)] if filled[0] else []
            while open_ and -open_[0][0] >= floor:
                n = heapq.heappop(open_)[1]
                if n < self.leaves - 1:
                    for kid in (2 * n + 1, 2 * n + 2):
                        if filled[kid] and bound[kid] >= floor:
                            heapq.heappush(open_, (-bound[kid], kid))
                    continue
                a, b = self.start[n], self.stop[n]
                found = (points[a:b] @ q[row]).astype(np.int64)
                near = np.flatnonzero((found >= floor) & (self.ids[a:b] != query_ids[row]))
                if len(near):
                    ids = np.concatenate((ids, self.ids[a:b][near]))
                    scores = np.concatenate((scores, found[near]))
                    best = np.lexsort((ids, -scores))[:k]
                    ids, scores = ids[best], scores[best]
                    if len(ids) == k:
                        floor = max(floor, int(scores[-1]))
            floors[row] = floor
            if len(ids):
                out.append((row, ids, scores))
        return out


def build_trees(vectors: DataFrame) -> tuple[DataFrame, int]:
    """One row per shard: (shard, dim, ids, points), points in tree order."""
    n = vectors.count()
    parts = max(1, math.ceil(n / SHARD_ROWS))

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for dim, ids, points, _ in _packed(frames, SHARD_ROWS):
            tree = Tree(ids, points)
            yield pd.DataFrame([(dim, tree.ids.tobytes(), tree.points.tobytes(), b"")],
                               columns=["dim", "ids", "points", "floor"])

    packed = vectors.repartition(parts, "id", "v").mapInPandas(build, _PACKED).drop("floor")
    return _numbered(packed, "shard", "trees")


def _numbered(packed: DataFrame, name: str, label: str) -> tuple[DataFrame, int]:
    """Number the rows 0, 1, ... in a written table: the rows are few (one per
    thousands of vectors) and only their hashes are ordered."""
    table = stage(packed.withColumn("_key", F.expr("uuid()")), label)
    order = table.select("_key", (F.row_number().over(Window.orderBy("_key")) - 1).alias(name))
    numbered = table.join(stage(order, f"{label}-order"), "_key").drop("_key")
    return numbered, table.count()


def query_blocks(queries: DataFrame) -> tuple[DataFrame, int]:
    """One row per block: (block, dim, ids, points, floor); the floor column
    of ``queries``, if any, holds lower bounds of their kth scores."""
    parts = max(1, math.ceil(queries.count() / BLOCK_ROWS))

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for dim, ids, points, floors in _packed(frames, BLOCK_ROWS):
            yield pd.DataFrame([(dim, ids.tobytes(), points.tobytes(), floors.tobytes())],
                               columns=["dim", "ids", "points", "floor"])

    return _numbered(queries.repartition(parts, "id", "v").mapInPandas(pack, _PACKED), "block", "queries")


def _search(pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score) found in (block, shard) pairs."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        floors: dict[int, np.ndarray] = {}  # passed on from shard to shard
        for f in frames:
            for r in f.itertuples():
                ids, queries = np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.q_points, np.int64).reshape(-1, r.dim)
                if r.block not in floors:
                    floors = {r.block: np.frombuffer(r.q_floor, np.int64).copy()}
                tree = Tree(np.frombuffer(r.ids, np.int64), np.frombuffer(r.points, np.int64).reshape(-1, r.dim), ordered=True)
                hits = tree.search(ids, queries, floors[r.block], k)
                if hits:
                    yield pd.DataFrame({"query_id": np.concatenate([np.full(len(i), ids[row]) for row, i, _ in hits]),
                                        "vec_id": np.concatenate([i for _, i, _ in hits]),
                                        "score": np.concatenate([s for _, _, s in hits])})

    return (pairs.sortWithinPartitions("block")
            .select("block", "dim", "ids", "points", "q_ids", "q_points", "q_floor")
            .mapInPandas(run, "query_id long, vec_id long, score long"))


def _meet(trees: DataFrame, blocks: DataFrame, n_blocks: int, only: Column | None = None) -> DataFrame:
    sent = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    sent = sent if only is None else sent.where(only)
    few = blocks.select("block", F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"),
                        F.col("points").alias("q_points"), F.col("floor").alias("q_floor"))
    return sent.join(few, "block").where("dim = q_dim")


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """For every row of ``queries`` its ``k`` rows of ``vectors`` with the
    largest inner product, other than the row of its own id: (query_id, rank,
    vec_id, score). Both tables are (id, v) as ``integer_vectors`` gives them."""
    spark = vectors.sparkSession
    trees, n_trees = build_trees(vectors)
    queries = stage(queries, "query-vectors")
    blocks, n_blocks = query_blocks(queries)
    if not n_trees or not n_blocks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    first = _search(_meet(trees, blocks, n_blocks, F.col("shard") == F.col("block") % n_trees), k)
    floors = (first.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("n"), F.min("score").alias("floor"))
              .where(F.col("n") >= k).drop("n"))
    blocks, n_blocks = query_blocks(queries.join(floors, "id", "left"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (_search(_meet(trees, blocks, n_blocks), k).withColumn("rank", F.row_number().over(best))
            .where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
