"""Exact top-k by inner product over KD-trees, one tree per shard.

A shard is a bounded run of rows of one scan partition. Its tree splits at
the median of the widest side until a leaf is small; every node keeps the
tight box of its points. For a query q no point of a box scores more than
sum(max(q*low, q*high)), so nodes are visited best bound first and a branch
is left as soon as its bound is under the k-th score that the task has found
so far; that score is carried from shard to shard. Each task returns at most
k rows per query, and one grouped pass over those keeps the best k.

Queries are handled in blocks of ``QUERY_BLOCK``; one block is what is
broadcast at a time, whatever the size of the query set.

Defined results: vectors that are null, hold a null or a non-finite component
or have no component take no part, as query or candidate; a vector is compared
with vectors of its own length only; ties go to the smaller id; the row with
the query's own id is no candidate; rows with a null id take no part; repeated
rows count as they come; empty tables give no rows; other columns are ignored.
Scores must fit a long.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEAF = 64
SHARD_ROWS = 16384
QUERY_BLOCK = 4096
EXACT = float(2 ** 53)  # below this, sums of integers in doubles are exact


class Tree:
    """Median-split KD-tree over integer rows, held as flat node arrays."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF):
        order = np.lexsort((ids,))
        spans, kids, todo = [(0, len(ids))], [(-1, -1)], [0]
        while todo:
            node = todo.pop()
            a, b = spans[node]
            part = points[order[a:b]]
            side = part.max(0) - part.min(0)
            axis = int(side.argmax())
            if b - a <= leaf or side[axis] == 0:
                continue
            mid = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(part[:, axis], mid, kind="introselect")]
            kids[node] = (len(spans), len(spans) + 1)
            spans += [(a, a + mid), (a + mid, b)]
            kids += [(-1, -1), (-1, -1)]
            todo += kids[node]
        self.ids, self.points = ids[order], points[order]
        self.spans, self.kids = spans, kids
        starts = [self.points[a:b] for a, b in spans]
        self.low = np.array([p.min(0) for p in starts])
        self.high = np.array([p.max(0) for p in starts])
        self.first = np.array([self.ids[a:b].min() for a, b in spans])

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Per query and node, the most that a point of the box can score."""
        return _dot(np.maximum(queries, 0), self.high) + _dot(np.minimum(queries, 0), self.low)

    def search(self, qid: int, query: np.ndarray, bound: np.ndarray, k: int,
               best: list[tuple[int, int]]) -> None:
        """Merge this tree's rows into ``best``, a heap of (score, -id) with
        the worst kept row on top."""
        todo = [(-int(bound[0]), 0)]
        while todo:
            most, node = heapq.heappop(todo)
            if len(best) == k:
                score, worst = best[0]
                if -most < score:
                    return
                if -most == score and self.first[node] > -worst:
                    continue
            left, right = self.kids[node]
            if left >= 0:
                heapq.heappush(todo, (-int(bound[left]), left))
                heapq.heappush(todo, (-int(bound[right]), right))
                continue
            a, b = self.spans[node]
            scores, ids = _dot(query[None], self.points[a:b])[0], self.ids[a:b]
            rows = np.flatnonzero(ids != qid)
            if len(best) == k:
                rows = rows[scores[rows] >= best[0][0]]
            if len(rows) > k:
                rows = rows[np.lexsort((ids[rows], -scores[rows]))[:k]]
            for r in rows:
                item = (int(scores[r]), -int(ids[r]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products of rows, by BLAS where doubles hold them exactly."""
    if len(a) and len(b) and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def usable(rows: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, vec) with integer components floor(scale * x), x as double."""
    x = F.col("vec")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return (rows.select(F.col(id_col).cast("long").alias("id"),
                        F.col(vec_col).cast("array<double>").alias("vec"))
            .where(F.col("id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~bad)
            .select("id", F.transform(x, lambda v: F.floor(v * F.lit(float(scale)))).alias("vec")))


def _shards(batches: Iterator[pa.RecordBatch]):
    """Per vector length, runs of at most SHARD_ROWS rows as numpy arrays."""
    held: dict[int, list] = {}
    for batch in batches:
        ids = np.asarray(batch.column(0))
        vec = batch.column(1)
        flat = np.asarray(vec.flatten(), dtype=np.int64)
        sizes = np.asarray(pa.compute.list_value_length(vec))
        ends = np.cumsum(sizes)
        for dim in np.unique(sizes):
            rows = np.flatnonzero(sizes == dim)
            at = (ends[rows] - dim)[:, None] + np.arange(dim)
            kept = held.setdefault(int(dim), [])
            kept.append((ids[rows], flat[at]))
            while sum(len(i) for i, _ in kept) >= SHARD_ROWS:
                i, p = np.concatenate([x for x, _ in kept]), np.concatenate([x for _, x in kept])
                yield i[:SHARD_ROWS], p[:SHARD_ROWS]
                kept[:] = [(i[SHARD_ROWS:], p[SHARD_ROWS:])]
    for kept in held.values():
        i, p = np.concatenate([x for x, _ in kept]), np.concatenate([x for _, x in kept])
        if len(i):
            yield i, p


def _searcher(block, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, qvecs = block.value
        best: list[list[tuple[int, int]]] = [[] for _ in qids]
        by_dim: dict[int, np.ndarray] = {}
        for dim in {len(v) for v in qvecs}:
            by_dim[dim] = np.array([i for i, v in enumerate(qvecs) if len(v) == dim])
        for ids, points in _shards(batches):
            mine = by_dim.get(points.shape[1])
            if mine is None:
                continue
            tree = Tree(ids, points)
            for a in range(0, len(mine), 256):
                part = mine[a:a + 256]
                queries = np.array([qvecs[i] for i in part], dtype=np.int64)
                bounds = tree.bounds(queries)
                for row, i in enumerate(part):
                    tree.search(int(qids[i]), queries[row], bounds[row], k, best[i])
        out = [(int(qids[i]), -neg, score) for i, heap in enumerate(best) for score, neg in heap]
        q, v, s = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()),
                                          pa.array(s, pa.int64())],
                                         names=["query_id", "vec_id", "score"])
    return run


def top_k(spark: SparkSession, rows: DataFrame, is_query, id_col: str = "vec_id",
          vec_col: str = "embedding", k: int = 10, scale: int = 1024) -> DataFrame:
    """For each row where ``is_query`` (a condition on column ``id``) holds,
    the k rows with the highest integer inner product: query_id, rank, vec_id,
    score."""
    base = usable(rows, id_col, vec_col, scale)
    queries = base.where(is_query)
    marks = queries.agg(F.count("*").alias("n"), F.min("id"), F.max("id")).first()
    blocks = max(1, -(-marks["n"] // QUERY_BLOCK))
    found = None
    for b in range(blocks):
        part = queries if blocks == 1 else queries.where(
            F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)
        got = part.collect()  # one bounded block of the query set
        block = spark.sparkContext.broadcast((np.array([r["id"] for r in got], dtype=np.int64),
                                              [r["vec"] for r in got]))
        hits = base.mapInArrow(_searcher(block, k), "query_id long, vec_id long, score long")
        found = hits if found is None else found.unionByName(hits)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (found.withColumn("rank", rank).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
