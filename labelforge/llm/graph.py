"""Connected components of an edge table by alternating star steps, with the
edges of each task contracted to a forest first."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import stage

EDGES_HELD = 4_000_000


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node of each node's component, for nodes 0..n-1."""
    p = np.arange(n)
    while True:
        x, y = p[a], p[b]
        open_ = x != y
        if not open_.any():
            return p
        x, y = x[open_], y[open_]
        np.minimum.at(p, np.maximum(x, y), np.minimum(x, y))
        while True:
            q = p[p]
            if (q == p).all():
                break
            p = q


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for all but the smallest."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    root = nodes[roots(len(nodes), at[:len(a)], at[len(a):])]
    keep = root != nodes
    return nodes[keep], root[keep]


def edge_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a = b = np.zeros(0, np.int64)
    for batch in batches:
        a = np.concatenate((a, np.asarray(batch.column(0))))
        b = np.concatenate((b, np.asarray(batch.column(1))))
        if len(a) > EDGES_HELD:
            a, b = forest(a, b)
            if len(a) > EDGES_HELD // 2:
                yield edge_batch(a, b)
                a = b = np.zeros(0, np.int64)
    if len(a):
        yield edge_batch(*forest(a, b))


def _done(edges: DataFrame) -> bool:
    """Whether (a, b) is what the search ends with: each node points to one
    other, and no node that is pointed to points on."""
    split = edges.groupBy("a").agg(F.count("*").alias("n")).where("n > 1")
    on = edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
    return split.select("a").unionByName(on.select("a")).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b) that is not the
    smallest of its component; component is that smallest node. Repeated edges
    and edges from a node to itself change nothing; no edges give no rows.

    Each node's least neighbour is stored before it is joined to the node's
    edges, so both sides of that join come straight from a shuffle and AQE can
    split the edges of a hub over several tasks."""
    now = stage(edges.select("a", "b").where("a <> b").mapInArrow(_contract, "a long, b long").distinct(), "edges")
    while not _done(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stage(large.where(F.col("a") != F.col("b")), "large")
        low = stage(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            low.select("a", F.col("m").alias("b"))).where(F.col("a") != F.col("b")).distinct()
        now = stage(small.mapInArrow(_contract, "a long, b long").distinct(), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
