"""Hard negatives by bounds along spanning trees of the anchors.

Scores are integer inner products. If an anchor c hangs on an anchor p at a
distance d, a row x scores with c what it scores with p, plus or minus d times
the norm of x. So the anchors are cut into compact groups (``_compact``), each
is joined by its minimum spanning tree (``spanning_tree``), and a task walks a
tree from the root: there it scores all rows of a shard, at every other anchor
it starts from the parent's bounds, widens them by the edge, and rescores only
rows whose bounds reach what it looks for. A rescored row has tight bounds again
for the anchors below.

Two rounds per block of anchors. The first looks for the ``positives`` best rows
of the anchor's own label; the least score that can still matter rises with each
row found. The second knows the positives' scores, and so the window of scores
around each that makes a negative hard, and rescores rows of other labels whose
bounds overlap a window above the last negative kept for it.

Blocks of at most about ``BLOCK_ANCHORS`` anchors are broadcast one after the
other, whatever their number, and each block's rows are written before the next
one starts; a shard is a bounded run of rows of a scan partition, held for one
pass. A task returns the best few rows per anchor; one grouped pass keeps the
best of all tasks.

Defined results: rows with a null id, label or vector, an empty vector, or a
null or non-finite component take no part; vectors are compared with vectors of
their own length only; ties go to the smaller id; a row with the anchor's own id
is neither its positive nor its negative; of several anchor rows with one id the
first by label, then vector, is the anchor; other rows that repeat count as they
come; anchors without a positive give no rows, nor do positives without a
negative in their window (a negative positive score leaves the window empty);
empty tables give no rows; other columns are ignored. Scores must fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .stage import stage

TREE_ANCHORS = 256
BLOCK_ANCHORS = 4096
SHARD_ROWS = 4096
EXACT = float(2 ** 53)  # below this, sums of integers in doubles are exact
WIDER = 1 + 1e-9  # more than rounding can take off a bound

ROWS = "id long, label long, vec array<bigint>"


def usable(rows: DataFrame, id_col: str, vec_col: str, label: Column, scale: int) -> DataFrame:
    """(id, label, vec) with integer components floor(scale * x)."""
    v = F.col("vec")
    whole = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"),
                        F.col(vec_col).cast("array<double>").alias("vec"))
            .where(F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & whole)
            .select("id", "label", F.transform(v, lambda x: F.floor(x * F.lit(float(scale)))).alias("vec")))


def _by_length(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, points) of up to ``most`` rows with vectors of one length."""
    held: dict[int, list] = {}
    for batch in batches:
        ids, labels, vec = np.asarray(batch.column(0)), np.asarray(batch.column(1)), batch.column(2)
        values = np.asarray(vec.flatten(), dtype=np.int64)
        sizes = np.asarray(pc.list_value_length(vec), dtype=np.int64)
        begin = np.cumsum(sizes) - sizes
        for length in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == length)
            kept = held.setdefault(length, [])
            kept.append((ids[rows], labels[rows], values[begin[rows][:, None] + np.arange(length)]))
            while sum(len(k[0]) for k in kept) >= most:
                whole = [np.concatenate(x) for x in zip(*kept)]
                yield tuple(x[:most] for x in whole)
                kept[:] = [tuple(x[most:] for x in whole)]
    for kept in held.values():
        whole = tuple(np.concatenate(x) for x in zip(*kept))
        if len(whole[0]):
            yield whole


def _compact(points: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Rows in groups of at most ``most``, by median splits of the widest side."""
    todo = [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            yield rows
            continue
        part = points[rows]
        axis = int((part.max(0).astype(float) - part.min(0)).argmax())
        order = np.argsort(part[:, axis], kind="stable")
        todo += [rows[order[:len(rows) // 2]], rows[order[len(rows) // 2:]]]


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in an order that has parents first, and for each place of that order
    the parent's place (-1: the root) and the length of the edge to it, rounded
    up. Prim's way, from the row nearest to the middle."""
    x = points.astype(np.float64)
    root = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    order, parent, edge = [root], [-1], [0.0]
    near = ((x - x[root]) ** 2).sum(1)
    via = np.zeros(len(x), np.int64)  # place of the nearest row of the tree
    out = np.ones(len(x), bool)
    out[root] = False
    for place in range(1, len(x)):
        rows = np.flatnonzero(out)
        row = int(rows[near[rows].argmin()])
        order.append(row)
        parent.append(int(via[row]))
        edge.append(float(np.sqrt(near[row])) * WIDER)
        out[row] = False
        far = ((x - x[row]) ** 2).sum(1)
        closer = far < near
        near[closer], via[closer] = far[closer], place
    return np.array(order), np.array(parent), np.array(edge)


TREE = ("length long, anchors long, ids binary, labels binary, points binary, parents binary, edges binary")


def _plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per spanning tree of the anchors."""
    for ids, labels, points in _by_length(batches, BLOCK_ANCHORS):
        for rows in _compact(points, TREE_ANCHORS):
            order, parent, edge = spanning_tree(points[rows])
            rows = rows[order]
            yield pa.RecordBatch.from_arrays(
                [pa.array([points.shape[1]]), pa.array([len(rows)])]
                + [pa.array([x.tobytes()], pa.binary()) for x in (ids[rows], labels[rows], points[rows], parent, edge)],
                names=["length", "anchors", "ids", "labels", "points", "parents", "edges"])


class Tree:
    def __init__(self, row, first: int):
        self.first = first  # number of its first anchor in the block
        self.ids, self.labels, self.parents = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels", "parents"))
        self.points = np.frombuffer(row["points"], np.int64).reshape(len(self.ids), -1)
        self.edges = np.frombuffer(row["edges"], np.float64)
        self.last_child = np.arange(len(self.ids))
        for place, parent in enumerate(self.parents.tolist()):
            if parent >= 0:
                self.last_child[parent] = place


class Shard:
    """Some rows, and how they score."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, points: np.ndarray):
        self.ids, self.labels, self.points = ids, labels, points
        self.real = points.astype(np.float64)
        self.norms = np.sqrt((self.real ** 2).sum(1)) * WIDER
        self.most = float(np.abs(self.real).max())

    def scores(self, anchor: np.ndarray, rows=slice(None)) -> np.ndarray:
        if self.most * float(np.abs(anchor).max()) * len(anchor) < EXACT:
            return (self.real[rows] @ anchor.astype(np.float64)).astype(np.int64)
        return self.points[rows] @ anchor

    def walk(self, tree: Tree, wanted, found) -> None:
        """Visit the anchors of a tree. ``wanted(anchor number, label, id, low,
        high, shard)`` names the rows whose score counts, ``found(anchor number,
        rows, scores)`` gets them."""
        bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for place, parent in enumerate(tree.parents.tolist()):
            number, anchor = tree.first + place, tree.points[place]
            if parent < 0:
                scores = self.scores(anchor)
                low = high = scores.astype(np.float64)
                rows = wanted(number, tree.labels[place], tree.ids[place], low, high, self)
                scores = scores[rows]
            else:
                low, high = bounds[parent]
                reach = self.norms * tree.edges[place] + (1 + 1e-12 * self.most * float(np.abs(anchor).sum()))
                low, high = low - reach, high + reach
                rows = wanted(number, tree.labels[place], tree.ids[place], low, high, self)
                scores = self.scores(anchor, rows)
                low[rows] = high[rows] = scores
                if tree.last_child[parent] == place:
                    del bounds[parent]
            if tree.last_child[place] > place:
                bounds[place] = low, high
            found(number, rows, scores)


def _kth(values: np.ndarray, k: int) -> float:
    """The k-th largest, or minus infinity."""
    return float(-np.partition(-values, k - 1)[k - 1]) if len(values) >= k else -np.inf


def _merge(best: tuple, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple:
    scores, ids = np.concatenate((best[0], scores)), np.concatenate((best[1], ids))
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


NONE = (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _positives(trees, k: int):
    """Per task and anchor the best k rows of its label."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}

        def wanted(number, label, own, low, high, shard):
            rows = shard.of_label.get(int(label), NONE[0])
            rows = rows[shard.ids[rows] != own]
            known = best.get(number, NONE)[0]
            least = max(float(known[-1]) if len(known) == k else -np.inf, _kth(low[rows], k))
            return rows[high[rows] >= least]

        def found(number, rows, scores):
            if len(rows):
                best[number] = _merge(best.get(number, NONE), scores, shard.ids[rows], k)

        for ids, labels, points in _by_length(batches, SHARD_ROWS):
            shard = Shard(ids, labels, points)
            order = np.argsort(labels, kind="stable")
            cuts = np.flatnonzero(np.diff(labels[order])) + 1
            shard.of_label = {int(labels[p[0]]): p for p in np.split(order, cuts)}
            for tree in trees.value:
                if tree.points.shape[1] == points.shape[1]:
                    shard.walk(tree, wanted, found)
        yield _columns([(n, i, s) for n, b in best.items() for s, i in zip(*b)], ["anchor", "id", "score"])
    return run


def _negatives(trees, windows, k: int):
    """Per task, anchor and positive the best k rows of another label with a
    score in the positive's window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], tuple] = {}

        def wanted(number, label, own, low, high, shard):
            mine = windows.value.get(number, ())
            if not mine:
                return NONE[0]
            rows = np.flatnonzero((high >= min(w[1] for w in mine)) & (low <= max(w[2] for w in mine)))
            rows = rows[(shard.labels[rows] != label) & (shard.ids[rows] != own)]
            low, high = low[rows], high[rows]
            take = np.zeros(len(rows), bool)
            for place, least, most in mine:
                known = best.get((number, place), NONE)[0]
                inside = low[(low >= least) & (high <= most)]  # these are negatives, whatever their score
                floor = max(least, float(known[-1]) if len(known) == k else -np.inf, _kth(inside, k))
                take |= (high >= floor) & (low <= most)
            return rows[take]

        def found(number, rows, scores):
            for place, least, most in windows.value.get(number, ()):
                hit = (scores >= least) & (scores <= most)
                if hit.any():
                    key = (number, place)
                    best[key] = _merge(best.get(key, NONE), scores[hit], shard.ids[rows[hit]], k)

        for ids, labels, points in _by_length(batches, SHARD_ROWS):
            shard = Shard(ids, labels, points)
            for tree in trees.value:
                if tree.points.shape[1] == points.shape[1]:
                    shard.walk(tree, wanted, found)
        yield _columns([(n, p, i, s) for (n, p), b in best.items() for s, i in zip(*b)],
                       ["anchor", "place", "id", "score"])
    return run


def _columns(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def _first(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(planted: DataFrame) -> Iterator[list[Tree]]:
    """The trees in blocks of BLOCK_ANCHORS anchors or a few more, one block on
    the driver at a time."""
    trees: list[Tree] = []
    for row in planted.toLocalIterator():
        first = trees[-1].first + len(trees[-1].ids) if trees else 0
        trees.append(Tree(row, first))
        if first + row["anchors"] >= BLOCK_ANCHORS:
            yield trees
            trees = []
    if trees:
        yield trees


RESULT = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def mine(spark: SparkSession, rows: DataFrame, is_anchor: Column, id_col: str = "vec_id",
         vec_col: str = "embedding", label: Column | None = None, positives: int = 5, negatives: int = 10,
         least: int = 30, most: int = 90, scale: int = 256) -> DataFrame:
    """For each row where ``is_anchor`` (a condition on column ``id``) holds
    and each of its best ``positives`` rows of the same label, the best
    ``negatives`` rows of another label that score ``least`` to ``most`` percent
    of the positive."""
    base = stage(usable(rows, id_col, vec_col, F.col("label") if label is None else label, scale), "vectors")
    first = F.min(F.struct("label", "vec")).alias("first")
    anchors = base.where(is_anchor).groupBy("id").agg(first).select("id", "first.label", "first.vec")
    groups = max(1, -(-anchors.count() // BLOCK_ANCHORS))
    planted = stage(anchors.repartitionByRange(groups, F.size("vec"), "label", "id").mapInArrow(_plant, TREE), "trees")
    path = scratch_path(spark, "hard-negatives")
    spark.createDataFrame([], RESULT).write.parquet(path)
    for trees in _blocks(planted):
        block = spark.sparkContext.broadcast(trees)
        ids = np.concatenate([t.ids for t in trees]).tolist()
        best = _first(base.mapInArrow(_positives(block, positives), "anchor long, id long, score long"),
                      ["anchor"], positives).collect()  # at most ``positives`` rows an anchor of the block
        windows: dict[int, list] = {}
        for r in best:
            low, high = -(-least * r["score"] // 100), most * r["score"] // 100
            if low <= high:
                windows.setdefault(r["anchor"], []).append((r["rank"], low, high))
        bounds = spark.sparkContext.broadcast(windows)
        known = spark.createDataFrame(
            [(r["anchor"], ids[r["anchor"]], r["rank"], r["id"], r["score"]) for r in best],
            "anchor long, anchor_id long, place long, positive_id long, positive_score long")
        found = _first(base.mapInArrow(_negatives(block, bounds, negatives),
                                       "anchor long, place long, id long, score long"), ["anchor", "place"], negatives)
        (found.join(known, ["anchor", "place"])
         .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
                 F.col("score").alias("negative_score"))
         .write.mode("append").parquet(path))
        block.destroy()
        bounds.destroy()
    return spark.read.schema(RESULT).parquet(path)
