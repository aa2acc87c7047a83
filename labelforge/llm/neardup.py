"""Near-duplicate documents by a multi-index Hamming join of b-bit minhash
signatures, confirmed on the full shingle sets.

A signature has some minhashes (symbols) of 16 bits each. Two documents whose
signatures differ in at most ``radius`` symbols must, by the pigeonhole
principle, differ in at most radius // chunks = 1 symbol of some chunk. Each
chunk is therefore indexed once for every place where that one error may be
(the place left out of the key): all pairs within the radius share a key.
The three numbers follow from the similarity threshold (``shape``): a pair at
the threshold is outside the radius with a probability below 2e-4. Index
entries carry 4 bits of each symbol, which can only make a pair look closer,
never farther.

Documents with one shingle set are one class from the start. Rows of a key are
compared on their signatures and only a spanning forest of the pairs within
the radius goes on, so a group of n near copies gives n - 1 rows, not n * n.
The families that these forests connect are then confirmed: all pairs of
members, on full sets, in blocks of bounded size, and again only a forest of
the confirmed links is kept. Its components are the result.

Defined results: a document of fewer than ``words`` words has its whole word
sequence as its one shingle; without words (or null) it has no shingle and is
linked with nothing; rows with a null id are linked with nothing and kept;
repeated rows are copies of each other; empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components, edge_batch, forest
from .stage import small_batches, stage
from .textbytes import (
    LOWER,
    NOT_SPACE,
    flat,
    mix,
    ngram_hash,
    packed,
    prefix_hash,
    slices,
    span_hash,
    unpacked,
    words,
)

PART_BYTES = 12 << 20
ALL_PAIRS = 24
BLOCK_SHINGLES, BLOCK_ROWS = 1 << 20, 2048
COLUMNS = 2048

FEWEST_SYMBOLS, CHUNK_SYMBOLS = 48, 4
MISSED = 2e-4  # most pairs at the threshold that lie outside the radius
LOWEST = 0.7  # threshold; below it signatures get too long for the index


class Shape(NamedTuple):
    """What a signature consists of, and how far a candidate may be."""
    symbols: int
    chunks: int
    radius: int

    @property
    def bounds(self) -> list[int]:
        return np.linspace(0, self.symbols, self.chunks + 1).round().astype(int).tolist()

    @property
    def entry(self) -> np.dtype:
        return np.dtype([("key", "<u8"), ("id", "<i8"), ("sig", "u1", (self.symbols // 2,))])


@lru_cache
def shape(num: int, den: int) -> Shape:
    """The shortest signature for a threshold of num / den: a radius that
    misses fewer than MISSED of the pairs at it, chunks that hold one error
    each, and enough symbols for keys of CHUNK_SYMBOLS - 1 or more."""
    if not LOWEST * den <= num <= den:
        raise ValueError(f"similarity threshold {num}/{den} is not from {LOWEST} to 1")
    p, symbols = 1 - num / den, FEWEST_SYMBOLS
    while True:
        radius, missed = symbols, 0.0
        while radius and missed + (more := comb(symbols, radius) * p ** radius * (1 - p) ** (symbols - radius)) < MISSED:
            radius, missed = radius - 1, missed + more
        chunks = radius // 2 + 1
        if symbols >= CHUNK_SYMBOLS * chunks:
            return Shape(symbols, chunks, radius)
        symbols += 2


SHAPE = shape(85, 100)
SYMBOLS, CHUNKS, RADIUS = SHAPE


@lru_cache
def _hashes(symbols: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    xor = rng.integers(0, 1 << 32, symbols, dtype=np.uint32)
    return xor, rng.integers(0, 1 << 31, (2, symbols), dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes, row after row, and the row offsets."""
    data, offsets = flat(column)
    data = LOWER[data]
    starts, ends, first = words(data, offsets, NOT_SPACE)
    w = span_hash(prefix_hash(data), starts, ends)
    grams = ngram_hash(w, n)
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        sets.append(np.unique(grams[a:b - n + 1]) if b - a >= n else ngram_hash(w[a:b], b - a)[:b > a])
    sizes = np.array([len(s) for s in sets], np.int64)
    return (np.concatenate(sets) if sets else grams[:0]), np.concatenate(([0], np.cumsum(sizes)))


def signatures(shingles: np.ndarray, starts: np.ndarray, symbols: int = SYMBOLS) -> np.ndarray:
    """rows x symbols; no row may be empty."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    xor, mul = _hashes(symbols)
    out = np.empty((len(starts), symbols), "<u2")
    for k in range(symbols):
        y = (x ^ xor[k]) * mul[0, k]
        y ^= y >> np.uint32(15)
        y *= mul[1, k]
        least = np.minimum.reduceat(y, starts).astype(np.uint64)
        out[:, k] = mix(least + np.uint64(k + 1)) >> np.uint64(48)
    return out


def keys(sig: np.ndarray, of: Shape = SHAPE) -> np.ndarray:
    """rows x symbols index keys: one per chunk and left-out place."""
    out = np.empty(sig.shape, np.uint64)
    wide = sig.astype(np.uint64) + np.uint64(1)
    for a, b in zip(of.bounds[:-1], of.bounds[1:]):
        for k in range(a, b):
            h = np.full(len(sig), np.uint64(k + 1))
            for j in range(a, b):
                if j != k:
                    h = mix(h * np.uint64(0x100000001B3) + wide[:, j])
            out[:, k] = h
    return out


def describe(docs: DataFrame, n: int, symbols: int = SYMBOLS) -> DataFrame:
    """doc_id, n_shingles, set_id (hash of the shingle set), sig."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = flat(batch.column(1))
            for a, b in slices(offsets):
                s, at = shingle_sets(batch.column(1).slice(a, b - a), n)
                size = np.diff(at)
                full = np.flatnonzero(size)
                ids, sig = [None] * (b - a), [None] * (b - a)
                if len(full):
                    own = np.add.reduceat(mix(s ^ np.uint64(0xD6E8FEB86659FD93)), at[full])
                    own = mix(own + size[full].astype(np.uint64)).view(np.int64)
                    for r, i, g in zip(full.tolist(), own.tolist(), signatures(s, at[full], symbols)):
                        ids[r], sig[r] = i, g.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(size), pa.array(ids, pa.int64()),
                     pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "set_id", "sig"])

    cols = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cols.mapInArrow(run, "doc_id long, n_shingles long, set_id long, sig binary")


def brief(sig: np.ndarray) -> np.ndarray:
    """Four bits of each symbol, two symbols a byte."""
    low = (sig & np.uint16(15)).astype(np.uint8)
    return low[:, ::2] << np.uint8(4) | low[:, 1::2]


def _index(parts: int, of: Shape):
    """Entries of every key, sorted and packed per key range."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 2048):
                ids = np.asarray(batch.column(0).slice(a, 2048))
                sig = np.frombuffer(b"".join(batch.column(1).slice(a, 2048).to_pylist()), "<u2").reshape(-1, of.symbols)
                rows = np.empty((len(ids), of.symbols), of.entry)
                rows["key"], rows["id"], rows["sig"] = keys(sig, of), ids[:, None], brief(sig)[:, None, :]
                rows = rows.reshape(-1)
                rows = rows[np.argsort(rows["key"])]
                yield packed((rows["key"] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), rows)
    return run


#: Symbols that differ, by the XOR of two bytes.
DIFFER = np.array([(b > 15) + ((b & 15) > 0) for b in range(256)], np.uint8)


def _near(x: np.ndarray, y: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    return DIFFER[x ^ y].sum(-1) <= radius


def _spread(sig: np.ndarray, radius: int) -> tuple[list, list]:
    """Forest of the pairs of one large key that lie within the radius: each
    row reached is compared with the rows not reached yet."""
    a, b = [], []
    left = np.arange(len(sig))
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            row = queue.pop()
            hit = _near(sig[left], sig[row], radius)
            got = left[hit].tolist()
            a += [row] * len(got)
            b += got
            queue += got
            left = left[~hit]
    return a, b


def _within_radius(of: Shape):
    """Forest of the signature pairs within the radius in one key range."""
    def run(table: pa.Table) -> pa.Table:
        rows = unpacked(table.column(1), of.entry)
        order = np.argsort(rows["key"], kind="stable")
        key = rows["key"][order]
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        size = np.diff(new)
        a, b = [], []
        for s in range(2, ALL_PAIRS + 1):
            at = new[:-1][size == s]
            if not len(at):
                continue
            i, j = np.triu_indices(s, 1)
            step = max(1, 200_000 // len(i))
            for c in range(0, len(at), step):
                x = order[(at[c:c + step, None] + i).reshape(-1)]
                y = order[(at[c:c + step, None] + j).reshape(-1)]
                ok = _near(rows["sig"][x], rows["sig"][y], of.radius)
                a.append(x[ok])
                b.append(y[ok])
        for g in np.flatnonzero(size > ALL_PAIRS):
            mine = order[new[g]:new[g + 1]]
            x, y = _spread(rows["sig"][mine], of.radius)
            a.append(mine[np.array(x, np.int64)])
            b.append(mine[np.array(y, np.int64)])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        return pa.Table.from_batches([edge_batch(*forest(rows["id"][a], rows["id"][b]))])
    return run


def _common(sets: list[np.ndarray], left: int) -> np.ndarray:
    """Sizes of the intersections of sets[:left] with all sets."""
    hashes = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(hashes, kind="stable")
    hashes, row = hashes[order], row[order]
    new = np.concatenate(([True], hashes[1:] != hashes[:-1]))
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    column, row = np.unique(column[shared], return_inverse=True)[1], row[shared]
    out = np.zeros((left, len(sets)), np.float32)
    for c in range(0, int(column.max()) + 1 if len(column) else 0, COLUMNS):
        here = (column >= c) & (column < c + COLUMNS)
        x = np.zeros((len(sets), COLUMNS), np.float32)
        x[row[here], column[here] - c] = 1
        out += x[:left] @ x.T
    return out


def _links(sets: list[np.ndarray], left: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Confirmed pairs (i < left, j) with den * common >= num * union."""
    size = np.array([len(s) for s in sets], np.float64)
    if len(sets) <= 6:
        common = np.array([[len(np.intersect1d(x, y, True)) if j > i else 0 for j, y in enumerate(sets)]
                           for i, x in enumerate(sets[:left])], np.float64)
    else:
        common = _common(sets, left).astype(np.float64)
    union = size[:left, None] + size[None, :] - common
    i, j = np.nonzero(den * common >= num * union)
    keep = i < j
    return i[keep], j[keep]


def _confirm(num: int, den: int):
    """Forest of the confirmed links of one task's blocks."""
    def run(table: pa.Table) -> pa.Table:
        family, block = np.asarray(table["family"]), np.asarray(table["block"])
        ids, sets = np.asarray(table["id"]), table["shingles"].to_pylist()
        order = np.lexsort((block, family))
        cuts = np.flatnonzero(np.diff(family[order])) + 1
        a, b = [], []
        for rows in np.split(order, cuts):
            mine = [np.frombuffer(sets[r], np.uint64) for r in rows]
            first = int((block[rows] == block[rows[0]]).sum())
            x, y = _links(mine, first, num, den)
            if first < len(rows):  # two blocks: pairs across them only
                cross = y >= first
                x, y = x[cross], y[cross]
            a.append(ids[rows[x]])
            b.append(ids[rows[y]])
        return pa.Table.from_batches([edge_batch(*forest(np.concatenate(a), np.concatenate(b)))])
    return run


def near_duplicates(docs: DataFrame, words_: int = 5, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept per row. Linked are sets with
    den * common >= num * union; num / den must be LOWEST or more."""
    of = shape(num, den)
    each = stage(describe(docs, words_, of.symbols), "signatures")
    classes = stage(each.where(F.col("set_id").isNotNull() & F.col("doc_id").isNotNull()).groupBy("set_id").agg(
        F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")), "classes")
    n = classes.count()
    parts = max(1, -(-n * of.symbols * of.entry.itemsize // PART_BYTES))
    near = (classes.select("set_id", "sig").mapInArrow(_index(parts, of), "part long, rows binary")
            .groupBy("part").applyInArrow(_within_radius(of), "a long, b long"))
    found = components(near)
    family = stage(found.unionByName(found.select(F.col("component").alias("node"), "component").distinct()).join(
        classes.select(F.col("set_id").alias("node"), "doc_id", "n"), "node"), "families")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = flat(batch.column(3))
            for a, b in slices(offsets):
                s, at = shingle_sets(batch.column(3).slice(a, b - a), words_)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(a, b - a) for k in range(3)),
                     pa.array([s[x:y].tobytes() for x, y in zip(at[:-1], at[1:])], pa.binary())],
                    names=["id", "family", "n", "shingles"])

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    one = family.agg(F.count("*").alias("rows"), F.sum("n").alias("n")).first()
    members = (text.join(family.hint("merge"), "doc_id")  # one plan at every size: texts are shuffled once
               .select(F.col("node").alias("id"), F.col("component").alias("family"), "n", "text")
               .mapInArrow(sets, "id long, family long, n long, shingles binary")
               .where(F.octet_length("shingles") == F.col("n") * 8))
    size = family.groupBy(F.col("component").alias("family")).agg(
        F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_ROWS)).alias("blocks"))
    tasks = max(1, -(-(one["n"] or 0) // BLOCK_SHINGLES))
    block = F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks"))
    work = (members.join(size, "family").withColumn("block", block)
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
            .withColumn("task", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("family"), F.lit(tasks)))
                        .otherwise(F.xxhash64("family", F.least("block", "other"), F.greatest("block", "other")))))
    links = work.groupBy("task").applyInArrow(_confirm(num, den), "a long, b long")
    joined = components(links)
    label = (classes.select("set_id", "doc_id").join(joined, F.col("set_id") == F.col("node"), "left")
             .select("set_id", "doc_id", F.coalesce("component", "set_id").alias("group")))
    least = label.groupBy("group").agg(F.min("doc_id").alias("least"))
    label = label.join(least, "group").select("set_id", F.col("least").alias("component_id"))
    out = each.select("doc_id", "n_shingles", "set_id").join(label, "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
