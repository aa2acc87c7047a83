"""Benchmark decontamination by winnowing.

A window is ``span`` consecutive words of a benchmark item (the whole item if
it has fewer). Of the k-gram hashes in each run of ``span - k + 1`` positions
the smallest is a fingerprint, on both sides, so any shared span of ``span``
words shares a fingerprint. Document fingerprints are looked up among those of
the benchmark; each hit names a diagonal (document word against item word),
which is extended over equal words, and runs of a window's length or more are
hits. Items shorter than a window are looked up by the hash of the whole item.

The benchmark index is broadcast in blocks of about ``BLOCK_BYTES`` of item
text, cut by a hash of text and id, so that also the items of one text, however
many, are spread over the blocks; inside a block equal texts are one entry. A
larger benchmark takes more passes over the same rows, with no shuffle in any of
them; after every ``PASSES_HELD`` of them the rows are stored, so a task never
holds more indexes than that.

Defined results: words are digits, letters a-z (A-Z lower-cased) and non-ASCII
characters; null or empty texts have no words; items with a null id or without
words take no part; an item id that occurs in several rows counts once;
repeated documents and null ids are kept as they come; empty tables give no
hits or no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .stage import small_batches, stage
from .textbytes import ALNUM, LOWER, flat, ngram_hash, prefix_hash, slices, span_hash, words

GRAM = 5
BLOCK_BYTES = 16 << 20
PASSES_HELD = 4
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _word_hashes(column: pa.Array):
    data, offsets = flat(column)
    data = LOWER[data]
    starts, ends, first = words(data, offsets, ALNUM)
    return span_hash(prefix_hash(data), starts, ends), first


def _slide(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over every run of w values."""
    out = x[:len(x) - w + 1].copy()
    for k in range(1, w):
        op(out, x[k:k + len(out)], out=out)
    return out


def fingerprints(hashes: np.ndarray, first: np.ndarray, k: int, w: int):
    """(position, hash) of the smallest k-gram of every run of w, ties
    included; positions are word indexes. Runs stay inside a row."""
    grams = ngram_hash(hashes, k)
    if not len(grams):
        return np.zeros(0, np.int64), grams
    row = np.searchsorted(first, np.arange(len(grams)), "right") - 1
    inside = np.arange(len(grams)) + k <= first[row + 1]
    grams = np.where(inside, grams, TOP)
    padded = np.concatenate((np.full(w - 1, TOP), grams, np.full(w - 1, TOP)))
    least = _slide(padded, w, np.minimum)
    # A gram is a minimum of some full run iff the largest of its runs' minima equals it.
    full = np.zeros(len(least), bool)
    size = len(grams)
    at = np.arange(size)
    end = at + w - 1  # run at..end of grams lies inside one row
    ok = (end < size) & inside & inside[np.minimum(end, size - 1)]
    ok &= row == row[np.minimum(end, size - 1)]
    full[w - 1:w - 1 + size] = ok
    most = _slide(np.where(full, least, 0), w, np.maximum)
    pick = np.flatnonzero(inside & (most == grams))
    return pick, grams[pick]


class Index:
    """Fingerprints of a block of benchmark items, one entry per text."""

    def __init__(self, items: list[tuple[int, str]], span: int):
        by_text: dict[str, set[int]] = {}
        for i, t in items:
            by_text.setdefault(t, set()).add(i)
        hashes, first = _word_hashes(pa.array(list(by_text), pa.string()))
        self.ids = list(by_text.values())
        self.words = [hashes[first[i]:first[i + 1]] for i in range(len(self.ids))]
        self.need = np.minimum(np.diff(first), span)
        self.schemes = []
        for need in np.unique(self.need[self.need > 0]):
            k, w = (GRAM, span - GRAM + 1) if need == span else (int(need), 1)
            rows = np.flatnonzero(self.need == need)
            part = np.concatenate([self.words[r] for r in rows])
            begin = np.concatenate(([0], np.cumsum([len(self.words[r]) for r in rows])))
            at, h = fingerprints(part, begin, k, w)
            owner = np.searchsorted(begin, at, "right") - 1
            order = np.argsort(h, kind="stable")
            self.schemes.append((k, w, h[order], rows[owner][order], (at - begin[owner])[order]))

    def hits(self, hashes: np.ndarray, first: np.ndarray):
        """{row: (spans, item indexes)} of the rows that share a window."""
        found: dict[int, tuple[list, set]] = {}
        for k, w, keys, items, places in self.schemes:
            at, h = fingerprints(hashes, first, k, w)
            lo, hi = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
            n = hi - lo
            if not n.any():
                continue
            which = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            at = np.repeat(at, n)
            row = np.searchsorted(first, at, "right") - 1
            lines = np.unique(np.stack((row, items[which], at - places[which])), axis=1)
            for r, item, shift in lines.T.tolist():
                mine, need = self.words[item], int(self.need[item])
                a, b = max(first[r], shift), min(first[r + 1], shift + len(mine))
                same = hashes[a:b] == mine[a - shift:b - shift]
                edge = np.flatnonzero(np.diff(np.concatenate(([False], same, [False]))))
                runs = edge.reshape(-1, 2)
                runs = runs[runs[:, 1] - runs[:, 0] >= need]
                if len(runs):
                    spans, which_items = found.setdefault(r, ([], set()))
                    spans += map(tuple, (runs + a - first[r]).tolist())
                    which_items.add(item)
        return found


def merge(spans: list) -> list[tuple[int, int]]:
    """Sorted, disjoint spans that cover the same words."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


STATE = StructType([
    StructField("n_words", LongType()),
    StructField("spans", ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))),
    StructField("item_ids", ArrayType(LongType()))])
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _pass(index):
    """Add the hits of one block of the benchmark to the last three columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idx = index.value
        for batch in batches:
            names = batch.schema.names
            at = names.index("text")
            _, offsets = flat(batch.column(at))
            for a, b in slices(offsets):
                part = batch.slice(a, b - a)
                hashes, first = _word_hashes(part.column(at))
                found = idx.hits(hashes, first)
                *rest, _, spans, items = part.columns
                if found:
                    spans, items = spans.to_pylist(), items.to_pylist()
                    for r, (more, which) in found.items():
                        old = [(s["start"], s["end"]) for s in spans[r]]
                        spans[r] = [{"start": x, "end": y} for x, y in merge(old + more)]
                        items[r] = sorted(set(items[r]).union(*(idx.ids[i] for i in which)))
                    spans, items = pa.array(spans, SPANS), pa.array(items, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*rest, pa.array(np.diff(first)), spans, items], names=names)
    return run


def find_overlaps(docs: DataFrame, benchmark: DataFrame, span: int = 10,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of ``docs`` with n_words, spans (disjoint word ranges inside
    a window's occurrence) and item_ids (sorted, of the items with such
    windows); columns of these names are replaced."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"),
                             F.col("text").cast("string").alias("text")).where(
        F.col("item_id").isNotNull() & F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    out = small_batches(docs).drop(*STATE.names)
    out = out.select("*", F.lit(0).cast("long").alias("n_words"),
                     F.array().cast(STATE["spans"].dataType).alias("spans"),
                     F.array().cast(STATE["item_ids"].dataType).alias("item_ids"))
    schema = StructType([*docs.drop(*STATE.names).schema.fields, *STATE.fields])
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(blocks)) == b)
        index = Index([(r["item_id"], r["text"]) for r in part.collect()], span)  # a bounded block
        if b and b % PASSES_HELD == 0:
            out = stage(out, "overlaps")
        out = out.mapInArrow(_pass(docs.sparkSession.sparkContext.broadcast(index)), schema)
    return out
