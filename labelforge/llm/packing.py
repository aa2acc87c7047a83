"""Best-fit packing by exact-complement hashing.

Documents are tokenised, ended by a separator and, where longer than a
sequence, cut into full pieces behind a shorter first one. All that packing
needs is how many pieces there are of each length, at most ``size`` numbers
whatever the corpus. From that histogram the driver makes a plan of patterns
(lists of lengths, each with a repeat count): the longest length left takes
the single length, else the pair, else the triple of lengths that exactly
fills its gap, as often as the counts allow; where nothing fills it exactly,
the longest length that fits goes in and the smaller gap is tried again.
Pieces then find their place by their rank among the pieces of their length:
the rank is a running number inside a scan partition plus a prefix sum of
per-partition counts, so no length, however common, meets in one task.

Defined results: null text counts as empty and gives one piece that holds the
separator only; null ids pass through; repeated rows are packed as often as
they come; empty input gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stage import small_batches, stage
from .textbytes import flat, slices
from .tokencount import byte_letters

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value


@lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    """The byte-level BPE of a vocabulary file; its ids are its merge ranks."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte_of = {c: b for b, c in byte_letters().items()}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks,
                             special_tokens={t["content"]: t["id"] for t in spec["added_tokens"]})


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) pieces of n tokens: full ones behind a shorter first."""
    first = n % size if n > size and n % size else min(n, size)
    return [(0, first)] + [(s, size) for s in range(first, n, size)]


def pieces(docs: DataFrame, path: str, size: int, separator: int) -> DataFrame:
    """One row per piece, with the scan partition (``part``) and the piece's
    running number (``nth``) among those of its length there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        part, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            _, offsets = flat(batch.column(1))
            for a, b in slices(offsets, 2 << 20):
                rows = []
                for doc, text in zip(batch.column(0).slice(a, b - a).to_pylist(),
                                     batch.column(1).slice(a, b - a).to_pylist()):
                    ids = np.array(enc.encode(text or "", allowed_special="all") + [separator], "<u4")
                    for k, (start, length) in enumerate(cut(len(ids), size)):
                        crc = zlib.crc32(ids[start:start + length].tobytes())
                        rows.append((doc, k, start, length, crc, part, seen[length]))
                        seen[length] += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), TYPES)], names=NAMES)

    cols = small_batches(docs).select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return cols.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, "
                                "part int, nth long")


NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]


def _exact(counts: np.ndarray, gap: int) -> tuple[int, ...] | None:
    """The single, else pair, else triple of available lengths that adds up to
    ``gap`` exactly, the one with the longest parts first."""
    if counts[gap]:
        return (gap,)
    have = counts > 0
    for a in (0, *np.flatnonzero(have[:max(gap - 1, 0)])[::-1]):
        rest = gap - int(a)
        half, top = -(-rest // 2), min(rest - 1, int(a) or rest)
        both = have[half:top + 1] & have[rest - top:rest - half + 1][::-1]
        for b in np.flatnonzero(both)[::-1] + half:
            parts = (int(a), int(b), rest - int(b))[0 if a else 1:]
            if all(counts[p] >= n for p, n in Counter(parts).items()):
                return parts
    return None


def plan(histogram: dict[int, int], size: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths, repeats) that use up the histogram exactly."""
    counts = np.zeros(size + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    out: list[tuple[list[int], int]] = []
    while True:
        have = np.flatnonzero(counts)
        if not len(have):
            return out
        pattern = [int(have[-1])]
        gap = size - pattern[0]
        held = counts.copy()
        held[pattern[0]] -= 1
        while gap:
            left = np.flatnonzero(held[:gap + 1])
            if not len(left):
                break
            parts = _exact(held, gap) or (int(left[-1]),)
            for p in parts:
                held[p] -= 1
            pattern += parts
            gap -= sum(parts)
        need = Counter(pattern)
        repeats = int(min(counts[p] // n for p, n in need.items()))
        for p, n in need.items():
            counts[p] -= n * repeats
        out.append((pattern, repeats))


def slots(patterns: list[tuple[list[int], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: a piece of
    that length takes the sequence by its rank from there on."""
    used: Counter = Counter()
    rows, sequence = [], 0
    for lengths, repeats in patterns:
        offset = 0
        for p in lengths:
            rows.append((p, used[p], sequence, offset))
            used[p] += repeats
            offset += p
        sequence += repeats
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(docs: DataFrame, path: str, size: int = 2048, separator: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = stage(pieces(docs, path, size, separator), "pieces")
    per = rows.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = docs.sparkSession.sparkContext.broadcast(slots(plan(counts, size)))  # by `size` alone bounded
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1))
    base = per.select("part", "length", F.coalesce(before, F.lit(0)).alias("base"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        keys = t[:, 0] << 48 | t[:, 1]
        for batch in batches:
            length, rank = np.asarray(batch.column(3)), np.asarray(batch.column(5))
            at = np.searchsorted(keys, length << 48 | rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(t[at, 2] + rank - t[at, 1]), pa.array(t[at, 3])],
                names=[*NAMES[:5], "sequence_id", "offset"])

    ranked = rows.join(base, ["part", "length"]).select(
        *NAMES[:5], (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, "
                                    "sequence_id long, offset long")
