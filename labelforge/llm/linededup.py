"""Line dedup over sharded minimal perfect hashes.

A line's key is the line without ASCII white space at its ends, A-Z in lower
case; keys of ``min_chars`` characters or more count. A key is known by 96 bits,
a 64-bit hash and a 32-bit fingerprint. One grouped pass gives each distinct key
the number of documents that hold it and the largest of their ids.

The keys are dealt to shards by their hash. A shard becomes one row: a minimal
perfect hash (``PerfectHash``: levels of bit arrays, a key lies on the first
level where no other key shares its bit, its number is the rank of that bit) and
three arrays at those numbers: fingerprints, document counts, largest ids. That
is some 16 bytes a key, and no key is stored.

Documents then ask, they do not join lines: each line goes as (document, place,
hash, fingerprint) to its shard, which looks all of them up in its arrays and
answers with the places to drop. A shard that is asked often, because of a line
that a third of all documents hold, is copied, and its questions are dealt over
the copies, so a task holds a bounded number of them. The rows that move are
linear in the lines.

Defined results: null and empty texts are one empty line; a document is a
doc_id, so rows with one id count once for a key, and all of them keep the lines
that are kept there; rows without an id take no part and stay whole; a key that
stands several times in one document is dropped or kept there throughout; an
empty table gives no rows; other columns come back as they are, those named
``n_lines``, ``n_dropped`` or ``kept`` are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import stage
from .textbytes import BASE, mix

MIN_CHARS, MIN_DOCS = 20, 3
SHARD_LINES = 1 << 14  # lines a shard, also questions a task
BITS_A_KEY = 2  # of a level
LEVELS = 64

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class PerfectHash:
    """Numbers 0..n-1 for n distinct (hash, fingerprint) pairs. ``sizes`` are
    the levels' bits, multiples of 64, ``words`` the bits of all levels."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.first = np.cumsum(sizes) - sizes
        ones = np.bitwise_count(words).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    @staticmethod
    def _bit(level: int, size: int, hashes: np.ndarray, marks: np.ndarray) -> np.ndarray:
        turn = np.uint64((level + 1) * int(BASE) & (1 << 64) - 1)
        return (mix(hashes + mix(marks.astype(np.uint64) + turn)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, hashes: np.ndarray, marks: np.ndarray) -> "PerfectHash":
        left, sizes, words = np.arange(len(hashes)), [], []
        while len(left):
            if len(sizes) == LEVELS:
                raise ValueError("keys are not distinct")
            size = -(-BITS_A_KEY * len(left) // 64) * 64
            bit = cls._bit(len(sizes), size, hashes[left], marks[left])
            taken = np.bincount(bit, minlength=size)
            words.append(np.packbits(taken == 1, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[taken[bit] != 1]
        return cls(np.array(sizes, np.int64), np.concatenate(words) if words else np.zeros(0, "<u8"))

    def number(self, hashes: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """A key's own number; for other keys any number, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        left = np.arange(len(hashes))
        for level, size in enumerate(self.sizes.tolist()):
            bit = self._bit(level, size, hashes[left], marks[left]) + self.first[level]
            word, at = bit >> 6, (bit & 63).astype(np.uint64)
            hit = (self.words[word] >> at & np.uint64(1)).astype(bool)
            below = self.words[word] & ((np.uint64(1) << at) - np.uint64(1))
            out[left[hit]] = (self.before[word] + np.bitwise_count(below))[hit]
            left = left[~hit]
            if not len(left):
                break
        return out


def lines_of(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row per line whose key counts: id, tie (of the text), place, hash,
    mark."""
    line = F.btrim(F.col("line"), F.lit(SPACE))
    return (docs.where(F.col("id").isNotNull())
            .select("id", "tie", F.posexplode(F.split("text", "\n", -1)).alias("place", "line"))
            .select("id", "tie", "place", line.alias("line"))
            .where(F.char_length("line") >= min_chars)
            .select("id", "tie", "place", F.translate("line", UPPER, LOWER).alias("key"))
            .select("id", "tie", "place", F.xxhash64("key").alias("hash"), F.hash("key").alias("mark")))


INDEX = ("shard long, asked long, sizes binary, words binary, marks binary, documents binary, last binary")


def _index(table: pa.Table) -> pa.Table:
    """The row of one shard, from the rows (shard, hash, mark, documents, last,
    asked) of its keys."""
    shard, hashes, marks, documents, last, asked = (c.to_numpy() for c in table.columns)
    hashes, marks = hashes.view(np.uint64), marks.view(np.uint32)
    built = PerfectHash.build(hashes, marks)
    order = np.argsort(built.number(hashes, marks))
    arrays = (built.sizes, built.words, marks[order], np.minimum(documents[order], 2 ** 32 - 1).astype(np.uint32),
              last[order])
    return pa.table([pa.array(shard[:1]), pa.array([int(asked.sum())])]
                    + [pa.array([a.tobytes()], pa.binary()) for a in arrays],
                    names=["shard", "asked", "sizes", "words", "marks", "documents", "last"])


def build_index(lines: DataFrame) -> DataFrame:
    """One row per shard: the perfect hash of its keys, their fingerprints, in
    how many documents they stand and the largest id of those."""
    shards = max(1, -(-lines.count() // SHARD_LINES))
    keys = lines.groupBy("hash", "mark").agg(
        F.count_distinct("id").alias("documents"), F.max("id").alias("last"), F.count("*").alias("asked"))
    shard = F.pmod("hash", F.lit(shards)).alias("shard")
    return (keys.select(shard, "hash", "mark", "documents", "last", "asked")
            .groupBy("shard").applyInArrow(_index, INDEX)
            .withColumn("shards", F.lit(shards)))


def _answer(min_docs: int):
    def run(asked: pa.Table, index: pa.Table) -> pa.Table:
        """Places of the lines to drop."""
        ids, ties, places, hashes, marks = (asked.column(n).to_numpy() for n in ("id", "tie", "place", "hash", "mark"))
        sizes, words, fingerprints, documents, last = (
            np.frombuffer(index.column(n)[0].as_py(), t) for n, t in (
                ("sizes", np.int64), ("words", "<u8"), ("marks", np.uint32), ("documents", np.uint32),
                ("last", np.int64)))
        marks = marks.view(np.uint32)
        at = PerfectHash(sizes, words).number(hashes.view(np.uint64), marks)
        drop = (at >= 0) & (fingerprints[at] == marks) & (documents[at] >= min_docs) & (last[at] != ids)
        return pa.table([ids[drop], ties[drop], places[drop]], names=["id", "tie", "place"])
    return run


def probe(lines: DataFrame, index: DataFrame, min_docs: int) -> DataFrame:
    """(id, tie, place) of the lines to drop: those whose key stands in
    ``min_docs`` documents or more, but in the one with the largest id."""
    shards = index.agg(F.max("shards")).first()[0] or 1
    # Shards that get more than their share of questions are copied. There are at most
    # lines / (2 * SHARD_LINES) of them; Spark broadcasts the list only if it is small.
    hot = stage(index.where(F.col("asked") > 2 * SHARD_LINES)
                .select("shard", F.ceil(F.col("asked") / SHARD_LINES).alias("copies")), "hot-shards")
    copy = F.pmod(F.xxhash64("id", "place"), F.coalesce("copies", F.lit(1).cast("long"))).alias("copy")
    asked = (lines.withColumn("shard", F.pmod("hash", F.lit(shards)).cast("long"))
             .join(hot, "shard", "left").select("shard", copy, "id", "tie", "place", "hash", "mark"))
    copies = (index.join(hot, "shard", "left")
              .select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("copies", F.lit(1)) - 1)).alias("copy"),
                      "sizes", "words", "marks", "documents", "last"))
    return asked.groupBy("shard", "copy").cogroup(copies.groupBy("shard", "copy")).applyInArrow(
        _answer(min_docs), "id long, tie long, place int")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The columns of ``docs`` (doc_id and text among them) with n_lines,
    n_dropped and kept, the text without the dropped lines."""
    docs = docs.drop("n_lines", "n_dropped", "kept")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("tie"), text.alias("text"),
                        F.col("text").isNull().alias("no_text"),
                        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c.lower() != "text"])
    lines = stage(lines_of(keyed.select("id", "tie", "text"), min_chars), "lines")
    dropped = (probe(lines, stage(build_index(lines), "line-index"), min_docs)
               .groupBy("id", "tie").agg(F.collect_set("place").alias("dropped")))
    split = F.split("text", "\n", -1)
    found = keyed.join(dropped, ["id", "tie"], "left").withColumn("lines", split)
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    kept = F.array_join(F.transform(places, lambda i: F.get("lines", i)), "\n")
    return found.select(
        *[(F.when(~F.col("no_text"), F.col("text")) if c.lower() == "text" else F.col(f"c{i}")).alias(c)
          for i, c in enumerate(docs.columns)],
        F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("dropped").isNull(), 0).otherwise(F.size("dropped")).cast("long").alias("n_dropped"),
        F.when(F.col("dropped").isNull(), F.col("text")).otherwise(kept).alias("kept"))
