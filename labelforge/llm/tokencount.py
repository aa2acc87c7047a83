"""Token counts of a lower-casing word BPE by rank-synchronous merging.

Texts are cut at the special strings (one token each), normalised (NFC, white
space to one space, lower case) and split into pre-tokens. Pre-tokens not seen
before are merged together: their symbols lie in one ragged array, and every
step applies to each sequence its lowest-rank pair until no pair is left; the
count of surviving symbols is the token count. Counts are kept in a bounded
table per worker.

Defined results: null text counts as empty (0 bytes, 0 tokens); rows with a
null id and repeated rows are counted like any other; empty input gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .stage import small_batches
from .textbytes import flat, slices

KNOWN_MOST = 300_000
NEVER = np.int64(1 << 40)

# The tokenizer's pre-token pattern with Unicode white space spelt out.
SPACE = r"\t-\r \x85\xa0  -     　"
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^" + SPACE + r"\p{L}\p{N}]+")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordMerger:
    """Symbol and merge tables of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        suffix = spec["model"]["end_of_word_suffix"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        letters = byte_letters()
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.final = np.array([vocab[letters[b] + suffix] for b in range(256)], np.int64)
        pairs = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in spec["model"]["merges"]], np.int64)
        self.size = np.int64(max(vocab.values()) + 1)
        rank = np.arange(len(pairs))
        keys = pairs[:, 0] * self.size + pairs[:, 1]
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], rank[order]
        self.made = pairs[:, 2]
        # A rule is safe to apply at all places of a sequence at once if no rule
        # that uses its product comes earlier.
        earliest = np.full(self.size, len(pairs))
        np.minimum.at(earliest, pairs[:, 0], rank)
        np.minimum.at(earliest, pairs[:, 1], rank)
        self.safe = earliest[self.made] > rank
        self.known: dict[str, int] = {}

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def merge(self, symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Symbols left of each sequence; sequence i starts at first[i] and
        none is empty."""
        sizes = np.diff(np.append(first, len(symbols)))
        left = sizes.copy()
        rows = np.arange(len(first))
        rank = np.full(len(symbols), NEVER)
        rank[:-1] = self.rank_of(symbols[:-1], symbols[1:])
        rank[first + sizes - 1] = NEVER
        while len(rows):
            low = np.minimum.reduceat(rank, first)
            live = low < NEVER
            if not live.all():  # finished sequences leave the arrays
                keep = np.repeat(live, sizes)
                symbols, rank = symbols[keep], rank[keep]
                left[rows] = sizes
                rows, sizes, low = rows[live], sizes[live], low[live]
                if not len(rows):
                    break
                first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            seq = np.repeat(np.arange(len(rows)), sizes)
            hit = np.flatnonzero(rank == low[seq])
            run = np.ones(len(hit), bool)
            run[1:] = np.diff(hit) != 1
            start = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            lead = np.ones(len(hit), bool)
            lead[1:] = seq[hit[1:]] != seq[hit[:-1]]
            hit = hit[(((np.arange(len(hit)) - start) % 2 == 0) & self.safe[low[seq[hit]]]) | lead]
            symbols[hit] = self.made[rank[hit]]
            gone = np.zeros(len(symbols), bool)
            gone[hit + 1] = True
            moved = np.cumsum(~gone) - 1
            at = moved[hit]
            sizes = sizes - np.bincount(seq[hit], minlength=len(rows))
            symbols, rank = symbols[~gone], rank[~gone]
            first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            again = np.concatenate((at, at[at > 0] - 1))
            nxt = np.minimum(again + 1, len(symbols) - 1)
            rank[again] = self.rank_of(symbols[again], symbols[nxt])
            rank[first + sizes - 1] = NEVER
        return left

    def learn(self, tokens: list[str]) -> None:
        raw = [t.encode() for t in tokens]
        sizes = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        first = np.cumsum(sizes) - sizes
        symbols = self.inner[data]
        ends = first + sizes - 1
        symbols[ends] = self.final[data[ends]]
        self.known.update(zip(tokens, self.merge(symbols, first).tolist()))

    def pre_tokens(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return PRE_TOKEN.findall(text.lower())

    def count(self, texts: list[str]) -> list[int]:
        """Token count of each text."""
        fixed, tokens = [], []
        for text in texts:
            if any(s in text for s in self.special):
                parts = regex.split("|".join(map(regex.escape, self.special)), text)
                fixed.append(len(parts) - 1)
                tokens.append([t for p in parts for t in self.pre_tokens(p)])
            else:
                fixed.append(0)
                tokens.append(self.pre_tokens(text))
        if len(self.known) > KNOWN_MOST:
            self.known.clear()
        new = set(chain.from_iterable(tokens)) - self.known.keys()
        if new:
            self.learn(list(new))
        get = self.known.__getitem__
        return [n + sum(map(get, t)) for n, t in zip(fixed, tokens)]


@lru_cache(maxsize=2)
def merger(path: str) -> WordMerger:
    return WordMerger(path)


def count_tokens(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) per row; the
    vocabulary file must lie at ``path`` on every worker."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(path)
        for batch in batches:
            _, offsets = flat(batch.column(1))
            counts: list[int] = []
            for a, b in slices(offsets):
                counts += m.count([t or "" for t in batch.column(1).slice(a, b - a).to_pylist()])
            tokens = np.array(counts, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offsets)), pa.array(tokens), pa.array(tokens > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    cols = small_batches(docs).select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return cols.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
