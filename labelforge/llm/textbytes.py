"""Text columns as flat UTF-8 byte arrays: words and rolling hashes in numpy.

Null texts count as empty throughout. Work goes in slices of a few megabytes
(one long text is a slice of its own), so memory follows the longest text and
not the Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Word bytes: everything but ASCII white space.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False

#: Word bytes: digits, a-z and every byte of a non-ASCII character.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; offsets start at 0."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes, at least one row each."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for i < n."""
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for k, b in enumerate((BASE, _INVERSE)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
        if size > 8 * SLICE_BYTES:  # do not keep the tables of one giant text
            out = _powers[0], _powers[1]
            _powers[:] = [np.ones(1, np.uint64)] * 2
            return out
    return _powers[0], _powers[1]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running sums whose differences hash any byte range, see span_hash."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range; equal bytes give equal hashes."""
    _, down = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts])


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
    """Word starts and ends, and per row the index of its first word."""
    n = len(data)
    mark = np.zeros(n + 1, bool)
    mark[:n] = is_word[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.zeros(n + 1, bool)
    before[1:] = mark[:-1]
    before[cut] = False
    starts = np.flatnonzero(mark & ~before)
    after = np.zeros(n + 1, bool)
    after[:-1] = mark[1:]
    after[:-1][cut[1:]] = False
    ends = np.flatnonzero(mark & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def ngram_hash(words_: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n word hashes (one per start; n or more words)."""
    m = len(words_) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(m, np.uint64(n), np.uint64)
    for k in range(n):
        h = h * BASE + words_[k:k + m]
    return mix(h)


def packed(part: np.ndarray, records: np.ndarray) -> pa.RecordBatch:
    """(part, rows): the records of each part as one binary value."""
    order = np.argsort(part, kind="stable")
    part, records = part[order], np.ascontiguousarray(records[order])
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(part)), bool), part[1:] != part[:-1])))
    ends = np.append(first, len(part)) * records.dtype.itemsize
    rows = pa.Array.from_buffers(pa.large_binary(), len(first),
                                 [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(records.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(part[first].astype(np.int64)), rows.cast(pa.binary())],
                                      names=["part", "rows"])


def unpacked(column, dtype: np.dtype) -> np.ndarray:
    """The records of a column of packed rows, null rows left out."""
    return np.frombuffer(b"".join(column.drop_null().to_pylist()), dtype)
