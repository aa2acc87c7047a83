"""Periodic runs of words by recursive frequency splitting and a lag scan.

A run is a stretch of consecutive words with smallest period q and a length of
at least max(MIN_WORDS, MIN_TIMES * q) that no neighbouring word extends. Every
word of a run stands in it MIN_TIMES times or more. So a word that occurs less
often in a segment of a text is in no run of that segment: such words split the
segment, the parts are counted anew, and so on until no word is too rare
(``survivors``). Most texts fall apart in one or two rounds.

The segments that survive are scanned lag by lag (``scan``). A run of period q
holds three multiples of q in a row at which the word q further on is the same,
so lag q looks at every q-th word only, n * log n looks for all lags. What
passes is extended word by word to both sides. A lag that is a multiple of the
period of a known run is not followed inside that run, which is why the first
period found for a stretch is its smallest.

One pass over the documents, no shuffle; work goes in slices of a few hundred
kilobytes of text (a longer text is a slice of its own), so memory follows the
longest text.

Defined results: null and empty texts, and texts of white space, have no words,
no runs and an empty ``collapsed``; every row gets its own result, rows that
repeat and rows with one id included (the id is not used); runs stand by start,
then period; an empty table gives no rows; other columns come back as they are,
those named ``runs`` or ``collapsed`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .stage import small_batches
from .textbytes import flat, slices

MIN_WORDS, MIN_TIMES = 6, 4
PAIRS = 1 << 20  # looks that are laid out at a time

RUN = StructType([StructField(n, LongType()) for n in ("start", "length", "period")])


def least_length(period):
    return np.maximum(MIN_WORDS, MIN_TIMES * period)


def survivors(words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts of the segments words[begin:end] in which every word occurs
    MIN_TIMES times or more, of MIN_WORDS words or more. ``words`` are numbers
    from 0."""
    vocabulary = int(words.max()) + 1 if len(words) else 1
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while True:
        long_ = end - begin >= MIN_WORDS
        begin, end = begin[long_], end[long_]
        if not len(begin):
            break
        size = end - begin
        owner = np.repeat(np.arange(len(begin)), size)
        at = np.arange(len(owner)) + np.repeat(begin - (np.cumsum(size) - size), size)
        _, which, counts = np.unique(owner * vocabulary + words[at], return_inverse=True, return_counts=True)
        rare = counts[which] < MIN_TIMES
        cut = np.zeros(len(begin), bool)
        cut[owner[rare]] = True
        done.append((begin[~cut], end[~cut]))
        keep = ~rare & cut[owner]
        same = owner[1:] == owner[:-1]
        head, tail = keep.copy(), keep.copy()
        head[1:] &= ~(keep[:-1] & same)
        tail[:-1] &= ~(keep[1:] & same)
        begin, end = at[head], at[tail] + 1
    if not done:
        return begin, end
    begin, end = (np.concatenate(x) for x in zip(*done))
    order = np.argsort(begin)
    return begin[order], end[order]


def _looks(size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(segment, lag, place) to look at, by segment, lag and place, in blocks."""
    lags = size // MIN_TIMES
    segment = np.repeat(np.arange(len(size)), lags)
    lag = np.arange(len(segment)) - np.repeat(np.cumsum(lags) - lags, lags) + 1
    count = (size[segment] - 1) // lag - 2
    ends = np.cumsum(count)
    a = 0
    while a < len(count):
        before = int(ends[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(ends, before + PAIRS, "right")))
        n = count[a:b]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        q = np.repeat(lag[a:b], n)
        yield np.repeat(segment[a:b], n), q, step * q
        a = b


def _seeds(words: np.ndarray, begin: np.ndarray, end: np.ndarray):
    """Looks at which four words a lag apart are the same, and words in
    between match the next two of theirs as well."""
    out = []
    for segment, lag, place in _looks(end - begin):
        p = begin[segment] + place
        for k in range(3):
            same = words[p + k * lag] == words[p + (k + 1) * lag]
            segment, lag, place, p = segment[same], lag[same], place[same], p[same]
        for k in (1, 2):
            i = p + lag * k // 3
            same = (words[i] == words[i + lag]) & (words[i + lag] == words[i + 2 * lag])
            segment, lag, place, p = segment[same], lag[same], place[same], p[same]
        out.append((segment, lag, place))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3


def _stretch(w: np.ndarray, p: int, q: int) -> tuple[int, int]:
    """The longest [a, b) around p with w[i] == w[i + q] throughout."""
    n, step = len(w) - q, 64
    b = p
    while b < n:
        to = min(n, b + step)
        off = np.flatnonzero(w[b:to] != w[b + q:to + q])
        if len(off):
            b += int(off[0])
            break
        b, step = to, step * 2
    a, step = p, 64
    while a > 0:
        to = max(0, a - step)
        off = np.flatnonzero(w[to:a] != w[to + q:a + q])
        if len(off):
            a = to + int(off[-1]) + 1
            break
        a, step = to, step * 2
    return a, b


def _runs_of(w: np.ndarray, lag: np.ndarray, place: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one segment, from its seeds by
    lag and place."""
    found: dict[int, list[tuple[int, int]]] = {}  # by period: (start, end), ascending
    cuts = np.flatnonzero(np.diff(lag)) + 1
    for own, q in zip(np.split(place, cuts), lag[np.append(0, cuts)].tolist()):
        for period, runs in found.items():
            if q % period == 0 and len(own):
                start, end = np.array(runs).T
                at = np.searchsorted(start, own, "right") - 1
                own = own[(at < 0) | (own + q >= end[at])]
        while len(own):
            a, b = _stretch(w, int(own[0]), q)
            if b - a + q >= least_length(q):
                found.setdefault(q, []).append((a, b + q))
            own = own[np.searchsorted(own, max(b, int(own[0]) + 1)):]
    return [(a, b - a, q) for q, runs in found.items() for a, b in runs]


def scan(words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs inside the segments."""
    segment, lag, place = _seeds(words, begin, end)
    out: list[tuple[int, int, int]] = []
    if not len(segment):
        return out
    edge = np.flatnonzero(np.diff(segment)) + 1
    for a, b in zip(np.append(0, edge).tolist(), np.append(edge, len(segment)).tolist()):
        first = int(begin[segment[a]])
        w = words[first:end[segment[a]]]
        out += [(first + s, n, q) for s, n, q in _runs_of(w, lag[a:b], place[a:b])]
    return sorted((s, q, n) for s, n, q in out)


def runs_of_texts(texts: list[bytes]) -> Iterator[tuple[list[tuple[int, int, int]], bytes]]:
    """Per text its runs (start, length, period) and its collapsed form."""
    split = [t.split() for t in texts]
    number: dict[bytes, int] = {}
    words = np.array([number.setdefault(w, len(number)) for t in split for w in t], dtype=np.int64)
    ends = np.cumsum([len(t) for t in split])
    begins = np.concatenate(([0], ends[:-1]))
    runs: list[list[tuple[int, int, int]]] = [[] for _ in split]
    for s, q, n in scan(words, *survivors(words, begins, ends)):
        t = int(np.searchsorted(ends, s, "right"))
        runs[t].append((s - int(begins[t]), n, q))
    for own, found in zip(split, runs):
        if found:
            keep = np.ones(len(own), bool)
            for s, n, q in found:
                keep[s + q:s + n] = False
            own = [own[i] for i in np.flatnonzero(keep).tolist()]
        yield found, b" ".join(own)


def _find(at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
        for batch in batches:
            data, offsets = flat(batch.column(0).field(at))
            for a, b in slices(offsets):
                texts = [data[x:y].tobytes() for x, y in zip(offsets[a:b].tolist(), offsets[a + 1:b + 1].tolist())]
                runs, kept = zip(*runs_of_texts(texts))
                found = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(found, kind),
                     pa.array([k.decode() for k in kept], pa.string())], names=["rest", "runs", "collapsed"])
    return run


def find_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` with ``runs``, an array of (start, length,
    period) in words, and ``collapsed``: the words that no run repeats (of
    each run the first period stays), joined by one space."""
    docs = small_batches(docs.drop("runs", "collapsed"))
    at = [c.lower() for c in docs.columns].index(text_col.lower())
    rest = docs.select(F.struct(*[
        (F.col(f"`{c}`").cast("string") if i == at else F.col(f"`{c}`")).alias(f"c{i}")
        for i, c in enumerate(docs.columns)]).alias("rest"))
    schema = StructType([rest.schema["rest"], StructField("runs", ArrayType(RUN)),
                         StructField("collapsed", StringType())])
    return rest.mapInArrow(_find(at), schema).select(
        *[F.col(f"rest.c{i}").alias(c) for i, c in enumerate(docs.columns)], "runs", "collapsed")
