"""Repeated byte strings by sharded suffix arrays.

A byte is a repeat if it lies in a string of ``LENGTH`` bytes that also starts
earlier: in a document before this one, or further up in this one.

Anchors route the work. The anchor of a string is the place of its smallest
hashed ``GRAM``-gram, so equal strings have equal anchors; neighbouring starts
mostly share one, and a run of starts with one anchor is a segment. Segments
go to shards by their anchor. Of segments with the same bytes all but the
earliest are repeats as a whole. Where segments of one anchor differ, the
earliest of each kind is cut out of its text and put into a suffix array:

* the array is refined in the Larsson-Sadakane way (order by the first six
  bytes, then double the compared length, sorting only groups that still tie),
* Kasai's rule gives the common prefixes, for all segments side by side,
* starts whose strings agree on LENGTH bytes form a group, and all but the
  earliest of a group are repeats.

An anchor with more than ``SHARD_SEGMENTS`` different segments is dealt over
up to ``MOST_SALTS`` shards, and each pair of those is merged by binary search
of the starts of one in the suffix array of the other. An anchor with more than
that is split by context (``_refine``): its segments are cut by the distance of
their starts from the anchor, and each part gets a new key from all bytes that
its strings must share, round after round with finer cuts, until the groups are
small; parts that are alone or equal drop out on the way, and a part of one
start has its whole string for a key. No text is ever compared with all others,
and no shard holds more than a bounded number of bytes.

What moves is linear in the text: a segment is one record, at most one packed
row; of equal segments in one slice of texts only the earliest is sent on; an
asked segment is one row, or MOST_SALTS.

Defined results: null text counts as empty; a null id counts as smaller than
any other; rows with one id and one text are the same document and get the
same result; rows with one id and different texts are ordered by a hash of the
text; texts of fewer than LENGTH bytes have no repeats; empty input gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from .stage import small_batches, stage
from .textbytes import flat, mix, packed, prefix_hash, slices, span_hash, unpacked

LENGTH, GRAM = 100, 24
PART_BYTES = 4 << 20
SHARD_BYTES = 1 << 19
SHARD_SEGMENTS = 8192
MOST_SALTS = 4
WIDTHS = (32, 16, 8, 4, 2, 1)  # distances from the anchor that stay together, by round
FIRST = -(1 << 63)  # order of a null id

SEGMENT = np.dtype([("key", "<u4"), ("body", "<u8"), ("doc", "<i8"), ("tie", "<i8"),
                    ("start", "<u4"), ("starts", "u1"), ("lead", "u1")])
REQUEST = np.dtype([("group", "<u8"), ("start", "<u4"), ("starts", "u1"), ("lead", "u1"),
                    ("salts", "u1"), ("salt", "u1")])  # salts 0: too many segments, to be split by context
SPAN = np.dtype([("start", "<u4"), ("end", "<u4")])
PIECE = np.dtype([("doc", "<i8"), ("tie", "<i8"), ("start", "<u4"), ("side", "u1"), ("size", "u1")])


def segments(data: np.ndarray, offsets: np.ndarray):
    """Runs of string starts with one anchor: row, first start, number of
    starts, distance of the anchor from the first, anchor hash, hash of all
    bytes the strings cover."""
    n, none = len(data), (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    if n < LENGTH:
        return none
    prefix = prefix_hash(data)
    at = np.arange(n - GRAM + 1)
    gram = span_hash(prefix, at, at + GRAM)
    bits = np.uint64(max(23, int(n).bit_length()))
    least = (gram >> bits << bits) | at.astype(np.uint64)
    grams, span = LENGTH - GRAM + 1, 1
    while span * 2 <= grams:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < grams:
        least = np.minimum(least[:len(least) - (grams - span)], least[grams - span:])
    anchor = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    sizes = np.diff(offsets)
    ok = np.zeros(n + 1, np.int64)
    long_ = sizes >= LENGTH
    np.add.at(ok, offsets[:-1][long_], 1)
    np.add.at(ok, offsets[1:][long_] - LENGTH + 1, -1)
    valid = np.cumsum(ok)[:len(anchor)] > 0
    new = valid.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new)
    if not len(first):
        return none
    count = np.add.reduceat(valid, first)
    row = np.searchsorted(offsets, first, "right") - 1
    return (row, first, count, anchor[first] - first, mix(gram[anchor[first]]),
            span_hash(prefix, first, first + count + LENGTH - 1))


SEGMENTS = "part long, rows binary, doc long, tie long, spans binary"


def _scan(parts: int):
    """Packed segments by part; of equal ones in a slice the earliest, the
    others are spans (doc, tie, spans) at once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tie = (np.asarray(batch.column(k)) for k in (0, 1))
            data, offsets = flat(batch.column(2))
            for a, b in slices(offsets):
                own = offsets[a:b + 1] - offsets[a]
                row, first, count, lead, key, body = segments(data[offsets[a]:offsets[b]], own)
                out = np.empty(len(row), SEGMENT)
                out["key"], out["body"] = key >> np.uint64(32), body
                out["doc"], out["tie"] = doc[a:b][row], tie[a:b][row]
                out["start"], out["starts"], out["lead"] = first - own[row], count, lead
                part = (key & np.uint64(0xFFFFFFFF)) % np.uint64(parts)
                later, copy = _later(key, out)
                if later.any():
                    part, out = part[~later], out[~later]
                p = packed(part, out)
                none = len(p)
                yield pa.RecordBatch.from_arrays(
                    [*p.columns, pa.nulls(none, pa.int64()), pa.nulls(none, pa.int64()), pa.nulls(none, pa.binary())],
                    names=["part", "rows", "doc", "tie", "spans"])
                if len(copy):
                    spans = _spans_of(copy)
                    to = mix(spans.column("doc").to_numpy().view(np.uint64)) % np.uint64(parts)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(to.astype(np.int64)), pa.nulls(len(to), pa.binary()),
                         *(spans.column(n).combine_chunks() for n in ("doc", "tie", "spans"))],
                        names=["part", "rows", "doc", "tie", "spans"])
    return run


def _later(key: np.ndarray, records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks all but the earliest of the records with equal key and body, and
    lists those of them that are not the earliest one once more."""
    both = mix(key) ^ records["body"]
    order = np.argsort(both, kind="stable")
    twin = both[order[1:]] == both[order[:-1]]
    later = np.zeros(len(records), bool)
    if not twin.any():
        return later, records[:0]
    some = order[np.append(twin, False) | np.append(False, twin)]
    r = records[some]
    some = some[np.lexsort((r["start"], r["tie"], r["doc"], r["body"], key[some]))]
    r, k = records[some], key[some]
    new = np.ones(len(r), bool)
    new[1:] = (k[1:] != k[:-1]) | (r["body"][1:] != r["body"][:-1])
    later[some[~new]] = True
    earliest = r[np.maximum.accumulate(np.where(new, np.arange(len(r)), 0))]
    same = (earliest["doc"] == r["doc"]) & (earliest["tie"] == r["tie"]) & (earliest["start"] == r["start"])
    return later, r[~new & ~same]


def _by_document(doc, tie, records) -> tuple[pa.Array, pa.Array, pa.Array]:
    """The records of each document as one binary value."""
    order = np.lexsort((records["start"], tie, doc))
    doc, tie, records = doc[order], tie[order], records[order]
    new = np.flatnonzero(np.concatenate((np.ones(min(1, len(doc)), bool),
                                         (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]))))
    number = np.zeros(len(doc), np.int64)
    number[new] = 1
    batch = packed(np.cumsum(number) - 1, records)
    return pa.array(doc[new]), pa.array(tie[new]), batch.column(1)


def cover(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sorted, disjoint spans that cover the same bytes."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate((np.ones(min(1, len(start)), bool), start[1:] > end[:-1]))
    out = np.empty(int(new.sum()), SPAN)
    out["start"], out["end"] = start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)] if len(end) else 0
    return out


RESULT = "doc long, tie long, spans binary, requests binary, hot long"
NAMES = ["doc", "tie", "spans", "requests", "hot"]


def _result(doc, tie, start, end, requests=None, r_doc=None, r_tie=None) -> pa.Table:
    """Spans, and requests with the number of those that are to be split by
    context, one row per document and kind."""
    spans = np.empty(len(doc), SPAN)
    spans["start"], spans["end"] = start, end
    d, t, s = _by_document(doc, tie, spans)
    nothing = lambda n, kind: pa.nulls(n, kind)
    tables = [pa.table([d, t, s, nothing(len(d), pa.binary()), nothing(len(d), pa.int64())], names=NAMES)]
    if requests is not None:
        for mine in (requests["salts"] > 0, requests["salts"] == 0):
            d, t, r = _by_document(r_doc[mine], r_tie[mine], requests[mine])
            hot = np.asarray(pc.binary_length(r), np.int64) // REQUEST.itemsize * int(not requests["salts"][mine].all())
            tables.append(pa.table([d, t, nothing(len(d), pa.binary()), r, pa.array(hot)], names=NAMES))
    return pa.concat_tables(tables)


def _spans_of(copies: np.ndarray) -> pa.Table:
    end = copies["start"] + copies["starts"] + (LENGTH - 1)
    return _result(copies["doc"], copies["tie"], copies["start"], end)


def _first_rows(records: np.ndarray) -> np.ndarray:
    """True for a sorted record that differs from the one before: a row that
    the table holds twice is one document."""
    new = np.ones(len(records), bool)
    new[1:] = records[1:] != records[:-1]
    return new


def _sift(most: int, most_salts: int):
    """Same bytes: all but the earliest are repeats. Same anchor, different
    bytes: the earliest of each kind is asked for."""
    def run(table: pa.Table) -> pa.Table:
        part = np.uint64(table.column("part")[0].as_py())
        known = table.filter(pc.is_valid(table.column("doc")))
        s = unpacked(table.column("rows"), SEGMENT)
        order = np.argsort(s["key"], kind="stable")
        key = s["key"][order]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        alone = new & np.append(new[1:], True)
        s = s[order[~alone]]
        s = s[np.lexsort((s["start"], s["tie"], s["doc"], s["body"], s["key"]))]
        s = s[_first_rows(s)]
        key = np.ones(len(s), bool)
        key[1:] = s["key"][1:] != s["key"][:-1]
        kind = key.copy()
        kind[1:] |= s["body"][1:] != s["body"][:-1]
        copy = s[~kind]
        group = np.cumsum(key) - 1
        kinds = np.bincount(group[kind], minlength=int(key.sum()))
        ask = kind & (kinds[group] > 1)
        q, n = s[ask], kinds[group[ask]]
        r = np.empty(len(q), REQUEST)
        r["group"] = q["key"].astype(np.uint64) << np.uint64(32) | part
        r["start"], r["starts"], r["lead"] = q["start"], q["starts"], q["lead"]
        salts = -(-n // most)
        r["salts"] = np.where(salts <= most_salts, salts, 0)
        r["salt"] = mix(q["doc"].view(np.uint64) ^ q["start"].astype(np.uint64)) % np.maximum(salts, 1).astype(np.uint64)
        out = _result(copy["doc"], copy["tie"], copy["start"], copy["start"] + copy["starts"] + (LENGTH - 1),
                      r, q["doc"], q["tie"])
        known = known.select(["doc", "tie", "spans"])
        return pa.concat_tables([out, known.append_column("requests", pa.nulls(len(known), pa.binary()))
                                 .append_column("hot", pa.nulls(len(known), pa.int64()))])
    return run


def _by_bytes(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches in parts of a few megabytes of ``column``."""
    for batch in batches:
        _, offsets = flat(batch.column(batch.schema.get_field_index(column)))
        for a, b in slices(offsets, 2 << 20):
            yield batch.slice(a, b - a)


def _cut_out(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> pa.Array:
    """data[first:first + size] of each piece as a binary column."""
    ends = np.cumsum(size)
    at = np.arange(int(size.sum())) + np.repeat(first - (ends - size), size)
    offsets = np.concatenate(([0], ends)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(size), [
        None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[at].tobytes())]).cast(pa.binary())


PIECES = "shard long, doc long, tie long, start long, side int, body binary"
CONTEXT = "key long, doc long, tie long, start long, lead int, body binary"


def _requests(batches: Iterator[pa.RecordBatch]):
    """Per part of a batch: bytes, text offsets, requests, the row of each, and
    the rows' documents."""
    for batch in _by_bytes(batches, "text"):
        doc, tie, text, asked = (batch.column(batch.schema.get_field_index(n))
                                 for n in ("doc", "tie", "text", "requests"))
        data, offsets = flat(text)
        r = unpacked(asked, REQUEST)
        counts = np.asarray(pc.fill_null(pc.binary_length(asked), 0), np.int64) // REQUEST.itemsize
        yield data, offsets, r, np.repeat(np.arange(len(batch)), counts), np.asarray(doc), np.asarray(tie)


def _deal(shards: int):
    """Cut the segments that were asked for out of the texts, one row for each
    of their shards."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, offsets, r, row, doc, tie in _requests(batches):
            times = r["salts"].astype(np.int64)
            which = np.repeat(np.arange(len(r)), times)
            other = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
            r, row = r[which], row[which]
            low, high = np.minimum(r["salt"], other), np.maximum(r["salt"], other)
            to = np.where(r["salts"] == 1, mix(r["group"]) % np.uint64(shards),
                          mix(mix(r["group"] + np.uint64(1)) + (low.astype(np.uint64) << np.uint64(20))
                              + high.astype(np.uint64)) | np.uint64(1 << 63))
            side = (r["salt"] != low) & (low != high)
            body = _cut_out(data, offsets[row] + r["start"], r["starts"].astype(np.int64) + (LENGTH - 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(to.astype(np.uint64).view(np.int64)), pa.array(doc[row]), pa.array(tie[row]),
                 pa.array(r["start"].astype(np.int64)), pa.array(side.astype(np.int32)), body],
                names=["shard", "doc", "tie", "start", "side", "body"])
    return run


def _deal_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut out the segments that are to be split by context."""
    for data, offsets, r, row, doc, tie in _requests(batches):
        body = _cut_out(data, offsets[row] + r["start"], r["starts"].astype(np.int64) + (LENGTH - 1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(r["group"].view(np.int64)), pa.array(doc[row]), pa.array(tie[row]),
             pa.array(r["start"].astype(np.int64)), pa.array(r["lead"].astype(np.int32)), body],
            names=["key", "doc", "tie", "start", "lead", "body"])


def _by_context(width: int):
    """Parts of the pieces whose starts have a distance from the anchor in one
    run of ``width``, under a key of the bytes that all such strings share."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, doc, tie, start, lead = (np.asarray(batch.column(k)) for k in range(5))
            lead = lead.astype(np.int64)
            data, offsets = flat(batch.column(5))
            starts = np.diff(offsets) - (LENGTH - 1)
            least, most = (lead - starts + 1) // width, lead // width
            row = np.repeat(np.arange(len(batch)), most - least + 1)
            run_ = np.arange(len(row)) - np.repeat(np.cumsum(most - least + 1) - (most - least + 1), most - least + 1)
            run_ = least[row] + run_
            far = np.minimum(lead[row], run_ * width + width - 1)  # the first start's distance
            near = np.maximum(lead[row] - starts[row] + 1, run_ * width)
            begin = offsets[row] + lead[row] - far
            size = far - near + LENGTH
            anchor = offsets[row] + lead[row]
            prefix = prefix_hash(data)
            shared = span_hash(prefix, anchor - run_ * width, anchor - (run_ * width + width - 1) + LENGTH)
            new = mix(mix(key[row].view(np.uint64) + run_.astype(np.uint64)) ^ shared)
            yield pa.RecordBatch.from_arrays(
                [pa.array(new.view(np.int64)), pa.array(doc[row]), pa.array(tie[row]),
                 pa.array(start[row] + lead[row] - far), pa.array(far.astype(np.int32)),
                 _cut_out(data, begin, size)],
                names=["key", "doc", "tie", "start", "lead", "body"])
    return run


def _refine(pieces: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Split groups of more than ``most`` pieces by context until none is left:
    pieces of small groups (key, doc, tie, start, body), and spans (doc, tie,
    start, end) of pieces that equal an earlier one. Each round compares by
    grouped minima, which Spark combines before it shuffles; the join back is
    one that AQE splits where a key is hot."""
    place = F.struct("doc", "tie", "start")
    small = spans = None
    for width in WIDTHS:
        cut = stage(pieces.mapInArrow(_by_context(width), CONTEXT).withColumn("kind", F.xxhash64("body")), "context")
        kinds = cut.groupBy("key", "kind").agg(F.min(place).alias("first"), F.count("*").alias("n"))
        kinds = stage(kinds, "kinds")
        groups = kinds.groupBy("key").agg(F.count("*").alias("kinds"))
        copies = cut.join(kinds.where("n > 1").select("key", "kind", "first"), ["key", "kind"]).where(
            place != F.col("first")).select(
            "doc", "tie", "start", (F.col("start") + F.octet_length("body")).alias("end"))
        firsts = cut.join(kinds.select("key", "kind", "first"), ["key", "kind"]).where(place == F.col("first"))
        firsts = stage(firsts.join(groups.where("kinds > 1"), "key").select(
            "key", "doc", "tie", "start", "lead", "body", "kinds"), "refined")
        done = firsts.where(F.col("kinds") <= most).select("key", "doc", "tie", "start", "body")
        small = done if small is None else small.unionByName(done)
        spans = copies if spans is None else spans.unionByName(copies)
        pieces = firsts.where(F.col("kinds") > most).drop("kinds")
        if pieces.isEmpty():
            break
    return small, spans


class SuffixArray:
    """All suffixes of the pieces of ``data`` in order of their bytes, and in
    ``order`` those of LENGTH bytes or more. Piece i is data[begin[i]:begin[i]
    + size[i]]; suffixes end with their piece, equal ones stand by place."""

    def __init__(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray):
        self.data, self.begin, self.size, n = data, begin, size, len(data)
        most = int(size.max()) if len(size) else 0
        # Places are 32-bit numbers: a shard holds a bounded number of bytes.
        self.left = left = np.repeat((begin + size).astype(np.int32), size)  # bytes up to the piece's end
        left -= np.arange(n, dtype=np.int32)
        symbol = np.zeros(n + 6, np.uint16)
        symbol[:n] = data
        symbol[:n] += 1
        key = np.zeros(n, np.int64)
        for k in range(6):
            key <<= 9
            key |= np.where(left > k, symbol[k:k + n], 0)
        order = np.argsort(key).astype(np.int32)
        key = key[order]
        new = np.ones(n, bool)
        new[1:] = key[1:] != key[:-1]
        del key, symbol
        rank = np.zeros(n + most, np.int32)  # place of the first suffix that ties with this one
        rank[order] = np.flatnonzero(new).astype(np.int32)[np.cumsum(new, dtype=np.int32) - 1] + 1
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))  # places in groups of several
        h = 6
        while h < most and len(tied):
            who = order[tied]
            key = rank[who].astype(np.int64) << 32 | np.where(left[who] > h, rank[who + h], 0)
            again = np.argsort(key)
            who, key = who[again], key[again]
            order[tied] = who
            split = np.ones(len(who), bool)
            split[1:] = key[1:] != key[:-1]
            rank[who] = tied[np.flatnonzero(split)[np.cumsum(split) - 1]] + 1
            new[tied] = split
            tied = tied[~(split & np.append(split[1:], True))]
            h *= 2
        who = order[tied]  # equal to their ends
        order[tied] = who[np.argsort(rank[who].astype(np.int64) << 32 | who)]
        self.every = order
        self.long = left[order] >= LENGTH
        self.order = order[self.long]

    def common(self) -> np.ndarray:
        """Common prefix of each entry of ``order`` with the one before it, by
        Kasai's rule: all pieces advance by one suffix per round, and what a
        piece's suffix shares with its predecessor shrinks by one at most."""
        place = np.empty(len(self.data), np.int32)
        place[self.every] = np.arange(len(self.every), dtype=np.int32)
        out = np.zeros(len(self.every), np.int32)
        known = np.zeros(len(self.begin), np.int32)
        for t in range(int(self.size.max()) if len(self.size) else 0):
            live = np.flatnonzero(self.size > t)
            here = self.begin[live] + t
            at = place[here]
            prev = self.every[at - 1]
            most = np.where(at > 0, np.minimum(self.left[here], self.left[prev]), 0)
            k = np.minimum(known[live], most)
            go = np.flatnonzero(k < most)
            while len(go):
                go = go[self.data[here[go] + k[go]] == self.data[prev[go] + k[go]]]
                k[go] += 1
                go = go[k[go] < most[go]]
            out[at] = k
            known[live] = np.maximum(k - 1, 0)
        # Short suffixes in between: the least prefix on the way counts.
        kept = np.flatnonzero(self.long)
        if not len(kept):
            return kept
        out[:kept[0] + 1] = 0
        return np.minimum.reduceat(out[:kept[-1] + 1], np.concatenate(([0], kept[:-1] + 1)))

    def find(self, other: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Binary search: place of the first entry not below the LENGTH-byte
        string of ``other`` at each start."""
        mine, theirs = _words8(self.data), _words8(other)
        lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), len(self.order))
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) // 2
            below = _compare(mine, self.order[mid], theirs, starts[open_]) < 0
            lo[open_[below]] = mid[below] + 1
            hi[open_[~below]] = mid[~below]


def _words8(data: np.ndarray) -> np.ndarray:
    """Eight bytes from each place on, as one big-endian number."""
    padded = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out = out << np.uint64(8) | padded[k:k + len(data)]
    return out


def _compare(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray) -> np.ndarray:
    """-1, 0 or 1 as the LENGTH bytes at x[a] are below, equal to or above
    those at y[b]."""
    out = np.zeros(len(a), np.int64)
    for k in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        same = np.flatnonzero(out == 0)
        if not len(same):
            break
        p, q = x[a[same] + k], y[b[same] + k]
        out[same] = (p > q).astype(np.int64) - (p < q)
    return out


def _pieces(meta: np.ndarray, data: np.ndarray):
    size = meta["size"].astype(np.int64)
    begin = np.cumsum(size) - size
    return SuffixArray(data, begin, size), begin


def _origin(meta: np.ndarray, begin: np.ndarray, at: np.ndarray):
    """(doc, tie, start) of places in the pieces' bytes."""
    owner = np.searchsorted(begin, at, "right") - 1
    m = meta[owner]
    return m["doc"], m["tie"], m["start"] + (at - begin[owner])


def _earliest(group: np.ndarray, doc, tie, start) -> np.ndarray:
    """True for all but the earliest of each group."""
    order = np.lexsort((start, tie, doc, group))
    late = np.zeros(len(group), bool)
    late[order[1:]] = group[order[1:]] == group[order[:-1]]
    return late


def _search(table: pa.Table) -> pa.Table:
    """Repeats among the pieces of one shard, or, if the shard holds two sides
    of a pair, among strings that occur on both."""
    data, offsets = flat(table.column("body").combine_chunks())
    meta = np.empty(len(table), PIECE)
    for name in ("doc", "tie", "start", "side"):
        meta[name] = table.column(name).to_numpy()
    meta["size"] = np.diff(offsets)
    order = np.lexsort((meta["start"], meta["tie"], meta["doc"]))
    keep = np.zeros(len(meta), bool)
    keep[order] = _first_rows(meta[order])
    data, meta = data[np.repeat(keep, meta["size"])], meta[keep]
    two = bool((meta["side"] == 1).any())
    side = np.repeat(meta["side"], meta["size"]) if two else None
    own = meta[meta["side"] == 0] if two else meta
    array, begin = _pieces(own, data[side == 0] if two else data)
    group = np.cumsum(array.common() < LENGTH)
    if two:
        theirs = meta[meta["side"] == 1]
        b_array, b_begin = _pieces(theirs, data[side == 1])
        at = array.find(b_array.data, b_array.order)
        hit = at < len(array.order)
        hit[hit] = _compare(_words8(array.data), array.order[at[hit]], _words8(b_array.data), b_array.order[hit]) == 0
        met = group[at[hit]]
        keep = np.isin(group, met)
        origin = [np.concatenate(x) for x in zip(_origin(own, begin, array.order[keep]),
                                                 _origin(theirs, b_begin, b_array.order[hit]))]
        group = np.concatenate((group[keep], met))
    else:
        keep = np.bincount(group)[group] > 1 if len(group) else np.zeros(0, bool)
        origin, group = _origin(own, begin, array.order[keep]), group[keep]
    doc, tie, start = origin
    late = _earliest(group, doc, tie, start)
    return _result(doc[late], tie[late], start[late], start[late] + LENGTH).select(["doc", "tie", "spans"])


def _span_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc, tie, start, end = (np.asarray(c) for c in batch.columns)
        spans = _result(doc, tie, start, end).select(["doc", "tie", "spans"])
        yield from spans.to_batches()


def _cut(as_text: bool):
    """Spans per document, and what lies outside them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_bytes(batches, "text"):
            data, offsets = flat(batch.column(1))
            spans, kept = [], []
            for r, found in enumerate(batch.column(2)):
                body, s = data[offsets[r]:offsets[r + 1]], np.zeros(0, SPAN)
                if found.is_valid:
                    s = np.frombuffer(b"".join(x.as_py() for x in found.values), SPAN)
                    s = cover(s["start"].astype(np.int64), s["end"].astype(np.int64))
                spans.append([{"start": int(x), "end": int(y)} for x, y in s])
                edge = [0, *s.view("<u4").tolist(), len(body)]
                rest = b"".join(body[x:y].tobytes() for x, y in zip(edge[::2], edge[1::2]))
                kept.append(rest.decode("utf-8", "ignore") if as_text else rest)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array(kept, pa.string() if as_text else pa.binary())], names=["rest", "spans", "kept"])
    return run


def find_repeats(docs: DataFrame, shard_segments: int = SHARD_SEGMENTS, as_text: bool = False,
                 most_salts: int = MOST_SALTS) -> DataFrame:
    """The columns of ``docs`` (doc_id and text among them) with spans (byte
    ranges of the repeats, disjoint, sorted) and kept: the bytes outside, or
    with ``as_text`` their characters, those cut in half left out. Columns
    named spans or kept are replaced."""
    docs = small_batches(docs).drop("spans", "kept")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    others = [c for c in docs.columns if c.lower() != "text"]
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)).alias("doc"),
                        F.xxhash64(text).alias("tie"), text.alias("text"),
                        F.struct(F.col("text").isNull().alias("no_text"),
                                 *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]).alias("rest"))
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    anchors = size * 2 // (LENGTH - GRAM + 2)
    parts = max(1, -(-anchors * SEGMENT.itemsize // PART_BYTES))
    sifted = stage(keyed.select("doc", "tie", "text").mapInArrow(_scan(parts), SEGMENTS)
                   .groupBy("part").applyInArrow(_sift(shard_segments, most_salts), RESULT), "repeats")
    asked = sifted.where(F.col("hot") == 0).select("doc", "tie", "requests")
    marks = sifted.agg(F.sum(F.octet_length("requests")), F.sum("hot")).first()
    shards = max(1, -(-((marks[0] or 0) // REQUEST.itemsize * (LENGTH + (LENGTH - GRAM) // 2)) // SHARD_BYTES))
    pieces = keyed.join(asked, ["doc", "tie"]).mapInArrow(_deal(shards), PIECES)
    known = sifted.where(F.col("spans").isNotNull()).select("doc", "tie", "spans")
    if marks[1]:
        hot = sifted.where(F.col("hot") > 0).select("doc", "tie", "requests")
        small, copies = _refine(keyed.join(hot, ["doc", "tie"]).mapInArrow(_deal_hot, CONTEXT), shard_segments)
        pieces = pieces.unionByName(small.select(F.pmod("key", F.lit(shards)).alias("shard"), "doc", "tie", "start",
                                                 F.lit(0).alias("side"), "body"))
        known = known.unionByName(copies.mapInArrow(_span_rows, "doc long, tie long, spans binary"))
    found = pieces.groupBy("shard").applyInArrow(_search, "doc long, tie long, spans binary")
    spans = known.unionByName(found).groupBy("doc", "tie").agg(F.collect_list("spans").alias("found"))
    cut = keyed.join(spans, ["doc", "tie"], "left").select(
        F.struct("rest.*", F.when(F.col("rest.no_text"), F.lit(None)).otherwise(F.col("text")).alias("text"))
        .alias("rest"), "text", "found")
    schema = StructType([cut.schema["rest"], StructField("spans", ArrayType(StructType(
        [StructField("start", LongType()), StructField("end", LongType())]))),
        StructField("kept", StringType() if as_text else BinaryType())])
    names = {c: f"c{i}" for i, c in enumerate(others)}
    return cut.mapInArrow(_cut(as_text), schema).select(
        *[F.col(f"rest.{names.get(c, 'text')}").alias(c) for c in docs.columns], "spans", "kept")
