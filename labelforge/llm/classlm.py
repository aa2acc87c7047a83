"""Brown class-based bigram language model.

    P(w | previous) = m * P(class(w) | class(previous)) * P(w | class(w)) + (1 - m) * P0(w)

Exchange clustering assigns words to classes, by falling frequency. First come
the most frequent words (``head``), each a type of its own, and the endings
(hashes of a word's last three bytes), types that stand for all other words:
each round counts, over the whole training corpus, what classes stand before and
after each type, and then moves every second type to the class that raises the
class-bigram likelihood most; the best round's classes are kept. Then every other
word that occurs at least ``least`` times is exchanged once: its tokens, each with the
classes before and after it, meet in one task, which moves the word from its
ending's class to the class of the greatest likelihood. How many words
have a class of their own so grows with the corpus; only words that occur more
rarely than that, or never, have the class of their ending. The class bigrams are
counted anew with the final classes.

Words, counts and classes are a table. The more frequent ones (at most
``lookup``) are broadcast. A word beyond them has its ending's class, unless its
bit is set in a broadcast filter of the others with a class of their own: the
classes of words with such a bit are joined, in training and in scoring, and in
scoring the counts of all words beyond the broadcast ones. Words of an ending's
class give up an absolute discount, which is what an unseen word of that ending
gets. P0 is the add-one unigram.

Defined results: null text counts as empty (one end token); null ids are
training rows and score as any other; repeated rows count as often as they
come; of classes with the same gain a word takes the first; without training
rows every token is unknown and both scores are 0; empty input gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stage import small_batches, stage
from .textbytes import LOWER, NOT_SPACE, flat, packed, prefix_hash, slices, span_hash, unpacked, words

MIXTURE = 0.98
END_WORD = np.uint64(0x5851F42D4C957F2D)
HELD = 1 << 18  # rows that a task holds before it merges them, and passes them on
PART_ROWS = 1 << 20  # tokens that meet in one group, about
MARK_BITS = 25  # leading bits of a word's hash that a filter of words looks at
CHUNK = 256


class Size(NamedTuple):
    """What bounds the model, whatever the corpus."""
    head: int = 4096  # words that are exchanged in rounds, before all others
    endings: int = 1024  # classes of words that occur fewer than ``least`` times
    least: int = 16  # every word with this count has a class of its own
    classes: int = 64
    rounds: int = 8
    lookup: int = 1 << 19  # words whose counts are broadcast


def tokens(column: pa.Array, endings: int):
    """Word and ending hashes of the rows' tokens, each row closed by the end
    token, and the index of each row's first token."""
    data, offsets = flat(column)
    data = LOWER[data]
    starts, ends, first = words(data, offsets, NOT_SPACE)
    prefix = prefix_hash(data)
    word = span_hash(prefix, starts, ends)
    ending = (span_hash(prefix, np.maximum(starts, ends - 3), ends) % np.uint64(endings)).astype(np.int64)
    n = len(column)
    at = np.arange(len(starts)) + np.repeat(np.arange(n), np.diff(first))
    out_w = np.full(len(starts) + n, END_WORD)
    out_e = np.full(len(starts) + n, endings, np.int64)
    out_w[at], out_e[at] = word, ending
    return out_w, out_e, first + np.arange(n + 1)


def _count_words(endings: int):
    def merged(parts):
        w, e, n = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(w)
        w = w[order]
        at = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
        return w[at], e[order[at]], np.add.reduceat(n[order], at)

    def out(held):
        w, e, n = held
        return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(e.astype(np.int32)), pa.array(n)],
                                          names=["word", "ending", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            _, offsets = flat(batch.column(0))
            for a, b in slices(offsets):
                w, e, _ = tokens(batch.column(0).slice(a, b - a), endings)
                held.append(merged([(w, e, np.ones(len(w), np.int64))]))
                if sum(len(x[0]) for x in held) > HELD:
                    held = [merged(held)]
                    if len(held[0][0]) > HELD // 2:
                        yield out(held[0])
                        held = []
        if held:
            yield out(merged(held))
    return run


def _frequent(vocab: DataFrame, most: int) -> Column:
    """Whether a word is above a count level, the lowest with at most ``most`` words."""
    level = F.floor(F.log2(F.col("n")) * 16)
    steps = sorted(vocab.groupBy(level.alias("level")).agg(F.count("*").alias("k")).collect(),
                   key=lambda r: -r["level"])
    total, least = 0, 1 << 30
    for r in steps:
        total += r["k"]
        if total > most:
            break
        least = r["level"]
    return level >= least


def _marks(words: DataFrame) -> np.ndarray:
    """A filter of words: bytes with a bit for every MARK_BITS leading bits of a
    hash, set where one of ``words`` has them. Other words can have them too."""
    at = words.select(F.shiftrightunsigned("word", 64 - MARK_BITS).alias("at"))
    rows = at.groupBy(F.shiftright("at", 6).alias("slot")).agg(
        F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits")).toArrow()  # at most 2^19 rows
    out = np.zeros(1 << (MARK_BITS - 6), np.int64)
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return out.astype("<i8").view(np.uint8)


def _marked(marks: np.ndarray, word: np.ndarray) -> np.ndarray:
    at = (word >> np.uint64(64 - MARK_BITS)).view(np.int64)
    return (marks[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _index(keys: np.ndarray) -> np.ndarray:
    """For _find: where, among sorted hashes, those of each leading bits begin."""
    bits = len(keys).bit_length() + 1
    edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.searchsorted(keys, edges).astype(np.int32)


def _find(keys: np.ndarray, index: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of the first key that is not below each wanted hash, or the last place."""
    last = len(keys) - 1
    at = np.minimum(index[(wanted >> np.uint64(65 - len(index).bit_length())).view(np.int64)], last)
    below = np.flatnonzero(keys[at] < wanted)
    while len(below := below[at[below] < last]):
        at[below] += 1
        below = below[keys[at[below]] < wanted[below]]
    return at


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: int) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), default)
    at = _find(keys, _index(keys), wanted)
    return np.where(keys[at] == wanted, values[at], default)


def _types(word: np.ndarray, ending: np.ndarray, head: np.ndarray) -> np.ndarray:
    """0: end token; then the head words; then the endings."""
    t = _lookup(head, np.arange(1, len(head) + 1), word, -1)
    t = np.where(t < 0, len(head) + 1 + ending, t)
    return np.where(word == END_WORD, 0, t)


def likelihood(after: np.ndarray, cls: np.ndarray) -> float:
    """Log likelihood of the class bigrams, up to a constant of the words."""
    k = after.shape[1]
    joint = np.zeros((k, k))
    np.add.at(joint, cls, after)  # joint[c, d]: class c before class d
    f = lambda x: float((x * np.log(np.maximum(x, 1))).sum())
    return f(joint) - f(joint.sum(0)) - f(joint.sum(1))


def _best_class(joint: np.ndarray, a: int, left: np.ndarray, right: np.ndarray) -> int:
    """Where a type of class a, with these class counts before and after it,
    raises the likelihood most. Class 0 is the end token's alone."""
    xlogx = lambda x: x * np.log(np.maximum(x, 1))
    n, m = right.sum(), left.sum()
    j, f, s = joint.copy(), joint.sum(1), joint.sum(0)
    j[:, a] -= left
    j[a, :] -= right
    f[a] -= n
    s[a] -= m
    j = np.maximum(j, 0)
    old = xlogx(j)
    gain = (xlogx(j + left[:, None]) - old).sum(0) + (xlogx(j + right[None, :]) - old).sum(1) \
        - (xlogx(f + n) - xlogx(f)) - (xlogx(s + m) - xlogx(s))
    d = np.diag(j)  # gets both
    gain += xlogx(d + left + right) - xlogx(d + left) - xlogx(d + right) + xlogx(d)
    gain[0] = -np.inf
    return int(gain.argmax())


def _best_classes(joint: np.ndarray, a: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """_best_class of many words at once: classes a, rows of counts left and
    right. Only classes that stand next to a word add to its likelihood."""
    xlogx = lambda x: x * np.log(np.maximum(x, 1))
    each, n, m = np.arange(len(a)), right.sum(1), left.sum(1)
    row, column = joint[a] - right, joint.T[a] - left  # of class a, without the word
    row[each, a] -= left[each, a]
    column[each, a] -= right[each, a]
    row, column = np.maximum(row, 0), np.maximum(column, 0)

    def next_to(side, joint, row, column):
        out = np.zeros(side.shape)
        w, i = np.nonzero(side)
        if not len(w):
            return out
        j, old = joint[i], xlogx(joint)[i]
        own = np.flatnonzero(i == a[w])
        j[own] = row[w[own]]
        old[own] = xlogx(j[own])
        at = np.arange(len(w)), a[w]
        j[at] = column[w, i]
        old[at] = xlogx(j[at])
        first = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
        out[w[first]] = np.add.reduceat(xlogx(j + side[w, i][:, None]) - old, first)
        return out

    f, s, d = (np.tile(x, (len(a), 1)) for x in (joint.sum(1), joint.sum(0), np.diag(joint)))
    f[each, a] -= n
    s[each, a] -= m
    d[each, a] = row[each, a]
    gain = next_to(left, joint, row, column) + next_to(right, joint.T, column, row) \
        - (xlogx(f + n[:, None]) - xlogx(f)) - (xlogx(s + m[:, None]) - xlogx(s))
    gain += xlogx(d + left + right) - xlogx(d + left) - xlogx(d + right) + xlogx(d)
    gain[:, 0] = -np.inf
    return gain.argmax(1)


def _exchange(before: np.ndarray, after: np.ndarray, cls: np.ndarray, movable: np.ndarray) -> np.ndarray:
    """One round: before[v, c] and after[v, c] count the classes next to type
    v; each movable type goes to the class of greatest likelihood, all other
    types held where they are. Class 0 is the end token's alone."""
    k = before.shape[1]
    joint = np.zeros((k, k))
    np.add.at(joint, cls, after)
    out = cls.copy()
    for v in movable:
        if before[v].any() or after[v].any():
            out[v] = _best_class(joint, cls[v], before[v], after[v])
    return out


def _neighbours(streams: DataFrame, cls: np.ndarray, k: int):
    """before, after (types x k classes): class counts next to each type."""
    n_types, block = len(cls), streams.sparkSession.sparkContext.broadcast(cls)
    width = CHUNK * k

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = block.value
        total = np.zeros((2, -(-n_types // CHUNK) * width), np.int64)
        for batch in batches:
            for blob in batch.column(0):
                x = np.concatenate(([0], np.frombuffer(blob.as_buffer(), "<u2"))).astype(np.int64)
                total[0] += np.bincount(x[1:] * k + c[x[:-1]], minlength=total.shape[1])
                total[1] += np.bincount(x[:-1] * k + c[x[1:]], minlength=total.shape[1])
        parts = total.reshape(-1, width)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(parts), dtype=np.int32)), pa.array([p.tobytes() for p in parts])],
            names=["chunk", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b.as_buffer(), np.int64) for b in table.column(1))
        return pa.table({"chunk": table.column(0)[:1], "counts": pa.array([total.tobytes()])})

    rows = (streams.mapInArrow(count, "chunk int, counts binary").groupBy("chunk")
            .applyInArrow(add, "chunk int, counts binary").collect())  # types x classes, bounded
    total = np.zeros((2 * -(-n_types // CHUNK), width), np.int64)
    for r in rows:
        total[r["chunk"]] = np.frombuffer(r["counts"], np.int64)
    both = total.reshape(2, -1, k)[:, :n_types]
    return both[0], both[1]


def _vocabulary(text: DataFrame, size: Size) -> DataFrame:
    return stage(text.mapInArrow(_count_words(size.endings), "word long, ending int, n long").groupBy("word").agg(
        F.min("ending").alias("ending"), F.sum("n").alias("n")), "vocabulary")


def _streams(text: DataFrame, head: np.ndarray, often: DataFrame, size: Size) -> DataFrame:
    """A row per slice of texts: the tokens' types, a bit per token that may be
    one of the words ``often`` (none of the head), and the hashes of these."""
    block = text.sparkSession.sparkContext.broadcast((head, _marks(often)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, marks = block.value
        for batch in batches:
            _, offsets = flat(batch.column(0))
            for a, b in slices(offsets):
                w, e, _ = tokens(batch.column(0).slice(a, b - a), size.endings)
                t = _types(w, e, head)
                own = t > len(head)
                own[own] = _marked(marks, w[own])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x.tobytes()], pa.binary()) for x in (t.astype("<u2"), np.packbits(own), w[own])],
                    names=["types", "own", "words"])

    return stage(text.mapInArrow(run, "types binary, own binary, words binary"), "type-streams")


def _slices_of(batch: pa.RecordBatch):
    """Of each row of _streams: types, places of the words of their own, their hashes."""
    for types, own, word in zip(*batch.columns):
        x = np.frombuffer(types.as_buffer(), "<u2").astype(np.int64)
        at = np.flatnonzero(np.unpackbits(np.frombuffer(own.as_buffer(), np.uint8), count=len(x)))
        yield x, at, np.frombuffer(word.as_buffer(), np.uint64)


CONTEXT = np.dtype([("word", "<u8"), ("ending", "<u2"), ("pair", "<u2")])


def _contexts(block, k: int, parts: int):
    """Words of their own, a record per token: its ending, and the classes that
    stand around it, as class before x k + class after. Packed by part."""
    def out(held):
        rows = np.concatenate(held)
        return packed((rows["word"] % np.uint64(parts)).astype(np.int64), rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, cls = block.value
        held, size = [], 0
        for batch in batches:
            for x, at, word in _slices_of(batch):
                c = cls[x]
                rows = np.empty(len(at), CONTEXT)
                rows["word"], rows["ending"] = word, x[at] - heads - 1
                rows["pair"] = np.where(at > 0, c[at - 1], 0) * k + c[at + 1]  # never the last token, an end
                held.append(rows)
                size += len(rows)
                if size > HELD:
                    yield out(held)
                    held, size = [], 0
        if size:
            yield out(held)
    return run


WORDS = "word long, ending int, n long, class int, shared boolean"


def _placed(block, k: int, least: int):
    """From the records of a part: a row per word that occurs at least ``least``
    times, with its count and its class after one exchange."""
    def run(table: pa.Table) -> pa.Table:
        joint, ending_class = block.value
        rows = unpacked(table.column("rows"), CONTEXT)
        rows = rows[np.argsort(rows["word"])]
        w = rows["word"]
        at = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
        count = np.diff(np.append(at, len(w)))
        kept = count >= least
        rows, at, count = rows[np.repeat(kept, count)], at[kept], count[kept]
        w, e = w[at], rows["ending"][np.cumsum(count) - count].astype(np.int64)
        cls, ends = ending_class[e], np.cumsum(count)
        for i in range(0, len(w), CHUNK):
            a, b = ends[i] - count[i], ends[min(i + CHUNK, len(w)) - 1]
            some = count[i:i + CHUNK]
            of, pair = np.repeat(np.arange(len(some)) * k, some), rows["pair"][a:b].astype(np.int64)
            left, right = (np.bincount(of + c, minlength=len(some) * k).reshape(-1, k).astype(float)
                           for c in (pair // k, pair % k))
            cls[i:i + CHUNK] = _best_classes(joint, cls[i:i + CHUNK], left, right)
        return pa.table({"word": w.view(np.int64), "ending": e.astype(np.int32), "n": count,
                         "class": cls.astype(np.int32), "shared": np.zeros(len(w), bool)})
    return run


def _exchange_others(text: DataFrame, head: np.ndarray, cls: np.ndarray, joint: np.ndarray, size: Size,
                     vocab: DataFrame | None = None, streams: DataFrame | None = None) -> DataFrame:
    """A row per word beyond the head: its count, and its class after one exchange
    against ``joint``, the class bigrams under ``cls``, the classes of the types.
    ``vocab`` and ``streams`` are made from the texts where they are not given.
    Only words of ``least`` tokens are exchanged; all others keep their ending's class."""
    spark, k = text.sparkSession, size.classes
    vocab = _vocabulary(text, size) if vocab is None else vocab
    others, often = _beyond(vocab, head), F.col("n") >= size.least
    streams = _streams(text, head, others.where(often), size) if streams is None else streams
    # A word beyond a full head has fewer than 1 / size.head of all tokens, so a part stays small.
    parts = -(-(others.where(often).agg(F.sum("n")).first()[0] or 1) // PART_ROWS)
    around = streams.mapInArrow(_contexts(spark.sparkContext.broadcast((len(head), cls)), k, parts), "part long, rows binary")
    own = around.groupBy("part").applyInArrow(
        _placed(spark.sparkContext.broadcast((joint, cls[len(head) + 1:])), k, size.least), WORDS)
    ending = spark.createDataFrame([(e, int(c)) for e, c in enumerate(cls[len(head) + 1:])], "ending int, class int")
    rare = others.where(~often).join(F.broadcast(ending), "ending")  # size.endings rows
    return own.unionByName(rare.select("word", "ending", "n", "class", F.lit(True).alias("shared")))


def _beyond(vocab: DataFrame, head: np.ndarray) -> DataFrame:
    """The words that are neither of the head nor the end token."""
    known = [(int(w),) for w in np.append(head, END_WORD).view(np.int64)]
    return vocab.join(F.broadcast(vocab.sparkSession.createDataFrame(known, "word long")), "word", "left_anti")


def _known(m: dict, w: np.ndarray, e: np.ndarray):
    """Count (-1: not in the broadcast part of the table), class (of the ending
    where the count is -1), whether the word is of its ending's class, and
    whether its class is open."""
    at = _find(m["keys"], m["index"], w)
    found = m["keys"][at] == w
    open_ = ~found
    open_[open_] = _marked(m["marks"], w[open_])
    return np.where(found, m["counts"][at], -1), np.where(found, m["classes"][at], m["ending_class"][e]), \
        found & m["shared"][at], open_


def _before(x: np.ndarray, first) -> np.ndarray:
    """What stands before each token; ``first`` before the first, which follows an end."""
    return np.concatenate(([first], x[:-1]))


def _classed(rows: DataFrame, words: DataFrame, word: str, cls: str) -> DataFrame:
    """``rows`` with the class of ``word`` from the table as ``cls``, where word is set and known."""
    hit = words.select(F.col("word").alias(word), F.col("class").alias("hc"), F.col("n").alias("hn"),
                       F.col("shared").alias("hs"))
    late = rows.where(F.col(word).isNotNull()).join(hit, word, "left").withColumn(cls, F.coalesce("hc", cls))
    return late.unionByName(rows.where(F.col(word).isNull()), allowMissingColumns=True)


def _class_pairs(streams: DataFrame, words: DataFrame, m: dict, block) -> np.ndarray:
    """Class bigrams of the training rows under the final classes."""
    k, heads = m["size"].classes, m["heads"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = block.value
        joint = np.zeros(k * k, np.int64)
        names = ["lw", "lc", "word", "c", "n"]
        for batch in batches:
            for x, at, word in _slices_of(batch):
                c, late, w = m["types"][x], np.zeros(len(x), bool), np.zeros(len(x), np.uint64)
                w[at] = word
                _, c[at], _, late[at] = _known(m, word, x[at] - heads - 1)
                prev, open_ = _before(c, 0), _before(late, False)
                rest = late | open_
                joint += np.bincount((prev * k + c)[~rest], minlength=k * k)
                at = np.flatnonzero(rest)
                if len(at):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(_before(w, np.uint64(0))[at].view(np.int64), mask=~open_[at]), pa.array(prev[at].astype(np.int32)),
                         pa.array(w[at].view(np.int64), mask=~late[at]), pa.array(c[at].astype(np.int32)),
                         pa.array(np.ones(len(at), np.int64))], names=names)
        at = np.flatnonzero(joint)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(at), pa.int64()), pa.array((at // k).astype(np.int32)), pa.nulls(len(at), pa.int64()),
             pa.array((at % k).astype(np.int32)), pa.array(joint[at])], names=names)

    pairs = stage(streams.mapInArrow(run, "lw long, lc int, word long, c int, n long"), "class-pairs")
    pairs = _classed(pairs, words, "lw", "lc").select("lc", "word", "c", "n")
    out = np.zeros((k, k))
    for r in _classed(pairs, words, "word", "c").groupBy("lc", "c").agg(
            F.sum("n").alias("n")).collect():  # at most classes x classes rows
        out[r["lc"], r["c"]] = r["n"]
    return out


def train(docs: DataFrame, train_on: Column, size: Size = Size()) -> dict:
    """The model, with its table of words (word, ending, n, class, shared) as a
    staged DataFrame."""
    spark = docs.sparkSession
    text = small_batches(docs).where(train_on).select(F.col("text").cast("string").alias("text"))
    vocab = _vocabulary(text, size)
    one = vocab.agg(F.sum("n").alias("n"), F.count("*").alias("v"),
                    F.sum((F.col("n") == 1).cast("long")).alias("n1"),
                    F.sum((F.col("n") == 2).cast("long")).alias("n2")).first()
    total, k = one["n"] or 0, size.classes
    model = {"N": total, "V": one["v"], "size": size}
    if not total:
        return model
    end = int(np.uint64(END_WORD).view(np.int64))
    no_end = vocab.where(F.col("word") != end)
    top = sorted(((int(np.int64(r["word"]).view(np.uint64)), r["ending"], r["n"]) for r in
                  no_end.where(_frequent(no_end, size.head)).collect()))  # at most size.head rows
    head = np.array([t[0] for t in top], np.uint64)
    streams = _streams(text, head, _beyond(vocab, head).where(F.col("n") >= size.least), size)
    n_types = len(head) + 1 + size.endings
    cls = np.arange(n_types) % (k - 1) + 1
    cls[0] = 0
    best = (-np.inf, cls, None)
    for r in range(size.rounds + 1):
        before, after = _neighbours(streams.select("types"), cls, k)
        best = max(best, (likelihood(after, cls), cls, after), key=lambda x: x[0])
        if r < size.rounds:
            cls = _exchange(before, after, cls, np.arange(1 + r % 2, n_types, 2))
    _, cls, after = best
    joint = np.zeros((k, k))
    np.add.at(joint, cls, after)
    ending_class = cls[len(head) + 1:]
    others = stage(_exchange_others(text, head, cls, joint, size, vocab, streams), "word-classes")
    first = [(int(np.uint64(w).view(np.int64)), e, n, int(c), False) for (w, e, n), c in zip(top, cls[1:])]
    ends = total - sum(t[2] for t in top) - (others.agg(F.sum("n")).first()[0] or 0)
    first.append((end, size.endings, ends, 0, False))
    words = others.unionByName(spark.createDataFrame(first, WORDS))
    # The broadcast part of the table: at most size.lookup rows, and the end.
    no_end = words.where(F.col("word") != end)
    often = _frequent(no_end, size.lookup)
    more = no_end.where(often).unionByName(words.where(F.col("word") == end)).select(
        "word", "n", "class", "shared").toArrow()
    known, count, classes, shared = (more.column(i).to_numpy() for i in range(4))
    order = np.argsort(known.view(np.uint64))
    keys = known.view(np.uint64)[order]
    model |= {"words": words, "heads": len(head), "types": cls, "ending_class": np.append(ending_class, 0), "keys": keys,
              "index": _index(keys), "counts": count[order], "classes": classes[order].astype(np.int64),
              "shared": shared[order], "marks": _marks(no_end.where(~often & ~F.col("shared")))}
    # Mass of a class: its own words, and per ending the words that share it with what they give up.
    n1, n2 = one["n1"], one["n2"]
    discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    class_mass, seen = np.zeros(k), np.zeros(size.endings)
    for r in words.groupBy("class", F.when(F.col("shared"), F.col("ending")).alias("e")).agg(
            F.sum("n").alias("n"), F.count("*").alias("v")).collect():  # at most classes + endings rows
        class_mass[r["class"]] += r["n"]
        if r["e"] is not None:
            seen[r["e"]] = r["v"]
    class_mass += np.bincount(ending_class, np.full(size.endings, discount), k)
    joint = _class_pairs(streams, words, model, spark.sparkContext.broadcast({x: y for x, y in model.items() if x != "words"}))
    share = class_mass / class_mass.sum()
    follow = (joint + share) / (joint.sum(1, keepdims=True) + 1)
    return model | {"joint": joint, "discount": discount, "class_mass": class_mass, "follow": follow,
                    "unseen": np.append(discount * (seen + 1), 0), "unseen_share": np.append((seen + 1) / (seen + 1).sum(), 0)}


OPEN = pa.struct([("lw", pa.int64()), ("lc", pa.int32()), ("word", pa.int64()), ("c", pa.int32()), ("n", pa.int64()),
                  ("shared", pa.bool_()), ("y", pa.float64()), ("z", pa.float64())])


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score (log10) per row."""
    cols = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total, size, endings = model["N"], model["V"], model["size"].endings
    if not total:
        def only(batches):
            for batch in batches:
                _, offsets = flat(batch.column(1))
                for a, b in slices(offsets):
                    n = np.diff(tokens(batch.column(1).slice(a, b - a), endings)[2])
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64())],
                                                     names=["doc_id", "n_tokens"])
        return cols.mapInArrow(only, "doc_id long, n_tokens long").select(
            "doc_id", "n_tokens", F.lit(0).cast("long").alias("n_known"), F.lit(0.0).alias("base_score"),
            F.lit(0.0).alias("score"))
    spark, k, unit = docs.sparkSession, model["size"].classes, float(total + size + 1)
    rate = MIXTURE * model["follow"] / np.maximum(model["class_mass"], 1e-300)
    block = spark.sparkContext.broadcast({x: y for x, y in model.items() if x != "words"} | {"rate": rate})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, part, row = block.value, TaskContext.get().partitionId(), 0
        for batch in batches:
            _, offsets = flat(batch.column(1))
            for a, b in slices(offsets):
                w, e, first = tokens(batch.column(1).slice(a, b - a), endings)
                n, c, shared, free = _known(m, w, e)
                late = n < 0
                prev, open_ = _before(c, 0), _before(free, False)
                rest = late | open_
                p = m["rate"][prev, c] * (n - m["discount"] * shared) + (1 - MIXTURE) * (n + 1) / unit
                s = np.where(rest, 0, np.log10(np.where(rest, 1, p)))
                base = np.log10(np.maximum(n, 0) + 1)
                rows = np.repeat(np.arange(b - a), np.diff(first))
                at = np.flatnonzero(rest)
                left = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(rows[at], np.arange(b - a + 1)).astype(np.int32)),
                    pa.StructArray.from_arrays(
                        [pa.array(_before(w, np.uint64(0))[at].view(np.int64), mask=~open_[at]), pa.array(prev[at].astype(np.int32)),
                         pa.array(w[at].view(np.int64), mask=~late[at]), pa.array(c[at].astype(np.int32)),
                         pa.array(n[at], mask=late[at]), pa.array(shared[at]),
                         pa.array(m["unseen"][e[at]]), pa.array(m["unseen_share"][e[at]])], fields=list(OPEN)))
                j = b - a
                yield pa.RecordBatch.from_arrays(
                    [pa.array((np.int64(part) << 40) + row + np.arange(j)), batch.column(0).slice(a, j),
                     pa.array(np.diff(first)), pa.array(np.bincount(rows, ~late, j).astype(np.int64)),
                     pa.array(np.bincount(rows, base, j)), pa.array(np.bincount(rows, s, j)), left],
                    names=["row", "doc_id", "n_tokens", "n_found", "base", "s", "open"])
                row += j

    first = stage(cols.mapInArrow(run, (
        "row long, doc_id long, n_tokens long, n_found long, base double, s double, "
        "open array<struct<lw:long,lc:int,word:long,c:int,n:long,shared:boolean,y:double,z:double>>")), "partial-scores")
    rates = spark.createDataFrame([(i, j, float(rate[i, j])) for i in range(k) for j in range(k)], "lc int, c int, x double")
    opened = first.select("row", F.explode("open").alias("t")).select("row", "t.*")
    opened = _classed(opened, model["words"], "lw", "lc").drop("hc", "hn", "hs", "lw")
    # A word in the table is of its ending's class, or its class is the one found.
    opened = _classed(opened, model["words"], "word", "c").withColumns(
        {"late": F.col("word").isNotNull(), "n": F.coalesce("n", "hn"), "shared": F.coalesce("hs", "shared")})
    done = opened.join(F.broadcast(rates), ["lc", "c"])  # classes x classes rows
    n, x = F.col("n"), F.col("x")
    p = F.when(n.isNull(), x * F.col("y") + (1 - MIXTURE) / unit * F.col("z")).otherwise(
        x * (n - F.col("shared").cast("int") * model["discount"]) + (1 - MIXTURE) * (n + 1) / unit)
    rest = done.groupBy("row").agg(
        F.sum((F.col("late") & n.isNotNull()).cast("long")).alias("more"),
        F.sum(F.when(F.col("late"), F.log10(F.coalesce(n, F.lit(0)) + 1)).otherwise(0.0)).alias("base2"),
        F.sum(F.log10(p)).alias("s2"))
    zero = F.lit(0)
    return first.drop("open").join(rest, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_found") + F.coalesce("more", zero)).alias("n_known"),
        (F.col("base") + F.coalesce("base2", zero) - F.col("n_tokens") * float(np.log10(unit))).alias("base_score"),
        (F.col("s") + F.coalesce("s2", zero)).alias("score"))
