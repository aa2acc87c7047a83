"""Toxicity by a counterfactually regularised logistic classifier.

Features of a text are the words it holds and their leading 4, 5 and 6 bytes,
so that unseen inflections of a stem count too. Training takes at most
``TRAIN_ROWS`` labelled documents of each class (the one bound; class weights
restore the rates of all labelled rows of the input), keeps every feature whose
likelihood ratio against the label is ``least_ratio`` or more, however many there
are (their number is bounded by the sample's texts), and minimises

    weighted log loss + l2 |w|^2 / 2 + cf * mean (w . (x' - x))^2 / 2

where x' are the features of a training sentence after each identity term was
replaced by the next one of its group, or left out. The last term makes the
score indifferent to which group a sentence mentions, and to whether it does.

Defined results: null or empty texts get the score of a text without features;
documents with a null id are scored and not held out; a document labelled
twice has the largest of its labels; null labels are ignored, as are labels
without a document; features at the ratio itself are kept; with labels of
one class only (or none) every score is that class's share (0 with none);
repeated rows are scored like any other; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .stage import small_batches, stage
from .textbytes import ALNUM, LOWER, flat, mix, prefix_hash, slices, span_hash, words

TRAIN_ROWS = 8192
LEAST_RATIO = 24.0  # 15.1 keeps half as many features more and finds no more of the held-out toxic texts
STEMS = (4, 5, 6)

#: Groups of interchangeable identity terms.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("blacks", "whites", "asians", "latinos", "africans", "europeans"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("immigrants", "refugees", "foreigners", "locals"),
    ("immigrant", "refugee", "foreigner", "local"),
    ("disabled", "deaf", "blind", "autistic", "elderly", "young"),
)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature hash) of every word and stem, with repeats."""
    data, offsets = flat(column)
    data = LOWER[data]
    starts, ends, first = words(data, offsets, ALNUM)
    prefix = prefix_hash(data)
    row = np.repeat(np.arange(len(column)), np.diff(first))
    out = [span_hash(prefix, starts, ends)]
    for n in STEMS:
        h = mix(span_hash(prefix, starts, np.minimum(ends, starts + n)) ^ np.uint64(n))
        out.append(np.where(ends - starts >= n, h, out[0]))
    return np.tile(row, len(out)), np.concatenate(out)


def present(column: pa.Array, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature index) of the chosen (sorted) features."""
    row, h = features(column)
    if not len(chosen):
        return row[:0], row[:0]
    at = np.minimum(np.searchsorted(chosen, h), len(chosen) - 1)
    hit = chosen[at] == h
    pair = np.unique(row[hit] * len(chosen) + at[hit])
    return pair // len(chosen), pair % len(chosen)


def swaps(text: str, groups=IDENTITY) -> list[tuple[str, str]]:
    """(sentence, counterfactual) for each sentence with an identity term: one
    with the next term of its group, one without the term."""
    after = {term: g[(i + 1) % len(g)] for g in groups for i, term in enumerate(g)}
    gone = dict.fromkeys(after, "")
    out = []
    for sentence in re.split(r"[.!?\n]+", text):
        low = sentence.lower()
        if any(w in after for w in re.findall(r"[a-z]+", low)):
            for table in (after, gone):
                out.append((low, re.sub(r"[a-z]+", lambda m: table.get(m[0], m[0]), low)))
    return out


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, toxic, clean): documents of the task's rows that hold it."""
    for batch in batches:
        _, offsets = flat(batch.column(0))
        for a, b in slices(offsets):
            part = batch.slice(a, b - a)
            row, h = features(part.column(0))
            order = np.lexsort((h, row))
            row, h = row[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            toxic = np.asarray(part.column(1)).astype(bool)[row[new]]
            kinds, at = np.unique(h[new], return_inverse=True)
            one = np.bincount(at, toxic, len(kinds)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kinds.view(np.int64)), pa.array(one), pa.array(np.bincount(at, minlength=len(kinds)) - one)],
                names=["feature", "toxic", "clean"])


def _entropy(n: Column, of: Column) -> Column:
    return F.when(n > 0, n * F.log(n / of)).otherwise(0.0)


def _fit(rows: np.ndarray, cols: np.ndarray, label: np.ndarray, weight: np.ndarray, deltas, k: int,
         l2: float, cf: float, steps: int = 800) -> tuple[np.ndarray, float]:
    """Accelerated gradient descent on the loss above; bounded by the sample."""
    d_row, d_col, d_val = deltas
    n_d = max(1, int(d_row.max()) + 1 if len(d_row) else 1)
    weight = weight / weight.sum()
    per_row = np.bincount(rows, minlength=len(label))
    rate = 1.0 / (0.25 * float((weight * (per_row + 1)).sum()) * 4 + l2 + cf)
    w = np.zeros(k)
    mean = float((weight * label).sum())
    b = float(np.log(mean / (1 - mean)))
    m, m_b, best = w.copy(), b, (np.inf, w, b)
    for step in range(steps):
        look, look_b = m, m_b
        z = np.bincount(rows, look[cols], len(label)) + look_b
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        moved = np.bincount(d_row, d_val * look[d_col], n_d)
        loss = -float((weight * np.where(label > 0, np.log(p), np.log1p(-p))).sum()) \
            + l2 / 2 * float(look @ look) + cf / 2 * float((moved ** 2).mean())
        if loss < best[0]:
            best = (loss, look, look_b)
        elif loss > 4 * best[0] + 1:  # overshot: go back and take smaller steps
            rate, w, b = rate / 4, best[1].copy(), best[2]
            m, m_b = w, b
            continue
        err = weight * (p - label)
        g = np.bincount(cols, err[rows], k) + l2 * look + cf / n_d * np.bincount(d_col, d_val * moved[d_row], k)
        new, new_b = look - rate * 40 * g, look_b - rate * 40 * float(err.sum())
        pull = step / (step + 3)
        m, m_b = new + pull * (new - w), new_b + pull * (new_b - b)
        w, b = new, new_b
    return best[1], best[2]


def train(docs: DataFrame, labels: DataFrame, train_on: Column, rows_most: int = TRAIN_ROWS,
          l2: float = 1e-5, cf: float = 1.0, groups=IDENTITY, least_ratio: float = LEAST_RATIO) -> dict:
    """Model for ``score``: chosen features, weights, bias. ``train_on`` is a
    condition on doc_id; labels: doc_id, toxic. Labels of documents that are not
    in ``docs`` are not used."""
    there = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
             .where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & train_on)
             .groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic")).join(there, "doc_id", "left_semi"))
    total = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = total.get(True, 0), total.get(False, 0)
    none = {"chosen": np.zeros(0, np.uint64), "weights": np.zeros(0), "bias": None, "rate": n1 / (n1 + n0) if n1 else 0.0}
    if not n1 or not n0:
        return none
    sample = known.where(F.col("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_most).unionByName(
        known.where(~F.col("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_most))
    text = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = stage(text.join(F.broadcast(sample), "doc_id").select("text", "toxic"), "toxic-sample")
    got = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    m1, m0 = got.get(True, 0), got.get(False, 0)
    if not m1 or not m0:
        return none
    a, c = F.col("toxic"), F.col("clean")
    all_, yes, no = F.lit(float(m1 + m0)), F.lit(float(m1)), F.lit(float(m0))
    held, rest = a + c, all_ - a - c
    ratio = 2 * (_entropy(a, held * yes / all_) + _entropy(c, held * no / all_)
                 + _entropy(yes - a, rest * yes / all_) + _entropy(no - c, rest * no / all_))
    picked = (rows.mapInArrow(_count_features, "feature long, toxic long, clean long")
              .groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
              .where(ratio >= least_ratio).select("feature").collect())
    terms = pa.array(sorted({t for g in groups for t in g}), pa.string())
    chosen = np.unique(np.concatenate((
        np.array([r["feature"] for r in picked], np.int64).view(np.uint64), features(terms)[1])))
    block = docs.sparkSession.sparkContext.broadcast(chosen)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = block.value
        for batch in batches:
            _, offsets = flat(batch.column(0))
            for i, j in slices(offsets):
                part = batch.slice(i, j - i)
                row, col = present(part.column(0), keep)
                cuts = np.searchsorted(row, np.arange(1, len(part)))
                lists = [x.tolist() for x in np.split(col, cuts)]
                moves = []
                for t in part.column(0).to_pylist():
                    own = []
                    for before, after in swaps(t or "", groups):
                        r, f = present(pa.array([before, after]), keep)
                        both = set(f[r == 0].tolist()) ^ set(f[r == 1].tolist())
                        gained = set(f[r == 1].tolist())
                        if both:
                            own.append([x + 1 if x in gained else -x - 1 for x in sorted(both)])
                    moves.append(own)
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), pa.array(lists, pa.list_(pa.int64())),
                     pa.array(moves, pa.list_(pa.list_(pa.int64())))], names=["toxic", "cols", "moves"])

    got = rows.mapInArrow(index, "toxic boolean, cols array<long>, moves array<array<long>>").collect()
    sizes = [len(r["cols"]) for r in got]
    row = np.repeat(np.arange(len(got)), sizes)
    col = np.array([c for r in got for c in r["cols"]], np.int64)
    label = np.array([float(r["toxic"]) for r in got])
    weight = np.where(label > 0, n1 / m1, n0 / m0)
    moves = [m for r in got for m in r["moves"]]
    d_row = np.repeat(np.arange(len(moves)), [len(m) for m in moves]).astype(np.int64)
    d_all = np.array([x for m in moves for x in m], np.int64)
    w, b = _fit(row, col, label, weight, (d_row, np.abs(d_all) - 1, np.sign(d_all).astype(float)),
                len(chosen), l2, cf)
    keep = np.abs(w) > 1e-9
    return {"chosen": chosen[keep], "weights": w[keep], "bias": b, "rate": none["rate"]}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """All columns of ``docs`` and toxicity (0 to 1; replaces such a column)."""
    block = docs.sparkSession.sparkContext.broadcast(model)
    docs = small_batches(docs).drop("toxicity")
    schema = StructType([*docs.schema.fields, StructField("toxicity", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = block.value
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            _, offsets = flat(column)
            out = [np.zeros(0)]
            for a, b in slices(offsets):
                row, col = present(column.slice(a, b - a), m["chosen"])
                z = np.bincount(row, m["weights"][col], b - a)
                out.append(np.full(b - a, m["rate"]) if m["bias"] is None
                           else 1 / (1 + np.exp(-np.clip(z + m["bias"], -40, 40))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out))],
                                             names=[*batch.schema.names, "toxicity"])

    return docs.mapInArrow(run, schema)


def held_out(parts: int = 4, part: int = 2) -> Column:
    """True where crc32(doc_id as text) mod ``parts`` is ``part``."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == part, F.lit(False))
