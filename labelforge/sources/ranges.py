"""Records that span byte ranges: one large CSV or JSON-array file read by many
tasks.

Spark cuts a file into byte ranges only where a record is a line. A quoted CSV
field may hold line ends, and a JSON array is one value, so both are read by one
task a file otherwise. Here Spark's text reader cuts the file at every separator
(``\\n``, or the ``}`` that ends each JSON object), wherever that stands, and what
a piece means depends on the state in which it begins: inside quotes or not, and
how many braces are open.

1. Each range is run from both states (``_ends_of_ranges``). The result, one row
   per range as the driver has planned them anyway, is a function from state to
   state; composing them in file order gives the true state at each range's
   start. From there on a range is read on its own.
2. Pieces are joined to records in one pass. A range gives its whole records,
   and at most two parts of records that go on in a neighbouring range; those few
   are put together by file and order.
3. Spark's own ``from_csv`` / ``from_json`` parses the records.

Defined results: as the one-task readers give for the same options (rows stand
in no particular order); an empty file and a file with a header only give no
rows; empty lines outside quotes are skipped; a last record without a line end
counts; a quote that is never closed makes the rest of the file one record.
Quotes count at the start of a field only. A JSON file may be an array of objects
or objects in a row, on any number of lines; elements that are no objects are
skipped. Text is UTF-8, a byte order mark is dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: From inside a quoted field to its closing quote ("" is a quote in the text).
CLOSE = re.compile(r'[^"]*+(?:""[^"]*+)*+"(?!")')
ESCAPED = re.compile(r"\\.", re.DOTALL)

WHOLE, END, START = 0, 1, 2  # a record, the end (or middle) of one, the start of one

RANGE = "file long, block long, inside0 boolean, open0 long, inside1 boolean, open1 long"
PARTS = "file long, block long, kind int, first boolean, part string"


class Csv:
    separator = "\n"

    @staticmethod
    def step(line: str, inside: bool) -> tuple[bool, int]:
        """State after a line, and how many braces it leaves open (none)."""
        if '"' not in line:
            return inside, 0
        at = 0
        while True:
            if inside or line.startswith('"', at):
                shut = CLOSE.match(line, at if inside else at + 1)
                if shut is None:
                    return True, 0
                inside, at = False, shut.end()
            at = line.find(",", at) + 1
            if not at:
                return False, 0


class Json:
    separator = "}"

    @staticmethod
    def step(piece: str, inside: bool) -> tuple[bool, int]:
        """State after a piece and its brace, and how many braces more are
        open than before."""
        if "\\" in piece:
            piece = ESCAPED.sub("", piece)
        parts = piece.split('"')
        opened = sum(p.count("{") for p in parts[1 if inside else 0::2])
        inside ^= len(parts) % 2 == 0
        return inside, opened - (not inside)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], list[str]]]:
    """Runs of pieces of one range (file, block)."""
    for batch in batches:
        texts, files, blocks = (c.to_pylist() for c in batch.columns)
        a = 0
        while a < len(texts):
            b, at = a + 1, (files[a], blocks[a])
            if files[-1] == at[0] and blocks[-1] == at[1]:
                b = len(texts)
            else:
                while b < len(texts) and (files[b], blocks[b]) == at:
                    b += 1
            yield at, texts[a:b]
            a = b


def _ends_of_ranges(syntax):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, at, out = syntax.step, None, []
        for now, texts in _pieces(batches):
            if now != at:
                if at is not None:
                    out.append((*at, *ends[0], *ends[1]))
                at, ends = now, [(False, 0), (True, 0)]
            (x, n), (y, m) = ends
            for text in texts:
                same = x == y
                x, k = step(text, x)
                n += k
                y, k = (x, k) if same else step(text, y)
                m += k
            ends = [(x, n), (y, m)]
        if at is not None:
            out.append((*at, *ends[0], *ends[1]))
        columns = list(zip(*out)) if out else [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                         names=["file", "block", "inside0", "open0", "inside1", "open1"])
    return run


def starts_of_ranges(ends) -> dict[tuple[int, int], tuple[bool, int]]:
    """(file, block) -> state at its start, by composing the ranges before it."""
    starts, file, state = {}, None, (False, 0)
    for r in sorted(ends, key=lambda r: (r["file"], r["block"])):
        if r["file"] != file:
            file, state = r["file"], (False, 0)
        starts[(file, r["block"])] = state
        inside, opened = (r["inside1"], r["open1"]) if state[0] else (r["inside0"], r["open0"])
        state = inside, state[1] + opened
    return starts


def _records(syntax, starts):
    """Whole records, and the parts at a range's ends, each piece followed by
    its separator."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, sep, at = syntax.step, syntax.separator, None
        held: list[str] = []
        for now, texts in _pieces(batches):
            out: list[tuple] = []
            if now != at:
                if held:
                    out.append((*at, END if joining else START, first, sep.join(held) + sep))
                if now not in starts.value:
                    raise ValueError("the file's byte ranges are not those that were looked at before")
                at, held = now, []
                inside, opened = starts.value[now]
                joining, first = inside or opened > 0, at[1] == 0
            for text in texts:
                inside, k = step(text, inside)
                opened += k
                held.append(text)
                if not inside and opened == 0:
                    out.append((*at, END if joining else WHOLE, first, sep.join(held) + sep))
                    held, joining, first = [], False, False
            if out:
                yield _batch(out)
        if held:
            yield _batch([(*at, END if joining else START, first, sep.join(held) + sep)])
    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                      names=["file", "block", "kind", "first", "part"])


def records(spark: SparkSession, path: str, syntax) -> DataFrame:
    """(record, first) of all files below ``path``: the text of each record with
    its separators, and whether it is its file's first one."""
    pieces = spark.read.option("lineSep", syntax.separator).text(path).select(
        "value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    ends = pieces.mapInArrow(_ends_of_ranges(syntax), RANGE).collect()  # one row per byte range
    starts = spark.sparkContext.broadcast(starts_of_ranges(ends))
    parts = pieces.mapInArrow(_records(syntax, starts), PARTS)
    whole = parts.where(F.col("kind") == WHOLE).select(F.col("part").alias("record"), "first")
    if len(ends) == len({r["file"] for r in ends}):  # no file has two ranges: what is left over ends a file
        return whole.unionByName(parts.where(F.col("kind") == START).select(F.col("part").alias("record"), "first"))
    order = Window.partitionBy("file").orderBy("block", "kind")  # two rows a range
    number = F.sum((F.col("kind") == START).cast("int")).over(order)
    joined = (parts.where(F.col("kind") != WHOLE).withColumn("number", number).groupBy("file", "number")
              .agg(F.array_sort(F.collect_list(F.struct("block", "kind", "part"))).alias("parts"),
                   F.max("first").alias("first"))
              .select(F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("record"), "first"))
    return whole.unionByName(joined)


def _without_mark(record: Column) -> Column:
    return F.regexp_replace(record, "^\\x{FEFF}", "")


def read_csv_ranges(spark: SparkSession, path: str, schema: T.StructType, options: dict[str, str]) -> DataFrame:
    """CSV with quoted line ends, read by byte ranges. ``options`` are those of
    ``spark.read.csv``; quotes are ``"`` and doubled inside a field, fields are
    parted by commas."""
    text = records(spark, path, Csv)
    if options.get("header", "false").lower() == "true":
        text = text.where(~F.col("first"))
    text = text.select(F.regexp_replace(_without_mark(F.col("record")), "\\r?\\n$", "").alias("record"))
    row = F.from_csv("record", schema.toDDL(), {k: v for k, v in options.items() if k != "header"})
    return text.where(F.length("record") > 0).select(row.alias("row")).select("row.*")


def read_json_array_ranges(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The objects of JSON arrays, read by byte ranges."""
    text = records(spark, path, Json).select(F.regexp_replace("record", "^[^{]*+", "").alias("record"))
    row = F.from_json("record", schema)
    return text.where(F.length("record") > 0).select(row.alias("row")).select("row.*")
