import json
import random

import pytest
from pyspark.sql import types as T

from labelforge.session import scratch_path
from labelforge.sources import io as IO
from labelforge.sources import ranges as RG
from labelforge.sources.tables import documents
from tests.conftest import SMALL

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("note", T.StringType())])


@pytest.fixture
def split_at(spark):
    """Byte ranges of the given size while the test runs."""
    key, open_cost = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    before = {k: spark.conf.get(k) for k in (key, open_cost)}

    def at(size):
        spark.conf.set(key, str(size))
        spark.conf.set(open_cost, "1")
    yield at
    for k, v in before.items():
        spark.conf.set(k, v)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def odd_texts(seed, n):
    r = random.Random(seed)
    parts = ['"', '""', "\n", "\r\n", ",", ' "x" ', "a", "é漢", "\n\n", '",\n"', "{", "}", "[", "]", "\\", '\\"', " "]
    return [(i, "x" + "".join(r.choice(parts) for _ in range(r.randrange(12))) + "y", r.choice([None, "n", "q,q"]))
            for i in range(n)]


@pytest.mark.parametrize("size", [37, 64, 211, 1 << 20])
def test_csv_ranges_equal_the_one_task_reader(spark, tmp_path, split_at, size):
    rows = odd_texts(size, 120)
    quoted = lambda v: "" if v is None else '"' + str(v).replace('"', '""') + '"'
    body = "id,text,note\n" + "".join(f"{i},{quoted(t)},{quoted(n)}\n" for i, t, n in rows)
    (tmp_path / "one.csv").write_bytes(body.encode())
    split_at(size)
    got = IO.read_csv(spark, str(tmp_path), SCHEMA, by_ranges=True)
    assert rows_of(got) == rows_of(IO.read_csv(spark, str(tmp_path), SCHEMA)) == sorted(rows, key=str)
    if size < 1 << 20:
        tasks = spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions()
        assert tasks > len(body.encode()) / size / 2  # one file, many tasks


@pytest.mark.parametrize("size", [16, 1 << 20])
def test_csv_odd_files(spark, tmp_path, split_at, size):
    split_at(size)
    files = {"bom.csv": "﻿id,text,note\n1,a,b\n", "empty.csv": "", "header.csv": "id,text,note", "no_end.csv": 'id,text,note\n2,"x\ny",z',
             "crlf.csv": 'id,text,note\r\n3,"p\r\nq",r\r\n\r\n4,s,t\r\n', "quote_inside.csv": 'id,text,note\n5,a"b,c\n6,"d",e\n',
             "long_header.csv": '"id","te\nxt","note\n of many\n lines"\n7,f,g\n8,,"long ' + "record " * 30 + '"\n'}
    for name, body in files.items():
        (tmp_path / name).write_bytes(body.encode())
    want = [(1, "a", "b"), (2, "x\ny", "z"), (3, "p\r\nq", "r"), (4, "s", "t"), (5, 'a"b', "c"), (6, "d", "e"),
            (7, "f", "g"), (8, None, "long " + "record " * 30)]
    assert rows_of(IO.read_csv(spark, str(tmp_path), SCHEMA, by_ranges=True)) == sorted(want, key=str)


@pytest.mark.parametrize("size", [23, 150, 1 << 20])
@pytest.mark.parametrize("indent", [None, 2])
def test_json_ranges_equal_the_one_task_reader(spark, tmp_path, split_at, size, indent):
    rows = odd_texts(size + 1, 80)
    nested = T.StructType(SCHEMA.fields + [T.StructField("inner", T.StructType([T.StructField("a", T.ArrayType(T.LongType()))]))])
    recs = [{"id": i, "text": t, "note": n, "inner": {"a": [i, 2], "deep": {"b": {}}}} for i, t, n in rows]
    (tmp_path / "one.json").write_text(json.dumps(recs, ensure_ascii=False, indent=indent), encoding="utf-8")
    split_at(size)
    got = IO.read_json_array(spark, str(tmp_path), nested, by_ranges=True).collect()
    assert sorted((r["id"], r["text"], r["note"], r["inner"]["a"]) for r in got) == [(i, t, n, [i, 2]) for i, t, n in rows]


def test_json_odd_files(spark, tmp_path, split_at):
    split_at(16)
    files = {"empty.json": "", "none.json": " [ ] \n", "lines.json": '{"id": 1, "text": "a}"}\n{"id": 2}\n', "one.json": '{"id": 3, "note": "[{"}',
             "mixed.json": '[1, null, {"id": 4}, "x{", {"id": 5}]'}
    for name, body in files.items():
        (tmp_path / name).write_text(body)
    got = rows_of(IO.read_json_array(spark, str(tmp_path), SCHEMA, by_ranges=True).select("id", "text", "note"))
    assert [g[0] for g in got if g[0] != 5][:4] == [1, 2, 3, 4]
    assert ("a}", "[{") == (got[0][1], got[2][2])


def test_states_compose():
    """A range's function from state to state is that of its pieces in a row."""
    r = random.Random(3)
    for syntax in (RG.Csv, RG.Json):
        text = "".join(r.choice('ab",{}\n\\') for _ in range(3000))
        pieces = text.split(syntax.separator)
        for _ in range(30):
            cut = r.randrange(len(pieces))
            for start in (False, True):
                ends = []
                for part in (pieces[:cut], pieces[cut:]):
                    inside, opened = start if not ends else ends[-1][0], 0
                    for p in part:
                        inside, k = syntax.step(p, inside)
                        opened += k
                    ends.append((inside, opened))
                whole, total = start, 0
                for p in pieces:
                    whole, k = syntax.step(p, whole)
                    total += k
                assert (whole, total) == (ends[1][0], ends[0][1] + ends[1][1])


def test_whole_table_through_one_file(spark, split_at):
    d = documents(spark, SMALL)
    path = scratch_path(spark, "one-csv")
    IO.write_csv(d.coalesce(1), path)
    split_at(20_000)
    assert rows_of(IO.read_csv(spark, path, d.schema, by_ranges=True)) == rows_of(d)
