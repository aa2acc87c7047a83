import json

import pytest
from pyspark.sql import types as T

from labelforge.session import scratch_path
from labelforge.sources import io as IO


def test_json_array_file(spark, tmp_path):
    recs = [{"id": "a", "text": "x", "original_label": "['None' 'Good']", "our_label": "Good"},
            {"id": "b", "text": "y\nz", "original_label": "['Basic']", "our_label": "❗ Problematic Content ❗"}]
    p = tmp_path / "annotations_tester.json"
    p.write_text(json.dumps(recs, ensure_ascii=False), encoding="utf-8")
    schema = T.StructType([T.StructField(k, T.StringType()) for k in recs[0]])
    got = IO.read_json_array(spark, str(p), schema).orderBy("id").collect()
    assert [r.asDict() for r in got] == recs


def test_csv_keeps_whitespace_quotes_newlines_and_none_string(spark):
    rows = [(1, '  lead and trail  '), (2, 'say "hi"\nnext line'), (3, "None"), (4, "")]
    df = spark.createDataFrame(rows, "id long, text string")
    path = scratch_path(spark, "csvtest")
    IO.write_csv(df, path)
    back = IO.read_csv(spark, path, df.schema).orderBy("id").collect()
    # an empty field reads back as null, as pandas read_csv does; "None" stays text
    assert [tuple(r) for r in back] == rows[:3] + [(4, None)]


def test_read_or_empty(spark):
    schema = T.StructType([T.StructField("text", T.StringType())])
    assert IO.read_or_empty(spark, "/nonexistent/labelforge/x", schema).count() == 0


def test_skip_long_rows_is_quote_aware(spark, tmp_path):
    p = tmp_path / "bad.csv"
    p.write_text('id,text\n1,"a, b, c"\n2,plain,extra\n3\n4,"multi\nline, with comma"\n5,\n', encoding="utf-8")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType())])
    got = sorted(tuple(r) for r in IO.read_csv_skip_long_rows(spark, str(p), schema).collect())
    assert got == [(1, "a, b, c"), (3, None), (4, "multi\nline, with comma"), (5, None)]


def test_surplus_field_that_is_empty_drops_the_row(spark, tmp_path):
    p = tmp_path / "empty.csv"
    p.write_text('id,a,b\n1,x,y\n2,x,y,\n3,x,y,,\n4,x\n5,"p,q",\n6,"u ""v"", w",z\n', encoding="utf-8")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("a", T.StringType()),
                           T.StructField("b", T.StringType())])
    got = sorted(tuple(r) for r in IO.read_csv_skip_long_rows(spark, str(p), schema).collect())
    assert got == [(1, "x", "y"), (4, "x", None), (5, "p,q", None), (6, 'u "v", w', "z")]


def test_natural_outer_merge_matches_null_keys(spark):
    from labelforge.operators.joins import natural_outer_merge
    a = spark.createDataFrame([(1, "x", 10), (None, "y", 20), (3, None, 30)], "id int, text string, a int")
    b = spark.createDataFrame([(1, "x", 1.5), (None, "y", 2.5), (4, "w", 3.5)], "id int, text string, b double")
    got = sorted((tuple(r) for r in natural_outer_merge([a, b]).collect()), key=repr)
    assert got == sorted([(1, "x", 10, 1.5), (None, "y", 20, 2.5), (3, None, 30, None), (4, "w", None, 3.5)], key=repr)


def test_partitioned_layout_prunes_directories(spark):
    from labelforge.sources.tables import documents
    from tests.conftest import SMALL
    path = scratch_path(spark, "layout")
    IO.write_partitioned(documents(spark, SMALL), path, ["lang"])
    sub = IO.read_subset(spark, path, lang="fr")
    plan = sub._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(lang" in plan and "(lang" in plan
    assert sub.count() == documents(spark, SMALL).filter("lang = 'fr'").count()
