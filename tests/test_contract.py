import os
import subprocess
import sys

import __spark_entry__ as E
from labelforge.plans import ORACLE, QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_oracle_keys_are_queries():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and set(QUERIES) <= set(q)
    assert len(QUERIES) >= 80
    assert set(QUERIES) == set(ORACLE)


def test_query_names_are_descriptive():
    for name in QUERIES:
        assert not name.startswith("op") and "pipeline" not in name


def test_udfs_import_the_package_from_a_foreign_folder(tmp_path):
    """The driver starts elsewhere and its workers do not see the repository:
    the package reaches them as a shipped archive."""
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false")
         .config("spark.executorEnv.PYTHONPATH", "").getOrCreate())
from labelforge.operators import inference as I
from labelforge.session import ensure_checkpoint_dir, ship_package
ensure_checkpoint_dir(spark)
ship_package(spark)
ship_package(spark)
df = spark.createDataFrame([(1, "abc"), (2, "")], "id int, text string")
got = I.classify(df, "text", lambda: lambda texts: texts.str.len() / 100.0).select("id", "int_score").collect()
assert [tuple(r) for r in got] == [(1, 0)], got
print("shipped")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True,
                          timeout=300)
    assert "shipped" in done.stdout, done.stderr[-2000:]


def test_checkpoint_folder_is_required_on_a_cluster():
    import pytest
    from labelforge import session

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Spark:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Spark())
