"""Small frames for the operator tests; the session is the suite's own."""

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    def make(rows, schema=DOC, parts=3):
        rows = [tuple(r) + (None,) * (5 - len(r)) if schema == DOC else r for r in rows]
        return spark.createDataFrame(rows, schema).repartition(parts)
    return make
