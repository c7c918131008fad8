from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table with columns beside the usual ones, from texts (ids count from 0) or (id, text) pairs."""

    def make(texts):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        made = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
        return made.selectExpr("*", "'x' AS key", "1 AS value", "'y' AS n", "array(1) AS keys", "'z' AS h1", "0 AS status")

    return make


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
