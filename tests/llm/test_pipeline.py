from __future__ import annotations

import random

import __spark_entry__ as entry
import corpus_pipeline as cp
from tidemark.llm import queries


def test_stages_and_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert 0 < len(rows) <= docs.count()
        docs = spark.createDataFrame(rows, docs.schema)
    last = {tuple(r) for r in cp.STAGES[-1][1](spark, docs, sf).collect()}
    assert last == {tuple(r) for r in cp.run(spark, sf).collect()}
    assert {r[0] for r in last} == {r.doc_id for r in docs.collect()}


def test_stages_on_odd_rows(spark):
    """Nulls in any column, repeats, empty and blank texts, columns with clashing names, and an empty table."""
    def good(k):
        r = random.Random(k)
        return "\n".join(" ".join("".join(r.choice("abdeginorstu") for _ in range(r.randrange(2, 9))) for _ in range(12)) + "." for _ in range(12))

    rows = [(1, good(1)), (2, good(2)), (2, good(2)), (None, good(3)), (None, good(4)), (5, None), (6, ""), (7, " \n "), (8, good(5)), (9, good(5))]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    made = spark.createDataFrame([(i, t, [None, "*", ""][k % 3], None, len(t or "")) for k, (i, t) in enumerate(rows)], schema)
    docs = made.selectExpr("*", "'x' AS weight", "1 AS kept", "'r' AS row", "2 AS key", "3 AS selected", "4 AS __source", "5 AS size", "6 AS salt")
    ids = lambda df: sorted((str(r.doc_id) for r in df.collect()))
    quality, lines, near, mixing, encoding = (f for _, f in cp.STAGES)
    for stage in (quality, lines, near, mixing):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        assert stage(spark, docs.where("false"), "").collect() == []
    assert ids(quality(spark, docs, "")) == ["1", "2", "2", "8", "9", "None", "None"]
    assert ids(lines(spark, docs, "")) == ["1", "2", "2", "5", "6", "7", "8", "None", "None"]
    assert ids(near(spark, docs, "")) == ["1", "2", "2", "5", "6", "7", "8", "None", "None"]
    assert sorted(r.n_tokens > 0 for r in encoding(spark, docs, "").collect()) == [False, False, *[True] * 8]
    assert encoding(spark, docs.where("false"), "").collect() == []


def test_registered():
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 11)} == {k.split("_")[0] for k in names if k.startswith("op")}
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)
    assert set(queries.ORACLE_SQL) == {"op2_chat_perspectives", "op10_line_dedup"}
