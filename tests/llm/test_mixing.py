from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm import mixing as mx

CELLS = "source string, lang string, topic string, tokens long"


def cells_of(n=60, seed=2, sd=2.0):
    r = np.random.RandomState(seed)
    sums = defaultdict(int)
    for _ in range(n):
        sums[f"s{r.randint(6)}", f"l{r.randint(3)}", f"t{r.randint(3)}"] += int(r.lognormal(6, sd))
    return sorted((*k, v) for k, v in sums.items())


def shares(rows, weights, d):
    out = defaultdict(float)
    for r, w in zip(rows, weights):
        out[r[d]] += w * r[3]
    return {k: v / sum(out.values()) for k, v in out.items()}


def wanted(rows, d, name, targets):
    """Target shares, written anew: named values as given, the others by their damped tokens in what is left."""
    own = defaultdict(float)
    for r in rows:
        own[r[d]] += r[3]
    own = {k: v for k, v in own.items() if v > 0}
    named = targets.get(name, {})
    damped = {k: v ** mx.TEMPERATURE[name] for k, v in own.items() if k not in named}
    left = 1 - sum(named.values())
    want = {k: named[k] if k in named else left * damped[k] / sum(damped.values()) for k in own}
    return {k: v / sum(want.values()) for k, v in want.items()}


@pytest.mark.parametrize("targets", [{}, {"lang": {"l0": 0.2, "l1": 0.5, "l2": 0.3}, "topic": {"t1": 0.4}}, {"source": {"s0": 0.5, "absent": 0.2}}])
def test_margins_meet_their_targets(targets):
    rows = cells_of(400)
    w, gap = mx.rake_driver(rows, targets)
    assert gap < mx.TOLERANCE
    for d, name in enumerate(mx.DIMENSIONS):
        assert shares(rows, w, d) == pytest.approx(wanted(rows, d, name, targets), rel=1e-5)


def test_frame_as_driver(spark):
    rows = cells_of(250) + [("empty", "l0", "t0", 0)]
    df = spark.createDataFrame(rows, CELLS)
    targets = {"lang": {"l0": 0.5, "l1": 0.2}}
    key = lambda r: (r.c_source, r.c_lang, r.c_topic)
    one = {key(r): r for r in mx.cell_probabilities(df, targets=targets, rounds=6, least=1.0).collect()}
    two = {key(r): r for r in mx.cell_probabilities(df, targets=targets, driver_bytes=0, rounds=6, least=1.0).where("c_salt = 3").collect()}
    assert one.keys() == two.keys()
    for k in one:
        assert two[k].weight == pytest.approx(one[k].weight, rel=1e-9) and two[k].probability == pytest.approx(one[k].probability, abs=1e-9)
        assert two[k].gap == pytest.approx(one[k].gap, rel=1e-6) and two[k].probability <= 1


def test_sampled_shares_meet_their_targets(spark):
    """Where cells are taken whole, the others make up for them: expected sampled tokens have the target shares."""
    for seed in (2, 3, 4):
        rows = cells_of(400, seed, 0.5)
        targets = {"lang": {"l0": 0.55, "l1": 0.25, "l2": 0.2}}
        got = {(r.c_source, r.c_lang, r.c_topic): r for r in mx.cell_probabilities(spark.createDataFrame(rows, CELLS), targets=targets, strict=True).collect()}
        p = [got[r[:3]].probability for r in rows]
        assert max(p) > 1 - 1e-9 and min(p) > 0 and got[rows[0][:3]].fraction >= mx.FRACTION * mx.LEAST
        for d, name in enumerate(mx.DIMENSIONS):
            assert shares(rows, p, d) == pytest.approx(wanted(rows, d, name, targets), rel=1e-5)
        assert sum(x * r[3] for x, r in zip(p, rows)) == pytest.approx(got[rows[0][:3]].fraction * sum(r[3] for r in rows), rel=1e-5)


def test_targets_that_contradict_each_other(spark):
    rows = [("a", "x", "t", 100), ("b", "y", "t", 100)]
    targets = {"source": {"a": 0.9, "b": 0.1}, "lang": {"x": 0.1, "y": 0.9}}
    with pytest.warns(UserWarning, match="can't be met"):
        got = mx.cell_probabilities(spark.createDataFrame(rows, CELLS), targets=targets).collect()
    assert all(r.gap > 0.1 and 0 <= r.probability <= 1 for r in got)
    with pytest.raises(ValueError, match="can't be met"):
        mx.cell_probabilities(spark.createDataFrame(rows, CELLS), targets=targets, strict=True)


def test_query_against_raking_written_anew(spark):
    """op8's own weights and probabilities: margins are met with its own targets and rounds, and tokens are counted anew."""
    sf = "/root/testdata/sf0.01"
    out = mx.op8_source_mixing(spark, sf).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    cells = defaultdict(int)
    for r in out:
        assert (r.source, r.lang, r.n_tokens) == (docs[r.doc_id].source, docs[r.doc_id].lang, len((docs[r.doc_id].text or "").encode().split()))
        cells[r.source, r.lang, r.topic] += r.n_tokens
    by_cell = {(r.source, r.lang, r.topic): r for r in out}
    rows = [(*k, v) for k, v in cells.items()]
    weights = [by_cell[k].weight for k in cells]
    for d, name in enumerate(mx.DIMENSIONS):
        assert shares(rows, weights, d) == pytest.approx(wanted(rows, d, name, mx.TARGETS), rel=1e-4)
    c = {round(r.probability / r.weight, 6) for r in out if r.probability < 1}
    assert max(c) - min(c) < 1e-4 and all(r.probability <= 1 and (r.probability < 1 or r.weight * min(c) > 0.999) for r in out)
    sampled = {(r.dimension, r.value): r.sampled for r in mx.shares(mx.mixed(spark.read.parquet(f"{sf}/documents.parquet"))).collect()}
    assert all(sampled["lang", k] == pytest.approx(v, rel=1e-5) for k, v in mx.TARGETS["lang"].items())


def test_calibrated_and_deterministic(spark, sf):
    rows = mx.op8_source_mixing(spark, sf).collect()
    total = sum(r.n_tokens for r in rows)
    assert sum(r.n_tokens * r.probability for r in rows) == pytest.approx(rows[0].fraction * total, rel=1e-5) and mx.FRACTION * mx.LEAST <= rows[0].fraction <= mx.FRACTION and rows[0].gap < mx.TOLERANCE
    for r in rows:
        u = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:8], 16) / 2**32
        assert r.selected == (u < r.probability) or abs(u - r.probability) < 1e-6
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert all(r.n_tokens == len((docs[r.doc_id] or "").encode().split()) for r in rows)


def test_nulls_repeats_and_empty(spark, docs_of):
    docs = spark.createDataFrame([(1, None, None, None, 0), (1, None, None, None, 0), (2, "", "en", None, 0), (None, "a b c", None, "s", 5), (3, "w " * 50000, "en", "s", 9), (4, "x y", "(none)", "(none)", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    for size in (mx.DRIVER_BYTES, 0):
        rows = mx.mixed(docs, driver_bytes=size, rounds=2, least=1.0).collect()
        assert len(rows) == 6 and len({(r.selected, r.probability) for r in rows if r.doc_id == 1}) == 1
        assert {(r.source, r.lang) for r in rows} == {(None, None), (None, "en"), ("s", None), ("s", "en"), ("(none)", "(none)")}
    assert mx.sample_documents(docs).columns == docs.columns
    assert mx.mixed(docs_of([])).collect() == []


def test_clashing_columns(docs_of):
    docs = docs_of(["a b", "c"]).selectExpr("*", "'x' AS weight", "2 AS probability", "'no' AS selected", "3 AS __source", "4 AS topic", "5 AS row", "6 AS tokens", "7 AS n_tokens", "8 AS gap", "1 AS fraction", "9 AS c_salt")
    for size in (mx.DRIVER_BYTES, 0):
        rows = mx.mixed(docs, 1.0, driver_bytes=size, rounds=2, least=1.0).where("selected").select("row.*")
        assert rows.columns == docs.columns and sorted(map(tuple, rows.collect())) == sorted(map(tuple, docs.collect()))
    assert mx.sample_documents(docs).columns == docs.columns
