from __future__ import annotations

import random

import numpy as np
import pytest

from tidemark.llm import components as cc
from tidemark.llm import minhash as mh


def sets_of(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if len(words) >= width else frozenset([tuple(words)])


def brute(rows, width, percent=80):
    """Components by union of all pairs; ids are distinct."""
    sets = {i: sets_of(t, width) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed=1):
    r = random.Random(seed)
    word = lambda: r.choice("alpha beta gamma delta eps zeta eta theta iota kappa la mu nu xi om pi rho sig tau ups phi chi psi".split()) + str(r.randrange(30))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(r.randrange(30, 120))]
        for _ in range(r.randrange(1, 12)):
            t = list(base)
            for _ in range(r.randrange(0, 8)):
                t[r.randrange(len(t))] = word()
            texts.append(" ".join(t))
    passage = [word() for _ in range(40)]
    texts += [" ".join(passage + [word() for _ in range(r.randrange(5, 30))]) for _ in range(60)]
    texts += [None, "", " \n\t", "one", "ONE", "one two", "one two", texts[0], texts[0].upper(), "x " * 30000]
    return list(enumerate(texts))


@pytest.mark.parametrize("width", [2, 5])
def test_against_all_pairs(docs_of, monkeypatch, width):
    monkeypatch.setattr(mh, "TILE", 7)
    monkeypatch.setattr(mh, "STRIP", 3)
    rows = corpus()
    want = brute(rows, width)
    got = {r.doc_id: r for r in mh.near_duplicates(docs_of(rows), width=width).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


def test_whole_small_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], 2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in mh.op4_minhash_near_dedup(spark, sf).collect()}
    assert got == want


def test_null_ids_repeated_rows_and_empty_table(docs_of):
    got = sorted(map(tuple, mh.near_duplicates(docs_of([(None, "a b c d e f g"), (3, "a b c d e f g"), (3, "a b c d e f g"), (7, "a b c d e f g")])).collect()), key=repr)
    assert got == sorted([(None, 3, None, True), (3, 3, 3, True), (3, 3, 3, True), (7, 3, 3, False)], key=repr)
    assert mh.near_duplicates(docs_of([])).collect() == []


def test_intersections_in_strips(monkeypatch):
    monkeypatch.setattr(mh, "STRIP_SHINGLES", 5)
    r = np.random.RandomState(0)
    xs = [np.unique(r.randint(0, 40, 12).astype(np.uint64)) for _ in range(6)]
    ys = [np.unique(r.randint(0, 40, 9).astype(np.uint64)) for _ in range(5)]
    assert mh.intersections(xs, ys).tolist() == [[len(set(x) & set(y)) for y in ys] for x in xs]


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (300, 300), (5, 4)]
    got = dict(cc.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 140)}, 200: 200, 201: 200, 202: 200}
    assert cc.components(spark.createDataFrame([], "a long, b long")).collect() == []
