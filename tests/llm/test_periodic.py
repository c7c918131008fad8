from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from tidemark.llm import periodic as pr


def brute(words, least=24, times=3):
    """All runs, lag by lag and word by word."""
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            smaller = any(all(words[k] == words[k + d] for k in range(i, i + length - d)) for d in range(1, q))
            if length >= max(least, times * q) and not smaller:
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def contract(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *four, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def sequences():
    r = random.Random(4)
    for _ in range(300):
        out = []
        for _ in range(r.randrange(1, 5)):
            root = [r.randrange(r.choice([1, 2, 3, 50])) for _ in range(r.randrange(1, 20))]
            out += (root * 12)[: r.randrange(1, len(root) * 9)] + [r.randrange(60) for _ in range(r.randrange(6))]
        yield out
    yield from ([0] * 500, [0, 1] * 100 + [0] * 100, [], [3], [0] * 23, [0] * 24, [0] * 25 + [1] + [0] * 25, list(range(8)) * 3, list(range(9)) * 3, list(range(8)) * 3 + [7])
    yield [*range(40), *range(40), *range(40)] * 2 + [*range(30)]
    yield ([0] * 40 + [1]) * 4 + [*range(100)]


def test_against_every_lag():
    for ids in sequences():
        assert pr.find_runs(np.array(ids, np.int64)) == brute(ids), ids


def test_other_bounds():
    for ids in list(sequences())[:80]:
        assert pr.find_runs(np.array(ids, np.int64), 6, 4) == brute(ids, 6, 4), ids
    with pytest.raises(ValueError):
        pr.find_runs(np.zeros(3, np.int64), 3, 2)


def test_long_texts():
    """Half a million words: one word throughout, a word with gaps, a long period, and none."""
    n, r = 500_000, np.random.default_rng(1)
    began = time.time()
    assert pr.find_runs(np.zeros(n, np.int64)) == [(0, n, 1)]
    gaps = np.zeros(n, np.int64)
    gaps[::1000] = np.arange(1, 501)
    assert len(pr.find_runs(gaps)) == 500
    root = r.integers(0, 50_000, 150_001)
    assert pr.find_runs(np.concatenate([root, root, root])) == [(0, 450_003, 150_001)]
    assert pr.find_runs(r.integers(0, 50_000, n)) == []
    assert time.time() - began < 60


def test_rows(docs_of):
    """Nulls, blank texts, repeated rows and ids; many ids, so that some texts are made periodic."""
    r = random.Random(8)
    texts = ["", None, " \n\t", "one", "a " * 200, "a b\n" * 30, "x y z " * 9 + "a b c d " * 20, *(" ".join(r.choice("abcdefgh") * r.randrange(1, 3) for _ in range(r.randrange(90))) for _ in range(120))]
    rows = [*enumerate(texts), (3, "one"), (None, "a " * 50), (None, None)]
    got = pr.planted(docs_of(rows))
    found = pr.periodic_runs(got)
    assert found.columns == ["doc_id", "n_words", "runs", "collapsed"] and found.count() == len(rows)
    assert pr.periodic_runs(docs_of([])).collect() == []
    assert {r.doc_id: r.collapsed for r in pr.periodic_runs(docs_of([(1, "a b " * 20), (2, "c a b")])).collect()} == {1: "a b", 2: "c a b"}


def test_query_is_the_contract(spark, docs_of, tmp_path):
    """Every document of the small table against loops over each lag (texts of up to 600 words), and all of them by count."""
    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {r.doc_id: r for r in pr.op12_periodic_runs(spark, folder).collect()}
    assert got.keys() == docs.keys()
    short = {i: t for i, t in docs.items() if len((t or "").split()) <= 600}
    assert len(short) > 100 and sum(got[i].n_runs for i in short) > 5
    for i, text in short.items():
        assert tuple(got[i][c] for c in COLUMNS) == contract(i, text), i
    made = docs_of([(i, "p q r s t u v w " * (i % 7) + "end") for i in range(200)])
    made.write.parquet(f"{tmp_path}/documents.parquet")
    for r in pr.op12_periodic_runs(spark, str(tmp_path)).collect():
        assert tuple(r[c] for c in COLUMNS) == contract(r.doc_id, "p q r s t u v w " * (r.doc_id % 7) + "end")
