from __future__ import annotations

import itertools
import re

import numpy as np

from tidemark.llm import outliers as ol

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    lines = text.split("\n")
    dup = sum(bool(WORD.search(x)) and x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def prose(r, n):
    return " ".join("".join(r.choice(list("abcdefgh"), r.randint(2, 9))) for _ in range(n)) + "\n"


def some_texts():
    r = np.random.RandomState(0)
    good = [prose(r, r.randint(60, 400)) for _ in range(150)]
    bad = ["".join(f"{w}{'#$%'[i % 3] * 3} " for i, w in enumerate(prose(r, 120).split())) for _ in range(6)]
    odd = [None, "", " \n", "short text", "a b c a b c " * 40, "x y z w " * 30, "é中 " * 70, "line\nline\n\n\nline\n" * 5, "w" * 50000, prose(r, 40000), "a\x0bb\x0cc\rd " * 20]
    return good + good[:5], bad, odd


def test_statistics_and_base_rules(docs_of):
    good, bad, odd = some_texts()
    texts = good + bad + odd
    got = {r.doc_id: r for r in ol.judge(docs_of(texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = brute(t)
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == want, t
        assert got[i].base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (got[i].base_failed and got[i].kept)
    assert all(got[i].kept for i in range(len(good)))
    assert not any(got[len(good) + i].kept for i in range(len(bad)))


def rows_of(spark, x, g=1):
    return spark.createDataFrame([(g, *map(float, np.round(v * ol.GRID) / ol.GRID)) for v in x], "g long, " + ", ".join(f"{f} double" for f in ol.FEATURES))


def test_mcd_resists_a_third_of_outliers(spark):
    r = np.random.RandomState(1)
    k = len(ol.FEATURES)
    clean = r.randn(2000, k) * 0.8 + 2
    far = r.randn(900, k) * 0.1 + 9
    (est,) = ol.mcd(rows_of(spark, np.vstack([clean, far]))).collect()
    assert np.abs(np.array(est.m) - 2).max() < 0.15
    cov = np.linalg.inv(np.array(est.inv).reshape(k, k)) - np.diag(np.square(ol.FLOOR))
    assert 0.4 < np.diag(cov).min() and np.diag(cov).max() < 1.3
    d = np.array([(x - est.m) @ np.array(est.inv).reshape(k, k) @ (x - est.m) for x in far])
    assert d.min() > ol.CUTOFF


def covariance(x, scale=1.0):
    cov = np.cov(x.T, bias=True) * scale
    return x.mean(0), cov + np.diag(np.maximum(np.square(ol.LEAST) - np.diag(cov), 0) + np.square(ol.FLOOR))


def test_determinant_among_all_halves(spark):
    """On a small group: under one in a hundred of all halves of the rows has a covariance of smaller determinant than the one that is found."""
    r = np.random.RandomState(0)
    x = np.vstack([r.randn(11, 5) @ r.randn(5, 5) * 2, r.randn(5, 5) * 3 + 40])
    x = np.round(x * ol.GRID) / ol.GRID
    (est,) = ol.mcd(rows_of(spark, x), raw=True).collect()
    halves = [covariance(x[list(c)], ol.CONSISTENCY) for c in itertools.combinations(range(16), 8)]
    dets = np.array([np.linalg.slogdet(cov)[1] for _, cov in halves])
    assert est.n == 8 and np.abs(dets - est.logdet).min() < 1e-9 and np.mean(dets < est.logdet - 1e-9) < 0.01
    assert np.allclose(halves[np.abs(dets - est.logdet).argmin()][0], est.m) and max(est.m) < 20


def fast_mcd(x, seed=0, starts=200):
    """Random subsets, concentration steps to the end, least determinant, reweighting: in numpy, on one group."""
    r, best = np.random.RandomState(seed), None
    h = -(-len(x) // 2)
    far = lambda e, y: np.einsum("ni,ij,nj->n", y - e[0], np.linalg.inv(e[1]), y - e[0])
    for _ in range(starts):
        e, last = covariance(x[r.choice(len(x), 12, replace=False)]), np.inf
        while True:
            e = covariance(x[np.argsort(far(e, x), kind="stable")[:h]], ol.CONSISTENCY)
            det = np.linalg.slogdet(e[1])[1]
            if det >= last - 1e-9:
                break
            last = det
        if best is None or last < best[0]:
            best = (last, e)
    e = best[1]
    for _ in range(ol.REWEIGHTS):
        e = covariance(x[far(e, x) <= ol.FAR])
    return lambda y: far(e, y)


def test_distances_are_those_of_a_separate_implementation(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in ol.judge(docs).collect()}
    groups = {}
    for r in docs.select("doc_id", "lang", "source").collect():
        if not got[r.doc_id].base_failed:
            groups.setdefault((r.lang, r.source), []).append(r.doc_id)
    large = sorted((len(v), k, v) for k, v in groups.items() if len(v) >= ol.MIN_GROUP)
    for _, _, ids in [large[0], large[-1], large[len(large) // 2]]:
        n = np.array([[getattr(got[i], c) for c in ol.STAT_NAMES] for i in ids], float)
        words = np.maximum(n[:, 0], 1)
        x = np.stack([np.log(words), np.log(np.maximum(n[:, 1], 1) / words), np.log1p(100 * n[:, 2] / words), np.log1p(n[:, 3]), np.log1p(100 * n[:, 4] / words)], 1)
        x = np.round(x * ol.GRID) / ol.GRID
        want, have = fast_mcd(x)(x), np.array([got[i].distance for i in ids])
        assert np.median(np.abs(have - want) / (1 + want)) < 0.05
        assert np.mean((have <= ol.CUTOFF) == (want <= ol.CUTOFF)) > 0.99
        assert all(got[i].kept == (got[i].distance <= ol.CUTOFF) for i in ids)


def test_single_statistics_reject(docs_of):
    r = np.random.RandomState(5)
    good = [prose(r, r.randint(100, 400)) for _ in range(200)]
    words = prose(r, 200).split()
    long_words = " ".join(w + w[: len(w) // 2] for w in words)
    lines = "".join(f"{w}{i}\nx\n" for i, w in enumerate(words[:30]))
    unique = [f"{w}{i}" for i, w in enumerate(words)]
    repeats = " ".join(unique[:104] + unique[:48] + unique[104:152])
    got = {x.doc_id: x for x in ol.judge(docs_of([*good, long_words, lines, repeats])).collect()}
    assert np.mean([got[i].kept for i in range(200)]) >= 0.99
    assert (got[201].n_dup_lines, got[201].n_repeat_words) == (29, 0) and got[202].n_repeat_words == 96
    assert not any(got[i].base_failed or got[i].kept for i in (200, 201, 202))


def test_quality_labels(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in ol.op9_quality_rules(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    passed = [i for i in labels if not got[i].base_failed]
    assert np.mean([got[i].kept for i in passed if labels[i]]) >= 0.999
    assert np.mean([got[i].kept for i in labels if not labels[i]]) <= 0.01


def test_kept_rows_nulls_and_empty(spark, docs_of):
    r = np.random.RandomState(3)
    good = prose(r, 200)
    docs = docs_of([(None, good), (1, good), (1, good), (2, "short")])
    kept = ol.keep_good(docs)
    assert kept.columns == docs.columns and sorted((x.doc_id for x in kept.collect()), key=str) == [1, 1, None]
    assert ol.judge(docs_of([])).collect() == [] and ol.keep_good(docs_of([])).collect() == []
    nulls = spark.createDataFrame([(1, good, None, None), (2, None, None, None)], "doc_id long, text string, lang string, source string")
    assert {x.doc_id: x.kept for x in ol.judge(nulls).collect()} == {1: True, 2: False}


def test_groups_of_any_name(spark):
    """Languages and sources named *, empty or null are groups like others, each judged by its own."""
    r = np.random.RandomState(6)
    bad = "".join(f"{w}{'#$%'[i % 3] * 3} " for i, w in enumerate(prose(r, 120).split()))
    short, long = [prose(r, r.randint(60, 200)) for _ in range(60)], [prose(r, r.randint(2000, 2400)) for _ in range(60)]
    made = [(lang, source, t) for lang, source, texts in (("*", "*", short), (None, "s", short), ("", "s", long)) for t in texts] + [(lang, source, bad) for lang, source in (("*", "*"), (None, "s"), ("", "s"))]
    docs = spark.createDataFrame([(i, *row) for i, row in enumerate(made)], "doc_id long, lang string, source string, text string")
    got = {x.doc_id: x for x in ol.judge(docs).collect()}
    assert all(got[i].kept and got[i].distance is not None for i in range(180)) and not any(got[i].kept or got[i].base_failed for i in range(180, 183))
    swapped = docs.selectExpr("doc_id", "CASE WHEN doc_id = 61 THEN '' ELSE lang END AS lang", "source", "text")
    assert [x.kept for x in ol.judge(swapped).where("doc_id = 61").collect()] == [False]


def test_clashing_columns(spark, docs_of):
    r = np.random.RandomState(7)
    docs = docs_of([prose(r, 200), "short"]).selectExpr("*", "1 AS stats", "2 AS kept", "'x' AS own", "3 AS g", "4 AS row", "5 AS distance")
    kept = ol.keep_good(docs)
    assert kept.columns == docs.columns and [tuple(x) for x in kept.collect()] == [tuple(x) for x in docs.where("doc_id = 0").collect()]


def test_each_row_goes_by_its_own_verdict(docs_of):
    r = np.random.RandomState(4)
    good = [prose(r, 200) for _ in range(4)]
    docs = docs_of([(None, good[0]), (None, "short"), (None, good[1]), (None, None), (7, good[2]), (7, "short"), (8, good[3]), (8, good[3])])
    kept = ol.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(((x.doc_id, x.text) for x in kept.collect()), key=repr) == sorted([(None, good[0]), (None, good[1]), (7, good[2]), (8, good[3]), (8, good[3])], key=repr)
