from __future__ import annotations

import itertools
import random
import zlib

import pytest

from tidemark.llm import toxicity as tx


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in tx.op7_toxicity(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in got.items())
    held = [(labels[i], r.predicted) for i, r in got.items() if r.held_out and i in labels]
    hits = sum(t and p for t, p in held)
    assert hits / sum(p for _, p in held) >= 0.97 and hits / sum(t for t, _ in held) >= 0.8


def test_grammar_scores_clauses():
    g = tx.Grammar({"idio": 4.0}, {"scum": 3.0}, (-4.0, 1.0, 1.0, 1.0))
    raw = lambda text: g.evidence(text, {})[0]
    assert raw("a fine day") == 0
    assert raw("you idiots") > raw("the idiots") > raw("they are not idiots") > 0
    assert raw("he said idiots") < raw("the idiots")
    assert raw("not here. idiots") == raw("idiots")
    assert raw("you, kill them") > 0
    assert g.score(g.evidence("scum " * 9, {})) > g.score(g.evidence("scum", {})) > g.score(g.evidence(None, {})) == g.score(g.evidence("", {}))


def test_threats_meet_targets_on_either_side():
    g = tx.Grammar({}, {})
    raw = lambda text: g.evidence(text, {})[0]
    for text in ("I will kill you", "we hurt you", "you, kill them", "they killed your dog", "ich töte dich", "wir haben dich umgebracht", "je te tuerai", "on vous frappe", "voy a matarte", "os mataré a ti"):
        assert raw(text) > 0, text
    assert raw("I will kill you") == raw("you I will kill") > raw("I will not kill you") > 0
    assert raw("he said I will kill you") < raw("I will kill you")
    assert raw("they kill time") == raw("they kill. you rest") == 0
    assert raw("kill and burn you") > raw("kill you")


def all_paths(edges, i=0):
    """Every way through a lattice, as its edges' (symbol, magnitude)."""
    if i == len(edges):
        yield ()
        return
    for to, symbol, magnitude in edges[i]:
        for rest in all_paths(edges, to):
            yield ((symbol, magnitude), *rest)


def all_runs(machine, symbols, state=0):
    """Every accepted run of one transducer over symbols: (symbols written, weights)."""
    if not symbols:
        if state in machine.finals:
            yield (), ()
        return
    for written, weight, then in machine.arcs.get((state, symbols[0]), ()):
        for more, weights in all_runs(machine, symbols[1:], then):
            yield (written, *more), (weight, *weights)


def brute(edges):
    """The best path by enumeration: each layer run by itself on what the one before writes, nothing composed."""
    best = 0.0
    for path in all_paths(edges):
        runs = [(tuple(s for s, _ in path), 0.0)]
        for layer in tx.layers():
            runs = [(out, total + sum(w * m for w, (_, m) in zip(weights, path))) for symbols, total in runs for out, weights in all_runs(layer, symbols)]
        best = max(best, max((total for _, total in runs), default=0.0))
    return best


def test_composition_against_enumerated_paths():
    r = random.Random(2)
    for _ in range(300):
        n = r.randrange(1, 6)
        edges = [[(i + 1, r.choice(tx.CLASSES), r.choice([1.0, 2.0, 3.5]))] for i in range(n)]
        for i in range(n):
            if r.random() < 0.3:
                edges[i].append((r.randrange(i + 1, n + 1), r.choice(tx.CLASSES), 2.5))
        assert tx.best_path(tx.MACHINE, edges) == pytest.approx(brute(edges))
    assert len({s for s, _ in tx.MACHINE.arcs}) == 24 and tx.best_path(tx.MACHINE, []) == 0


def test_marks_by_hand():
    """The rules said another way: of one path without guesses, what each class weighs."""
    one = lambda *classes: tx.best_path(tx.MACHINE, [[(i + 1, c, 1.0)] for i, c in enumerate(classes)])
    for before, negated, reported, behind in itertools.product([False, True], repeat=4):
        words = ["report"] * reported + ["negation"] * negated + ["target"] * before
        factor = (tx.NEGATED if negated else 1) * (tx.REPORTED if reported else 1)
        aimed = before or behind
        assert one(*words, "insult", *["target"] * behind) == pytest.approx(factor * (tx.AIMED if aimed else 1))
        assert one(*words, "threat", *["target"] * behind) == pytest.approx(factor * (tx.AIMED if aimed else 0))
        assert one(*words, "bound") == pytest.approx(factor * tx.AIMED)
    assert one("negation", "other", "other", "other", "insult") == 1


def test_patterns_and_spellings():
    g = tx.Grammar({"idio": 4.0}, {"scum": 3.0})
    raw = lambda text: g.evidence(text, {})[0]
    assert raw("we hunt you down") == raw("I will kill you") and raw("we hunt the deer down") == 0
    assert raw("such a piece of trash") == raw("the scum") > 0
    assert raw("you s c u m") == raw("you scuuuum") == raw("you scum") and raw("a b c d") == 0
    assert raw("IDIOOOTS") == raw("idiots")


def test_rows_nulls_and_no_labels(spark, docs_of):
    docs = docs_of([(None, "you fool"), (1, None), (1, None), (2, ""), (3, "fool " * 40000)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    grammar = tx.fit(docs, none)
    rows = tx.score(docs, grammar).collect()
    assert len(rows) == 5 and not any(r.predicted for r in rows)
    assert [r.held_out for r in rows if r.doc_id is None] == [False]
    assert tx.score(docs_of([]), grammar).collect() == []


def test_bounded_fit_rows(spark, docs_of):
    docs = docs_of([f"text {i}" for i in range(600)])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(600)] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    used = [r.doc_id for r in tx.fit_rows(docs, labels, 100).collect()]
    twice = [r.doc_id for r in tx.fit_rows(docs.unionByName(docs).unionByName(docs), labels, 100).collect()]
    assert sorted(twice) == sorted(used)
    assert 50 < len(used) < 150 and all(zlib.crc32(str(i).encode()) % 3 != 1 for i in used)
