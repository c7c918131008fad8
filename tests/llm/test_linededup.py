from __future__ import annotations

import random

from tidemark.llm import linededup as ld


def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, least=1, long=2):
    lines = sorted({(i, t, n, x) for i, t in rows for n, x in enumerate((t or "").split("\n")) if t is not None and len(x) >= least and x.strip(" \t\n\v\f\r")}, key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    first = {}
    for i, _, n, x in lines:
        first.setdefault(x, (i, n))
    order = {p: k for k, p in enumerate(sorted(set(first.values()), key=lambda p: (p[0] is not None, p[0] or 0, p[1])))}
    out = []
    texts = list(first)
    earlier = {x: min((first[y] for y in texts if y != x and min(len(x), len(y)) >= long and order[first[y]] < order[first[x]] and near(x, y)), key=lambda p: order[p], default=None) for x in texts}
    for i, t in rows:
        for n, x in enumerate((t or "").split("\n")):
            if t is not None and len(x) >= least and x.strip(" \t\n\v\f\r"):
                of = earlier[x] or (first[x] if (i, n) != first[x] else None)
                out.append((i, n, of is None, *(of or (None, None))))
    return sorted(out, key=repr)


def corpus(seed=0):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdeé 中") for _ in range(r.randrange(18, 60))) for _ in range(25)]

    def edit(x, n):
        for _ in range(n):
            p = r.randrange(len(x))
            x = r.choice([x[:p] + x[p + 1 :], x[:p] + "z" + x[p + 1 :], x[:p] + "y" + x[p:]])
        return x

    docs = ["\n".join(edit(r.choice(base), r.choice([0, 0, 1, 1, 2, 3])) for _ in range(r.randrange(1, 9))) for _ in range(60)]
    counter = ["\n".join(f"the page number is {i:04d} of many" for i in range(120))]
    return list(enumerate([*docs, *counter, None, "", "\n\n", docs[0], "q" * 40, "q" * 41, "q" * 42, "long line " * 9000, "short", "short\nshors\nab\nac\nabc\nb\nshor\n \t\n\nx\nx", "a" * 18 + "b", "a" * 19 + "b", "a" * 20 + "b"]))


def test_against_all_pairs(docs_of):
    rows = corpus()
    got = sorted((tuple(r) for r in ld.near_lines(docs_of(rows)).drop("text_key").collect()), key=repr)
    assert got == brute(rows)


def test_shuffled_joins_give_the_same(docs_of, monkeypatch):
    from tidemark.llm import common

    rows = corpus(5)
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    assert sorted((tuple(r) for r in ld.near_lines(docs_of(rows)).drop("text_key").collect()), key=repr) == brute(rows)


def test_bounds_are_parameters(docs_of):
    rows = corpus(6)
    for least, long in ((1, 1), (20, 30)):
        got = sorted((tuple(r) for r in ld.near_lines(docs_of(rows), least, long).drop("text_key").collect()), key=repr)
        assert got == brute(rows, least, long)


def test_short_lines_meet(docs_of):
    """No length switches the bound off: lines of 19 letters, of three and of two, one letter apart."""
    rows = list(enumerate(["a line of 19 letter", "a line of 18 letter", "abc", "abd", "xy", "xz", "p", "q", "pq"]))
    got = {r.doc_id: (r.kept, r.of_doc) for r in ld.near_lines(docs_of(rows)).collect()}
    assert got == {0: (True, None), 1: (False, 0), 2: (True, None), 3: (False, 2), 4: (True, None), 5: (False, 4), 6: (True, None), 7: (True, None), 8: (True, None)}


def test_very_long_lines(docs_of):
    """Work grows far less than with the square of a line's length: lines of 40,000 and 150,000 letters, with an edit anywhere."""
    r = random.Random(1)
    for n in (40_000, 150_000):
        x = "".join(r.choice("abcdefgh") for _ in range(n))
        p = r.randrange(n)
        rows = list(enumerate([x, x[:p] + "z" + x[p + 1 :], x[:p] + x[p + 1 :], "z" + x, x + "z", x[:p] + "zz" + x[p + 2 :]]))
        assert [tuple(r)[2:] for r in ld.near_lines(docs_of(rows)).drop("text_key").orderBy("doc_id").collect()] == [(True, None, None), (False, 0, 0), (False, 0, 0), (False, 0, 0), (False, 0, 0), (False, 1, 0)]


def test_texts_are_rebuilt(docs_of):
    one, two = "a line of over twenty letters", "another line of over twenty letters"
    docs = docs_of([(1, f"{one}\nx\n{two}"), (2, f"x\n{one}!\n\n y"), (3, two), (3, f"\n{one}\n "), (4, None), (5, "tiny"), (3, two), (6, "")])
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in ld.drop_lines(docs).collect()), key=repr)
    assert got == [(1, f"{one}\nx\n{two}", len(one) + len(two) + 3), (2, "\n y", 3), (4, None, 0), (5, "tiny", 4), (6, "", 0)]
    assert ld.drop_lines(docs).columns == docs.columns


def test_many_lines_of_one_document(docs_of):
    """A document of many lines, all of which but one are equal: it is rebuilt in proportion to their number."""
    text = "\n".join(["same"] * 100_000 + ["last"])
    assert [r.text for r in ld.drop_lines(docs_of([text])).collect()] == ["same\nlast"]


def test_null_ids_repeats_and_empty(docs_of):
    line = "the same line in all of these"
    got = sorted(map(tuple, ld.near_lines(docs_of([(None, line), (4, line), (4, line)])).drop("text_key").collect()), key=repr)
    assert got == sorted([(None, 0, True, None, None), (4, 0, False, None, 0), (4, 0, False, None, 0)], key=repr)
    assert [r.kept for r in ld.near_lines(docs_of([(4, line), (4, line)])).collect()] == [True, True]
    assert ld.near_lines(docs_of([])).collect() == [] and ld.drop_lines(docs_of([])).collect() == []


def test_native_plan(docs_of):
    assert not any(x in ld.near_lines(docs_of(["x" * 30]))._jdf.queryExecution().toString() for x in ("Python", "Pandas", "Arrow"))
