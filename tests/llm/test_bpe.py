from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
import regex
import tiktoken

from tidemark.llm import bpe

VOCABULARIES = ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"]


def library(name):
    return tiktoken.Encoding("test", pat_str=bpe.pattern(), mergeable_ranks=bpe.load_ranks(name), special_tokens={})


def texts():
    r = random.Random(4)
    letters = "aaaabcdeé ß中文  \n\t  '12_.😀"
    made = ["".join(r.choice(letters) for _ in range(r.randrange(80))) for _ in range(150)]
    return [None, "", " ", "\n\n  x", "it's we'll", "<|endoftext|> a", "a" * 300, "ab" * 200, "word " * 20000, *made, *made[:5], "\x00\x7f", "é" * 9]


@pytest.mark.parametrize("name", VOCABULARIES)
def test_as_the_library(docs_of, name):
    e, all_texts = library(name), texts()
    got = {r.doc_id: r for r in bpe.encode_decode(docs_of(all_texts), name, with_ids=True, block_chars=900, most_words=150).collect()}
    assert len(got) == len(all_texts)
    for i, t in enumerate(all_texts):
        ids = e.encode_ordinary(t or "")
        assert got[i].ids == ids, t
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert bytes(got[i].decoded) == (t or "").encode() and got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_long_words(docs_of):
    """Words beyond a window: letters at random, repeats, and 200,000 letters without a space."""
    r = random.Random(7)
    e = library(VOCABULARIES[0])
    made = ["".join(r.choice("etaoinshrdlu") for _ in range(n)) for n in (60, 63, 64, 65, 95, 96, 97, 128, 129, 500, 2000, 200_000)]
    made += [x * n for x in ("a", "ab", "abc", "the", "é", "中文", "ACGT", "-=") for n in (33, 64, 700)]
    got = {x.doc_id: x.ids for x in bpe.encode_decode(docs_of(made), with_ids=True).collect()}
    assert all(got[i] == e.encode_ordinary(t) for i, t in enumerate(made))


def test_windows_splice_or_merge_whole():
    """Spliced windows and the heap give what the library gives, whether neighbours share tokens or not."""
    r, name = random.Random(8), VOCABULARIES[0]
    ranks, e = bpe.load_ranks(name), library(name)
    pieces = list(ranks)
    size = np.array([len(p) for p in pieces])
    for k in range(300):
        letters = r.choice(["ab", "=", "etaoin shrdlu", "0123456789", "éüß"]).replace(" ", "")
        raw = "".join(r.choice(letters) for _ in range(r.randrange(65, 400))).encode()
        want = e._encode_single_piece(raw)
        assert bpe.merge_bytes(raw, ranks) == want
        parts = [np.array(bpe.merge_bytes(w, ranks)) for w in bpe.windows(raw)]
        assert bpe.splice(parts, size, pieces, ranks).tolist() == want
    first, second = b"a" * 64, b"a" * 64
    shifted = [np.array(bpe.merge_bytes(w, ranks)) for w in (first, second)]
    shifted[1] = np.array(bpe.merge_bytes(b"a", ranks) * 64)  # no token in common
    assert bpe.splice(shifted, size, pieces, ranks).tolist() == e._encode_single_piece(b"a" * 96)


def test_matches_below_u0100():
    """Python's matcher cuts texts of the first 256 code points as the pattern itself does."""
    fast, full, r = bpe.latin(bpe.pattern()), regex.compile(bpe.pattern()), random.Random(9)
    every = [chr(i) for i in range(256)]
    for text in ["".join(p) for c in every for p in ((c,), (" ", c), ("a", c, "1"), (c, c, " "), (" ", c, "x"))]:
        assert fast.findall(text) == full.findall(text), repr(text)
    for _ in range(2000):
        text = "".join(r.choice(every) for _ in range(40))
        assert fast.findall(text) == full.findall(text), repr(text)


def test_every_piece_encodes_to_itself():
    """Whole pieces are passed by their own id; the merges would find the same for those that are text of one word."""
    ranks = bpe.load_ranks(VOCABULARIES[0])
    table = set(bpe.pair_table(ranks).tolist()) - {-1}
    assert len(table) == len(bpe.pair_ranks(ranks))
    assert all(x & ((1 << bpe.BITS) - 1) < len(ranks) for x in table)


def test_null_ids_and_empty_table(docs_of):
    assert [tuple(r)[:2] for r in bpe.encode_decode(docs_of([(None, "ab ab"), (None, "ab ab")])).collect()] == [(None, 2), (None, 2)]
    assert bpe.encode_decode(docs_of([])).collect() == []


def odd_ranks(r):
    """A vocabulary whose longer pieces may come before their parts."""
    made = {"".join(r.choice("abc") for _ in range(r.randrange(2, 6))).encode() for _ in range(r.randrange(2, 40))}
    pieces = sorted(made | {bytes([i]) for i in range(256)})
    r.shuffle(pieces)
    return {p: i for i, p in enumerate(pieces)}


def test_first_states():
    """Merged on from the first states words give what they give from bytes, and a quarter of these words' bytes are joined there."""
    r = random.Random(10)
    full = bpe.load_ranks(VOCABULARIES[0])
    words = ["".join(r.choice(["th", "er", "ión", "ou", "sch", "é", "q"]) for _ in range(r.randrange(1, 9))) for _ in range(2000)]
    cases = [(full, [w.encode() for w in words])] + [(odd_ranks(r), ["".join(r.choice("abcd") for _ in range(r.randrange(1, 20))).encode() for _ in range(60)]) for _ in range(80)]
    for ranks, units in cases:
        pieces, ids = sorted(ranks, key=ranks.get), np.array([ranks[bytes([i])] for i in range(256)])
        begins, pairs = bpe.pair_rows(ranks)
        ends, states = bpe.first_states(units, ids, bpe.byte_pairs(ranks), begins, pairs)
        merges = 0
        for unit, state in zip(units, np.split(states, ends[:-1])):
            tokens = [pieces[x & bpe.NO_RANK] for x in state.tolist()]
            assert b"".join(tokens) == unit and [x >> bpe.BITS & 1023 for x in state.tolist()] == list(range(len(tokens)))
            merges += len(unit) - len(tokens)
            known = [ranks.get(a + b, bpe.NO_RANK) for a, b in zip(tokens, tokens[1:])] + [bpe.NO_RANK]
            assert [x >> (bpe.BITS + bpe.PLACE) for x in state.tolist()] == known
            while len(tokens) > 1 and (least := min(near := [ranks.get(a + b, bpe.NO_RANK) for a, b in zip(tokens, tokens[1:])])) < bpe.NO_RANK:
                i = near.index(least)
                tokens[i : i + 2] = [tokens[i] + tokens[i + 1]]
            assert [ranks[t] for t in tokens] == bpe.merge_bytes(unit, ranks), unit
        if ranks is full:
            assert merges > 0.25 * sum(map(len, units))
    assert [len(x) for x in bpe.first_states([], ids, bpe.byte_pairs(ranks), begins, pairs)] == [0, 0]


def test_every_pair_has_one_place():
    r = random.Random(11)
    for ranks in [*map(bpe.load_ranks, VOCABULARIES), odd_ranks(r), {bytes([i]): i for i in range(256)}]:
        begins, pairs = bpe.pair_rows(ranks)
        known, n = bpe.pair_ranks(ranks), len(ranks)
        for (a, b), rank in known.items():
            assert pairs[begins[a] + b] == rank << (bpe.BITS + bpe.PLACE) | a
        for _ in range(20000):
            a, b = r.randrange(n), r.randrange(n)
            assert (a, b) in known or pairs[begins[a] + b] & bpe.NO_RANK != a
        assert len(pairs) < 2 * n + 4 * len(known)
