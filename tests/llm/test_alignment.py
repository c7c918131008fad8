from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from tidemark.llm import alignment as al

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def brute(rows):
    """(counts and groups of each row in order): whole texts by the libraries, links from all pairs of equal ends."""
    (one, a_raw), (two, b_raw) = al.load_bytes(A), al.load_pieces(B)
    found, counted = [], Counter()
    for _, text in rows:
        a = one.encode(" " + text, add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        raw = f" {text}".encode()
        if not text or b"".join(a_raw[i] for i in a) != raw or b"".join(b_raw[i] for i in b) != raw:
            found.append(([], [], [], []))
            continue

        def ends(ids, sizes):
            out, at = [], 0
            for i in ids:
                at += len(sizes[i])
                out.append(at)
            return out

        ea, eb = ends(a, a_raw), ends(b, b_raw)
        at_b = {e: i for i, e in zip(b, eb)}
        links = [(i, at_b[e]) for i, e in zip(a, ea) if e in at_b]
        counted.update(links)
        cuts = sorted(set(ea) & set(eb))
        groups = [",".join(str(i) for i, e in zip(a, ea) if lo < e <= hi) + "|" + ",".join(str(i) for i, e in zip(b, eb) if lo < e <= hi) for lo, hi in zip([0, *cuts], cuts)]
        found.append((a, b, groups, links, cuts))
    most = Counter()
    for (_, y), n in counted.items():
        most[y] = max(most[y], n)
    return [(len(f[0]), len(f[1]), len(f[2]), len(f[3]), sum(counted[x] == most[x[1]] for x in f[3]), sum(counted[x] for x in f[3]), ";".join(f[2]), f[4] if f[0] else []) for f in found]


def texts(n=150):
    r = random.Random(6)
    bits = ["word", " word", " ", "  ", "\n", " \n", "\t", "é", "中文", "😀", "123", "'s", "...", "<|endoftext|>", "</s>", "<0x0A>", " ", " ", "\x1c", "\0", "​", "x" * 40, "a b", "ﬁ", "Straße", "\r\n"]
    return ["".join(r.choice(bits) for _ in range(r.randrange(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("block_chars", [300, 1 << 20])
def test_against_whole_texts(docs_of, block_chars):
    rows = [None, "", *texts(), "a ▁ b", "▁", " ", "  lead", "trail  ", "the the the " * 500, "y" * 3000, *texts(4)]
    rows = [*enumerate(rows), (3, "again and again"), (3, "again and again")]
    got = al.align_tokens(docs_of(rows), with_ends=True, block_chars=block_chars).collect()
    want = brute(rows)
    key = lambda x: (x[0], x[7], x[1:7])
    assert sorted((key((r.doc_id, *(r[c] for c in al.SUMS), r.groups)) + (tuple(r.ends),) for r in got)) == sorted(key((i, *w[:7])) + (tuple(w[7]),) for (i, _), w in zip(rows, want))


def test_pairs_without_broadcast(docs_of, monkeypatch):
    rows = list(enumerate(texts(40)))
    monkeypatch.setattr(al, "BROADCAST_BYTES", 0)
    got = {r.doc_id: r for r in al.align_tokens(docs_of(rows)).collect()}
    for (i, _), w in zip(rows, brute(rows)):
        assert tuple(got[i][c] for c in al.SUMS) + (got[i].groups,) == w[:7]


def test_null_ids_and_empty_tables(docs_of):
    got = al.align_tokens(docs_of([(None, "a b"), (None, None), (1, "a b")])).collect()
    assert sorted(r.n_groups for r in got) == [0, 2, 2] and sum(r.doc_id is None for r in got) == 2
    assert al.align_tokens(docs_of([])).collect() == []
    assert [r.groups for r in al.align_tokens(docs_of([None, ""])).collect()] == ["", ""]


def test_vocabularies_that_cant_be_cut_are_refused(tmp_path):
    with pytest.raises(ValueError, match="byte-level"):
        al.load_bytes("word_bpe_49k.json")


def test_whole_small_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: r for r in al.op11_token_alignment(spark, sf).collect()}
    assert len(got) == len(rows)
    for (i, _), w in zip(rows, brute(rows)):
        assert tuple(got[i][c] for c in al.SUMS) == w[:6]
        assert got[i].groups_sha256 == (hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "")


def test_no_segment_is_shuffled(spark, docs_of, monkeypatch):
    """What blocks share are pairs of ids: no text and no tokens leave their block."""
    seen = {}
    monkeypatch.setattr(al, "compose", lambda blocks, weights, with_ends, old=al.compose: seen.update(blocks=blocks, weights=weights) or old(blocks, weights, with_ends))
    al.align_tokens(docs_of(["alpha beta gamma " * 50, "beta gamma delta " * 50]), block_chars=100).collect()
    assert [f.name for f in seen["weights"].schema if f.dataType.simpleString() in ("string", "binary")] == []
    assert all(len(r.a) == len(set(zip(r.a, r.b))) == len(r.n) for r in seen["blocks"].collect())
