from __future__ import annotations

import random

import pytest

from tidemark.llm import token_counts as tc

NAME = "byte_bpe_50k.json"


def texts():
    r = random.Random(9)
    bits = ["word", " word", " ", "  ", "\n", "\n\n\n", "'s", "é", "中文", "😀", "123", "...", "<|endoftext|>", "x" * 60, " " * 40, "\t"]
    return ["".join(r.choice(bits) for _ in range(r.randrange(1, 400))) for _ in range(60)]


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 4), (100, 30), (37, 1), (1000, 100)])
def test_chunks_splice_to_the_whole_count(chunk, overlap):
    t = tc.load(NAME)
    for text in [*texts(), "a" * 3000, " " * 3000, "ab " * 1000, "<|endoftext|>" * 60, "<|endo" * 300]:
        assert tc.count_chunked(t, text, chunk, overlap) == len(t.encode(text, add_special_tokens=False).ids), text[:80]


def test_boundaries_are_those_of_the_whole_block():
    """Places and counts in a block's ends are those of its encoding as a whole, however it is cut into chunks."""
    t = tc.load(NAME)
    for text in texts()[:30]:
        whole = tc.Chunk(t, text).starts(0, len(text))
        n, first, last, _ = tc.count_block(t, text, 64, 8, 50, 50)
        decided = len(text) - tc.margin(t)
        assert n == tc.Chunk(t, text).n
        assert first == [x for x in whole if x[0] < 50 and x[0] <= decided]
        assert last == [x for x in whole if len(text) - 50 <= x[0] <= decided]


def test_blocks_are_spliced(docs_of):
    """Texts dealt to several tasks: ordinary ones, and one whose blocks share no boundary."""
    t = tc.load(NAME)
    rows = [*(x * 3 for x in texts()[:25]), "a" * 3000, "plain words " * 400, "plain words " * 400, None, ""]
    got = {r.doc_id: r for r in tc.count_tokens(docs_of(rows), huge=60, chunk=64, overlap=8, spread=300, spread_overlap=70).collect()}
    assert {i: r.n_tokens for i, r in got.items()} == {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in enumerate(rows)}
    assert {i: r.n_bytes for i, r in got.items()} == {i: len((x or "").encode()) for i, x in enumerate(rows)}
    assert got[25].n_widened > 0


def test_against_the_library(docs_of):
    t = tc.load(NAME)
    rows = [None, "", *texts(), "z" * 200 + " plain words here" * 9000, "<|endoftext|>", *texts()[:3]]
    got = {r.doc_id: r for r in tc.count_tokens(docs_of(rows), huge=500, chunk=256, overlap=16).collect()}
    assert len(got) == len(rows)
    for i, text in enumerate(rows):
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((text or "").encode()), n, n > 1024)


def test_whole_small_table(spark, sf):
    t = tc.load(NAME)
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: r.n_tokens for r in tc.op6_token_counts(spark, sf).collect()}
    assert got == {r.doc_id: len(t.encode(r.text or "", add_special_tokens=False).ids) for r in docs}


def test_empty_table(docs_of):
    assert tc.count_tokens(docs_of([])).collect() == []
