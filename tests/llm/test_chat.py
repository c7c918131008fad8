from __future__ import annotations

import pytest

from tidemark.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, seq string, block long, speaker int"


def brute(rows):
    out = []
    for conv in {r[0] for r in rows if r[0] is not None}:
        turns = sorted(((r[1] if r[1] is not None else -(1 << 62), r[2] or "unknown", r[3] or "", r[1]) for r in rows if r[0] == conv))
        for p in {t[1] for t in turns}:
            at = 0
            for seq, (_, speaker, text, turn) in enumerate(turns):
                head = "<|assistant|>\n" if speaker == p else f"<|user name={speaker}|>\n"
                out.append((conv, p, seq, turn, speaker, head + text + "\n", at + len(head), at + len(head) + len(text), speaker == p))
                at += len(head) + len(text) + 1
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [1, 3, 64])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK", block)
    rows = [(1, t, ["a", "b", "c"][t % 3], f"text {t}é") for t in range(-4, 20)]
    rows += [(1, 5, "a", "tie"), (1, 5, "a", "tie"), (1, 5, "b", None), (2, None, "solo", "hello"), (2, 0, None, ""), (None, 1, "a", "nobody's"), (3, 0, "x", "long " * 30000)]
    df = spark.createDataFrame([(*r, "s", 1, 2) for r in rows], SCHEMA)
    got = chat.rotate(df).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)
    whole = "".join(r.rendered for r in sorted((r for r in got if (r.conv_id, r.perspective) == (1, "b")), key=lambda r: r.seq))
    for r in got:
        if (r.conv_id, r.perspective) == (1, "b"):
            assert whole[r.text_start : r.text_end] == r.rendered.split("|>\n", 1)[1][:-1]


def test_empty_table_and_plan(spark):
    df = chat.rotate(spark.createDataFrame([], SCHEMA))
    assert df.collect() == []
    assert not any(x in df._jdf.queryExecution().toString() for x in ("Python", "Pandas", "Arrow"))
