from __future__ import annotations

import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import secrets as s

ASSIGN = re.compile(r"""(?a:(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")


def brute(text):
    text = text or ""
    spans = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    spans.sort()
    return (*(sum(k == i for _, k, _ in spans) for i in range(3)), hashlib.sha256(",".join(x for _, _, x in spans).encode()).hexdigest())


def made(n, seed=3):
    r = random.Random(seed)
    bits = ["PassWord", "passwd", "secret", "TOKEN", "api_key", "apiKey", "apikey", " = ", ":", '"', "'", "AKIA", "AKIAABCDEFGHIJKLMN", "0123456789abcdef", "deadbeef" * 3, "é", "ſecret", "toKen=", " ", "\n", "x" * 12, "abcDEF123456", "ghp_" + "a" * 36, "xoxb-1234567890ab", "-----BEGIN RSA PRIVATE KEY-----", "eyJ" + "a" * 10 + ".eyJ" + "b" * 10 + "." + "c" * 10]
    return ["".join(r.choice(bits) for _ in range(r.randrange(14))) for _ in range(n)]


def test_against_brute_force(spark, docs_of, monkeypatch):
    monkeypatch.setattr(s, "SEGMENT_BYTES", 500)
    texts = [None, "", *made(400), "password=" + "a" * 12, "password=" + "a" * 11, "word " * 50000 + "token: abcdefabcdefabcdef", "AKIA" + "A" * 13, "AKIA" + "A" * 14]
    texts += texts[:10]
    got = {r.doc_id: r for r in s.scan(docs_of(texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex, got[i].base_sha256) == brute(t), t
        assert set(x for x in got[i].spans.split(",") if x) >= {x for x in got[i].spans.split(",") if x.split(":")[0] in ("assign", "access", "hex")}
    assert sum(r.n_more for r in got.values()) > 20 and sum(r.n_assign for r in got.values()) > 20


@given(st.sampled_from(s.RULES), st.lists(st.sampled_from(made(60, 5)), max_size=3).map("".join))
@settings(max_examples=200, deadline=None)
def test_queries_hold_for_every_match(rule, text):
    """A text that matches satisfies the rule's trigram query, else the index would lose it."""
    query, wanted = s.trigram_query(rule), sorted(set().union(*(s.trigrams(s.trigram_query(r)) for r in s.RULES)))
    if re.search(rule.pattern, text, rule.flags):
        assert s.Segment([text.encode()], wanted, s.slots(wanted)).candidates(query)[0]


def test_which_rules_have_trigrams():
    queries = {r.kind: s.trigram_query(r) for r in s.RULES}
    assert queries["hex"] is True and queries["access"] == ("and", frozenset({"aki", "kia"}))
    assert all(queries[k] is not True for k in ("assign", "pem", "forge", "chat", "jwt"))


def test_empty_table(docs_of):
    assert s.scan(docs_of([])).collect() == []
