from __future__ import annotations

import hashlib
import random

import pytest
import sentencepiece

from tidemark.llm import pieces as pc

NAME = "piece_bpe_32k.model"
BITS = ["word", " ", "  ", "\n", "é", "中文", "😀", "<s>", "</s>", "<unk>", "<0x0A>", "▁", "\0", "\r\n", ";\r", "a" * 30, "�", "İ", "ﬁ", "́", "ｈｅ", "①", "ﾊﾞ", "　", "가"]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(NAME))


def texts(n=400):
    r = random.Random(5)
    return ["".join(r.choice(BITS) for _ in range(r.randrange(40))) for _ in range(n)]


def test_against_the_library(docs_of, library):
    """Ids, decoded text and spans of odd texts, nulls, repeats, null ids and one very long text."""
    rows = [None, "", *texts(), "plain words here " * 20_000, "x" * 20_000, " " * 5000, *texts(5), (None, "no id"), (3, "again")]
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(rows)]
    got = {(r.doc_id, hashlib.sha256((r.decoded or "").encode()).hexdigest()): r for r in pc.encode_pieces(docs_of(rows), with_spans=True).collect()}
    for i, text in rows:
        proto = library.encode(text or "", return_type="proto").pieces
        ids = [p.id for p in proto]
        r = got[i, hashlib.sha256(library.decode(ids).encode()).hexdigest()]
        assert (r.n_tokens, r.ids) == (len(ids), ids), text
        begin = [0]
        for c in text or "":
            begin.append(begin[-1] + len(c.encode()))
        spans = [(p.begin, p.end) for p in proto]
        chars = text is not None and begin[-1] != len(text)
        own = list(zip(r.begins, r.ends))
        assert own == spans or chars and own == [(begin[a], begin[b]) for a, b in spans], text[:80]


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "identity"])
@pytest.mark.parametrize("one_space", [True, False])
def test_normalising_by_the_library_rules(rule, one_space):
    """The character maps that the library has compiled in: results, and the places that they come from."""
    rules = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, remove_extra_whitespaces=one_space, escape_whitespaces=True)
    spec = dict(pc.fields(rules.serialized_normalizer_spec()))
    model = pc.Model(["<unk>", "a"], [0.0, 0.0], [pc.UNKNOWN, pc.NORMAL], pc.CharMap(spec.get(2, b"")), one_space=one_space)
    for text in [*texts(), " a  b ", "ﾊﾞ ｶﾞ　x　", "각 é"]:
        want, places = rules.normalize(text, with_offsets=True)
        got, source = pc.normalise(model, text)
        assert got == want
        if want:
            starts = pc.byte_starts(text)
            assert source.tolist() == [int(starts[p]) for p in places]


def test_decoding_any_ids(library):
    model, r = pc.load_model(NAME), random.Random(2)
    for _ in range(2000):
        ids = [r.choice([*range(300), *r.sample(range(32000), 5)]) for _ in range(r.randrange(12))]
        assert pc.decode(model, ids) == library.decode(ids), ids


def model_of(pieces, **flags):
    texts_, kinds = zip(*pieces)
    return pc.Model(list(texts_), [-float(i) for i in range(len(pieces))], list(kinds), pc.CharMap(b""), one_space=False, **flags)


def test_users_pieces_stay_whole_and_words_that_may_not_be_cut():
    own = model_of([("<unk>", 2), ("▁", 1), ("a", 1), ("b", 1), ("▁a", 1), ("ab", 1), ("<x>", 4)])
    text, source = pc.normalise(own, "ab<x>a b")
    assert text == "▁ab<x>a▁b" and source.tolist() == [0, 0, 1, 2, 2, 2, 5, 6, 7, 8]
    assert own.words(text) == ["▁ab<x>a", "▁b"]
    assert [own.pieces[i] for i in pc.encode_word(own, "▁ab<x>a")[0]] == ["▁a", "b", "<x>", "a"]
    across = model_of([("<unk>", 2), ("▁", 1), ("a", 1), ("a▁", 1)])
    assert across.words("▁a▁a") == ["▁a▁a"]
    assert [across.pieces[i] for i in pc.encode_word(across, "▁a▁a")[0]] == ["▁", "a▁", "a"]


def test_words_together_are_as_words_alone():
    model, r = pc.load_model(NAME), random.Random(3)
    words = ["▁" * r.randrange(3) + "".join(r.choice("abehlnorst\nÖ中.1😀\t") for _ in range(r.randrange(1, r.choice([4, 12, 60])))) for _ in range(3000)]
    counts, ids, sizes = pc.encode_many(model, words)
    at = 0
    for w, n in zip(words, counts.tolist()):
        assert (ids[at : at + n].tolist(), sizes[at : at + n].tolist()) == pc.encode_word(model, w), w
        at += n
    assert [len(x) for x in pc.encode_many(model, [])] == [0, 0, 0]
    small = model_of([("<unk>", 2), ("▁", 1), ("a", 1)])
    assert pc.encode_many(small, ["▁aa", "▁b"])[1].tolist() == [1, 2, 2, 1, 0]


def test_whole_small_table(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: r for r in pc.op13_sentencepiece(spark, sf).collect()}
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "")
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert (got[d.doc_id].n_tokens, got[d.doc_id].ids_sha256, got[d.doc_id].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))


def test_empty_table(docs_of):
    assert pc.encode_pieces(docs_of([])).collect() == []
    assert pc.encode_pieces(docs_of([]), with_spans=True).collect() == []
