"""Two tokenizers' tokens aligned by the bytes that they cover, each distinct segment of a block tokenised once.

A text, with one space in front, is cut before each run of white space that begins with a space and follows another
character. Neither vocabulary can join tokens across such a place, which is verified when they are loaded: the byte-level
one cuts words there by its pattern, whatever stands around, and no piece of the other has its space mark behind another
character. So a segment's tokens are the same wherever it stands, both vocabularies have a token end at every cut, and a document's
alignment is its segments' alignments one after another.

1. Documents become blocks: each has its distinct segments' tokens once, aligned, and every document as numbers of segments.
2. Pairs of tokens that end together are counted: a block names each of its pairs once.
3. The corpus's counts go back to the blocks' pairs, and each block's documents are composed.

No segment's text or tokens are shuffled: what blocks share are pairs of ids, of which a block has far fewer than segments.
"""

from __future__ import annotations

import functools
import os
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship
from .bpe import Numbers
from .bpe import _ragged as ragged
from .common import ARROW_ROWS, BROADCAST_BYTES, bound_batches, cut, free_shuffles, join_groups, lean, table, to_arrow

#: Code points of a block, unless one text is larger.
BLOCK_CHARS = 16 << 20
#: What some definition calls white space, beside the space itself.
WHITE = r"\s\x85\u1680\u180e\u200b-\u200d\u2060\ufeff"
#: A segment: from a space on, up to a space behind a character that isn't white space.
SEGMENT = re.compile(f" [^ ]*(?:(?<=[{WHITE}]) [^ ]*)*")
#: Segments that are tokenised in one call: each ends in a character that isn't white space, so it stays by itself.
TOGETHER = 512
#: Segments that are aligned at a time: the libraries' own tokens are large.
AT_ONCE = 4096
#: Bits of an id: a token takes three bytes with its place in MARKS, a pair of ids one long.
ID_BITS = 22
#: What follows a token: another one of its kind in the group, the second kind, the next group, nothing.
MARKS = ",", "|", ";", ""
SPACE = "▁"


@functools.lru_cache(maxsize=2)
def load_bytes(name: str):
    """(tokenizer, bytes of each id) of a byte-level .json file, refused unless it cuts words by the usual pattern and neither normalises nor adds a space."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    path = name if "/" in name else public_tokenizers.path(name)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    before = spec["pre_tokenizer"] or {}
    if spec["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        raise ValueError("the first vocabulary must be byte-level, cut words by its pattern, and not normalise")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    # The alphabet: printable bytes stand for themselves, the others, in order, for code points from 256 on.
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    byte_of = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}
    vocabulary = tokenizer.get_vocab(with_added_tokens=False)
    raw: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
    for piece, i in vocabulary.items():
        raw[i] = bytes(byte_of[c] for c in piece)
    return tokenizer, raw


@functools.lru_cache(maxsize=2)
def load_pieces(name: str):
    """(processor, bytes of each id) of a SentencePiece file, refused if a piece goes on across a cut or the model changes its input other than by a space in front."""
    import public_tokenizers
    import sentencepiece

    path = name if "/" in name else public_tokenizers.path(name)
    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [processor.id_to_piece(i) for i in range(processor.get_piece_size())]
    shown = [i for i in range(len(pieces)) if not (processor.is_control(i) or processor.is_unknown(i) or processor.is_byte(i))]
    if any(re.search(f"[^{SPACE}]{SPACE}", pieces[i]) for i in shown):
        raise ValueError("a piece of the second vocabulary holds a space behind another character")
    probe = "  a  ｈ①é  ﬁ\tß "
    if "".join(processor.encode(probe, out_type=str)).count(SPACE) != 1 + probe.count(" "):
        raise ValueError("the second vocabulary changes spaces")
    raw = [bytes([int(p[3:5], 16)]) if processor.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
    return processor, raw


def tokenise(segments: list[str], first: str, second: str) -> list[np.ndarray]:
    """For both vocabularies the tokens of all segments, one after another, and the byte at which each ends."""
    (one, a_raw), (two, b_raw) = load_bytes(first), load_pieces(second)
    runs, joined = [], []
    for s in segments:
        if SEGMENT.match(s + " ").end() > len(s):  # ends in white space: by itself
            runs += ["".join(joined), s]
            joined = []
        else:
            joined.append(s)
            if len(joined) == TOGETHER:
                runs.append("".join(joined))
                joined = []
    runs = [r for r in (*runs, "".join(joined)) if r]
    mark = two.piece_to_id(SPACE)  # of a last space alone
    ids_a = [i for e in one.encode_batch_fast(runs, add_special_tokens=False) for i in e.ids]
    ids_b = [i for p in two.encode([r[1:] for r in runs], num_threads=1) for i in p or [mark]]
    whole = "".join(runs).encode()
    out = []
    for ids, raw in ((ids_a, a_raw), (ids_b, b_raw)):
        parts = [raw[i] for i in ids]
        if b"".join(parts) != whole:
            raise ValueError(f"a vocabulary changes one of the texts {segments[:5]!r} ...")
        out += [np.array(ids, np.int64), np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))]
    return out


def align(segments: list[str], first: str, second: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All segments' tokens as numbers 4 * id + place in MARKS, how many each has, and the bytes of its segment at which each group ends.

    A group ends where tokens of both end. Tokens have bytes, so two tokens end together only if both are a group's last.
    """
    a, end_a, b, end_b = tokenise(segments, first, second)
    stop = np.cumsum([len(s.encode()) for s in segments])
    cuts = np.intersect1d(end_a, end_b, assume_unique=True)
    if not np.isin(stop, cuts).all():
        raise ValueError(f"tokens go on across segments in {segments[:5]!r} ...")
    upto_a, upto_b = np.searchsorted(end_a, cuts, "right"), np.searchsorted(end_b, cuts, "right")
    last = np.searchsorted(cuts, stop)  # each segment's last group
    # Groups' tokens in one sequence: a group's first tokens, then its second ones, each with what follows it.
    size_a, size_b = np.diff(upto_a, prepend=0), np.diff(upto_b, prepend=0)
    coded_a, coded_b = 4 * a, 4 * b
    coded_a[upto_a - 1] += 1
    coded_b[upto_b - 1] += 2
    coded_b[upto_b[last] - 1] += 1
    coded = np.empty(len(a) + len(b), np.int64)
    coded[np.arange(len(a)) + np.repeat(upto_b - size_b, size_a)] = coded_a
    coded[np.arange(len(b)) + np.repeat(upto_a, size_b)] = coded_b
    if len(coded) and coded.max() >= 4 << ID_BITS:
        raise ValueError("ids from 2^22 on don't fit")
    ends = cuts - np.repeat(np.concatenate([[0], stop[:-1]]), np.diff(last, prepend=-1))
    return coded.astype(np.int32), np.diff(upto_a[last] + upto_b[last], prepend=0).astype(np.int32), ends.astype(np.int32)


def align_all(segments: list[str], first: str, second: str) -> list[np.ndarray]:
    """``align`` of any number of segments, some at a time."""
    parts = [align(segments[i : i + AT_ONCE], first, second) for i in range(0, len(segments), AT_ONCE)]
    return [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int32)] * 3


def links_of(coded: np.ndarray) -> np.ndarray:
    """The two last tokens of each group, as one number."""
    place = coded & 3
    return (coded[place == 1] >> 2).astype(np.int64) << ID_BITS | coded[place >= 2] >> 2


def pack(coded: np.ndarray) -> bytes:
    """Numbers of tokens in three bytes each, compressed."""
    return pa.compress(coded.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes(), "zstd", asbytes=True)


def unpack(packed: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(packed, 3 * n, "zstd"), np.uint8).reshape(-1, 3).astype(np.int32)
    return raw[:, 0] | raw[:, 1] << 8 | raw[:, 2] << 16


def pack_ints(values: np.ndarray) -> bytes:
    return pa.compress(values.astype(np.int32).tobytes(), "zstd", asbytes=True)


def unpack_ints(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed, 4 * n, "zstd"), np.int32)


def align_blocks(docs: DataFrame, first: str, second: str, with_ends: bool, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row a block: for each document how many segments it has, and which (numbers of all documents together); its distinct
    segments' tokens, how many each has and, if asked for, where its groups end; and its pairs of linked tokens in order, as a
    and b, with the number n of links that hold them. What only one block needs is compressed.

    Null and empty texts, and those with the space mark itself, have none: the second vocabulary takes the mark for a space, so its tokens aren't the text.
    """
    spark = docs.sparkSession
    ship(spark)
    bound_batches(spark)
    schema = "doc_ids array<long>, counts array<int>, numbers binary, tokens binary, sizes binary, ends binary, a array<int>, b array<int>, n array<long>"
    arrow = to_arrow(schema)

    def run(batches):
        ids, counts, numbers, own, size = [], [], array("i"), Numbers(), 0

        def row():
            flat = np.array(numbers, np.int32)
            coded, sizes, ends = align_all(list(own), first, second)
            of = np.repeat(np.arange(len(sizes)), sizes)[(coded & 3) == 1]  # each group's segment
            pairs, which = np.unique(links_of(coded), return_inverse=True)
            n = np.zeros(len(pairs), np.int64)
            np.add.at(n, which, np.bincount(flat, minlength=len(own))[of])
            made = (ids, counts, pack_ints(flat), pack(coded), pack_ints(sizes), pack_ints(ends) if with_ends else None, pairs >> ID_BITS, pairs & ((1 << ID_BITS) - 1), n)
            one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind.value_type)) if pa.types.is_list(kind) else pa.array([x], kind)
            return pa.RecordBatch.from_arrays([one(x, f.type) for x, f in zip(made, arrow)], schema=arrow)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                segments = SEGMENT.findall(f" {text}") if text and SPACE not in text else []
                ids.append(doc_id)
                counts.append(len(segments))
                numbers.extend(map(own.__getitem__, segments))
                size += len(text or "")
                if size >= block_chars:
                    yield row()
                    ids, counts, numbers, own, size = [], [], array("i"), Numbers(), 0
        if ids:
            yield row()

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), schema)
    return cut(rows.withColumn("block", F.monotonically_increasing_id()), "blocks")


def pair_counts(linked: DataFrame) -> DataFrame:
    """a, b, count (links that hold the pair, over the whole corpus), best (no other a has a greater count with b), size (rows of ``linked``)."""
    pairs = linked.groupBy("a", "b").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("size"))
    most = pairs.groupBy("b").agg(F.max("count").alias("most"))  # as many rows as the second vocabulary has pieces at most
    return cut(pairs.join(F.broadcast(most), "b").select("a", "b", "count", (F.col("count") == F.col("most")).cast("int").alias("best"), "size"), "pairs")


def weigh(linked: DataFrame, pairs: DataFrame) -> DataFrame:
    """of, at, count and best of each block's pairs."""
    n_pairs, total = pairs.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    if n_pairs * 40 <= BROADCAST_BYTES:
        met = linked.join(F.broadcast(pairs.drop("size")), ["a", "b"])
    else:
        met = join_groups(linked, pairs, ["a", "b"], total, ["of"])
    return met.select("of", "at", "count", "best")


SUMS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def compose(blocks: DataFrame, weights: DataFrame, with_ends: bool) -> DataFrame:
    """Each block's documents, with what its pairs weigh (of: the block, at: the pair's place in it, count, best)."""
    schema = f"doc_id long, {', '.join(f'{c} long' for c in SUMS)}, groups string" + (", ends array<long>" if with_ends else "")
    arrow = to_arrow(schema)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        doc_ids, counts = (left.column(c).combine_chunks().flatten() for c in ("doc_ids", "counts"))
        packed = {c: left.column(c)[0].as_py() for c in ("numbers", "tokens", "sizes", "ends")}
        counts = counts.to_numpy().astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(counts)])
        numbers = unpack_ints(packed["numbers"], int(upto[-1]))
        size = unpack_ints(packed["sizes"], int(numbers.max()) + 1 if len(numbers) else 0).astype(np.int64)
        coded = unpack(packed["tokens"], int(size.sum()))
        place = coded & 3
        stop = np.cumsum(size)
        pairs, which = np.unique(links_of(coded), return_inverse=True)
        right = right.sort_by("at").combine_chunks()
        if len(pairs) != right.num_rows:
            raise ValueError(f"{right.num_rows} of a block's {len(pairs)} pairs were counted")

        def summed(marked: np.ndarray, upto: np.ndarray, n: np.ndarray) -> np.ndarray:
            running = np.concatenate([[0], np.cumsum(marked, dtype=np.int64)])
            return running[upto] - running[upto - n]

        # A group's second tokens are those behind its bar, up to its end; each group links its last two tokens.
        opened = np.cumsum((place == 1).astype(np.int8) - (place >= 2), dtype=np.int64) + (place >= 2)
        of = {"n_b": summed(opened - (place == 1), stop, size), "n_groups": summed(place == 1, stop, size)}
        of["n_a"], of["n_links"] = size - of["n_b"], of["n_groups"]
        last = np.cumsum(of["n_groups"])
        for c, name in (("n_best", "best"), ("count_sum", "count")):
            of[c] = summed(right.column(name).to_numpy()[which], last, of["n_groups"])
        out = [doc_ids]
        for c in SUMS:
            out.append(pa.array(summed(of[c][numbers], upto[1:], counts), pa.int64()))
        groups = []
        for i in range(0, len(size), AT_ONCE):
            begin, part = stop[i] - size[i], stop[i : i + AT_ONCE]
            known, which = np.unique(coded[begin : part[-1]], return_inverse=True)
            words = np.array([f"{x >> 2}{MARKS[x & 3]}" for x in known.tolist()], object)[which].tolist()
            groups += ["".join(words[x:y]) for x, y in zip((part - size[i : i + AT_ONCE] - begin).tolist(), (part - begin).tolist())]
        spans = list(zip(upto[:-1].tolist(), upto[1:].tolist()))
        texts = (pa.array([";".join([groups[j] for j in numbers[x:y].tolist()]) for x, y in spans[i : i + ARROW_ROWS]], pa.string()) for i in range(0, len(spans), ARROW_ROWS))
        out.append(pa.chunked_array(texts, pa.string()))
        if with_ends:
            length, flat = of["n_groups"], unpack_ints(packed["ends"], int(of["n_groups"].sum())).astype(np.int64)
            first = np.cumsum(length) - length
            begin = np.concatenate([[0], np.cumsum(flat[first + length - 1][numbers])])  # of segments, in the block's bytes
            shift = begin[:-1] - np.repeat(begin[upto[:-1]], counts)
            ends = flat[ragged(first[numbers], length[numbers]).astype(np.int64)] + np.repeat(shift, length[numbers])
            at = np.concatenate([[0], np.cumsum(length[numbers])])[upto]
            out.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ends, pa.int64())))
        made = pa.Table.from_arrays([x.cast(f.type) for x, f in zip(out, arrow)], schema=arrow)
        return pa.Table.from_batches(made.to_batches(max_chunksize=ARROW_ROWS), arrow)  # each is sent by itself

    def leanly(left: pa.Table, right: pa.Table) -> pa.Table:
        (made,) = lean(lambda _: iter([run(left, right)]))(iter(()))
        return made

    return blocks.drop("a", "b", "n").groupBy("block").cogroup(weights.groupBy("of")).applyInArrow(leanly, schema)


def align_tokens(docs: DataFrame, first: str = "byte_bpe_50k.json", second: str = "piece_bpe_32k.model", with_ends: bool = False, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row a document: n_a, n_b, n_groups, n_links, n_best, count_sum and groups; with ``with_ends`` also each group's end in bytes.

    The byte-level vocabulary encodes a space and the text, the other one the text, which it puts a space in front of.
    groups is ``a1,a2|b1;a3|b2,b3``; ends count the bytes of the space and the text. A pair of tokens is linked where both
    end at one byte; its count is how many links hold it in all documents; n_best are the links whose count no other pair
    with the same second token exceeds. Null and empty texts, and those that the second vocabulary would change (they hold
    U+2581), have no tokens: zeros and an empty string. Repeated rows and null ids give rows of their own and count each
    time; other columns are ignored; an empty table gives no rows.
    """
    blocks = align_blocks(docs, first, second, with_ends, block_chars)
    listed = blocks.select(F.col("block").alias("of"), F.posexplode(F.arrays_zip("a", "b", "n")).alias("at", "x")).select("of", "at", "x.a", "x.b", "x.n")
    weights = weigh(listed, pair_counts(listed))
    free_shuffles(docs.sparkSession)
    return compose(blocks, weights, with_ends)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: the contract's columns, from ``align_tokens``."""
    aligned = align_tokens(table(spark, sf_dir, "documents"))
    digest = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2("groups", 256))
    return aligned.select("doc_id", *SUMS, digest.alias("groups_sha256"))
