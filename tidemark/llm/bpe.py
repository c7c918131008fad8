"""Byte-level BPE: ranked merges folded by Spark's higher-order functions over arrays of distinct words' bytes.

A block of documents is cut into words in Python (the vocabulary's pattern needs Unicode classes and look-ahead as
its library has them) and becomes one row: the bytes of the distinct words that its task hasn't sent yet, and each
document as numbers of words. Bytes that are joined whatever else is are one token from the start. Spark folds the merges over each of these words, so a word costs once per task, however
often it occurs. The ids are put together per document, in the same task and order, and Spark decodes them: it looks up
each id's piece and concatenates. All steps are narrow: no shuffle, nothing collected; a block and the words that a
task remembers are bounded.

The fold's cost grows with the square of a word's length, so a word of more than WINDOW bytes is folded as overlapping
windows of WINDOW bytes. Two windows' tokens are spliced at a token that both have in the same place. This is exact:
tokens are the encoding of their bytes if and only if every two neighbours are the encoding of theirs, since the first
merge across a boundary would also happen in the two tokens beside it alone. A word whose windows share no token is
merged as a whole, by a heap.

The rank map is a literal. Spark looks a map up by scanning its keys, so the literal is laid out as an array of rows,
one for each left id, that are shifted into each other's gaps: a pair's rank is found at one place or nowhere.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship
from ..tables import give_back
from .common import bound_batches, lean, table, to_arrow

#: Bits of an id, and of a place in a window: an element of a fold's state is rank | place | id.
BITS, PLACE = 18, 10
#: Code points of a block, unless one text is larger, and words that a task remembers before it starts anew.
BLOCK_CHARS, MOST_WORDS = 2 << 20, 600_000
#: Bytes that are folded at once, and by how much one window of a longer word begins behind another.
WINDOW, STEP = 64, 32
#: Pairs that a short row of the rank table has at most.
FEW = 20
NO_RANK = (1 << BITS) - 1


@functools.lru_cache(maxsize=4)
def load_ranks(name: str) -> dict[bytes, int]:
    """piece -> rank of a .tiktoken file; ``name`` is a path, or a file name of the installed vocabularies."""
    import public_tokenizers

    with open(name if "/" in name else public_tokenizers.path(name), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


#: What the pattern's classes hold below U+0100.
LATIN = {r"\p{L}": "A-Za-zªµºÀ-ÖØ-öø-ÿ", r"\p{N}": "0-9²³¹¼-¾", r"\s": r"\t-\r \x85\xa0"}


def latin(pattern_: str) -> re.Pattern | None:
    """What ``pattern_`` matches in texts below U+0100, for Python's own faster matcher; None if it has other classes."""
    out, inside = "", False
    for part in re.findall(r"\\p\{\w+\}|\\.|.", pattern_):
        inside = part == "[" or inside and part != "]"
        if part in LATIN:
            out += LATIN[part] if inside else f"[{LATIN[part]}]"
        elif part == r"\S" and not inside:
            out += f"[^{LATIN[chr(92) + 's']}]"
        elif part[0] == "\\":
            return None
        else:
            out += part
    return re.compile(out)


def word_finder(pattern_: str):
    """text -> its words."""
    find, find_latin = regex.compile(pattern_).findall, latin(pattern_)

    def words(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return find(text)
        return find_latin.findall(text) if find_latin else find(text)

    return words


def pair_ranks(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """(id, id) of two pieces -> rank of their concatenation, for all ways to cut a piece in two."""
    out = {}
    for piece, rank in ranks.items():
        for k in range(1, len(piece)):
            a, b = ranks.get(piece[:k]), ranks.get(piece[k:])
            if a is not None and b is not None:
                out[a, b] = rank
    return out


def pair_rows(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(begins, pairs): that of ids a and b is at begins[a] + b of ``pairs``, as rank | place 0 | a; what has another a there isn't theirs.

    Each a's row is laid over the others at the first place where all of its entries fall into gaps, long rows first.
    """
    rows: dict[int, list[int]] = {}
    known = pair_ranks(ranks)
    for a, b in known:
        rows.setdefault(a, []).append(b)
    begins, taken, low = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), bool), 0
    for a, row in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
        at, width = low, 1 << (16 if len(row) > FEW else 13)
        while True:
            if at + width + len(ranks) > len(taken):
                taken = np.concatenate([taken, np.zeros(len(taken) + width, bool)])
            full = taken[at + row[0] : at + row[0] + width].copy()
            for b in row[1:]:
                full |= taken[at + b : at + b + width]
            if not full.all():
                break
            at += width
        begins[a] = at + full.argmin()
        taken[begins[a] + np.array(row)] = True
        low = at if len(row) <= FEW else low  # what has no gap for a short row is nearly full
    pairs = np.full(begins.max() + len(ranks), -1, np.int64)
    for (a, b), rank in known.items():
        pairs[begins[a] + b] = rank << (BITS + PLACE) | a
    return begins, pairs


def pair_table(ranks: dict[bytes, int]) -> np.ndarray:
    return pair_rows(ranks)[1]


def byte_pairs(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At 256 a + b for bytes a and b: their rank, if no longer piece that begins or ends with them has a lower one; the least rank of pieces that end with them; of those that begin with them."""
    pair, ends, starts, longer = np.full((4, 1 << 16), NO_RANK, np.int64)
    for piece, rank in ranks.items():
        if len(piece) > 1:
            end, start = piece[-2] << 8 | piece[-1], piece[0] << 8 | piece[1]
            ends[end], starts[start] = min(ends[end], rank), min(starts[start], rank)
            if len(piece) == 2:
                pair[start] = rank
            else:
                longer[end], longer[start] = min(longer[end], rank), min(longer[start], rank)
    return np.where(pair < longer, pair, NO_RANK), ends, starts


def first_states(units: list[bytes], ids: np.ndarray, two: tuple[np.ndarray, np.ndarray, np.ndarray], begins: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ends, elements) of the states that the merges of ``units`` are folded from; ``ids`` has those of bytes, ``two`` is ``byte_pairs``.

    Two bytes are one token from the start if they are joined whatever else is: their rank is lower than that of each piece
    that could take the left one with bytes before it, the right one with bytes behind it, or both with either. So
    nothing takes one of them before their turn, nor has its turn before theirs because they are joined already.
    """
    if not units:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.cumsum(np.fromiter(map(len, units), np.int64, len(units)))
    letters = np.frombuffer(b"".join(units), np.uint8).astype(np.int32)
    pair, ending, starting = two
    codes = letters[:-1] << 8 | letters[1:]
    inside = np.ones(len(codes), bool)
    inside[ends[:-1] - 1] = False
    rank = np.where(inside, pair[codes], NO_RANK)
    sure = rank < NO_RANK
    sure[1:] &= ~inside[:-1] | (rank[1:] < ending[codes[:-1]])
    sure[:-1] &= ~inside[1:] | (rank[:-1] < starting[codes[1:]])
    tokens = ids[letters]
    tokens[:-1][sure] = rank[sure]
    kept = np.concatenate([[True], ~sure])
    tokens, ends = tokens[kept], np.cumsum(kept)[ends - 1]
    size = np.diff(ends, prepend=0)
    found = np.full(len(tokens), -1, np.int64)
    found[:-1] = pairs[begins[tokens[:-1]] + tokens[1:]]
    found[ends - 1] = -1
    found = np.where((found & NO_RANK) == tokens, found, NO_RANK << (BITS + PLACE) | tokens)
    return ends, found | (np.arange(len(tokens)) - np.repeat(ends - size, size)) << BITS


def long_literal(spark: SparkSession, values: np.ndarray) -> Column:
    """array<bigint> as one literal."""
    gateway = spark.sparkContext._gateway
    longs = gateway.new_array(gateway.jvm.long, len(values))
    gateway.jvm.java.nio.ByteBuffer.wrap(values.astype(">i8").tobytes()).asLongBuffer().get(longs)
    return Column(gateway.jvm.org.apache.spark.sql.functions.lit(longs))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_merges(word: Column, begins: Column, pairs: Column) -> Column:
    """The ids of one word (array<long>, from ``first_states``).

    Of all neighbours the pair of least rank is joined, leftmost first, until none has a rank; a joined pair's id is its
    rank. The state is one array with an element rank | place | id for each token, rank being that of it and the next.
    """
    shift = BITS + PLACE
    low, own, places = (F.lit(x).cast("long") for x in ((1 << BITS) - 1, (1 << shift) - 1, (1 << shift) - (1 << BITS)))
    none, one_place = F.lit(NO_RANK << shift), F.lit(1 << BITS).cast("long")

    def element(token: Column, behind: Column) -> Column:
        pair = F.get(pairs, F.get(begins, token.bitwiseAND(low)) + behind)
        return F.when(pair.bitwiseXOR(token).bitwiseAND(low) == 0, pair.bitwiseOR(token)).otherwise(none.bitwiseOR(token))

    def merge(state: Column) -> Column:
        def join(least: Column, i: Column) -> Column:
            joined = F.shiftright(least, shift)
            both = element(least.bitwiseAND(places).bitwiseOR(joined), F.get(state, i + 2).bitwiseAND(low))
            return F.transform(
                F.array_remove(state, F.get(state, i + 1)),
                lambda x, k: F.when(k > i, x - one_place).when(k < i - 1, x).when(k == i, both).otherwise(element(x.bitwiseAND(own), joined)),
            )

        return _let(F.array_min(state), lambda least: F.when(least >= none, state).otherwise(_let(F.shiftright(least.bitwiseAND(places), BITS).cast("int"), lambda i: join(least, i))))

    # As many steps as there are pairs: more can't be joined.
    return F.transform(F.aggregate(F.slice(word, F.lit(2), F.size(word)), word, lambda state, _: merge(state)), lambda x: x.bitwiseAND(low).cast("int"))


def encode_words(words: Column, whole: Column, begins: Column, pairs: Column) -> Column:
    """array<array<long>> of words -> array<array<int>> of tokens; ``whole`` has the id of a word that is a piece itself, else -1. The literals are bound to names, so the plan holds each once."""
    return _let(begins, lambda b: _let(pairs, lambda p: F.zip_with(words, whole, lambda w, piece: F.when(piece >= 0, F.array(piece)).otherwise(fold_merges(w, b, p)))))


def merge_bytes(raw: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for any number of bytes, by a heap of pairs and links between neighbours."""
    ids = [ranks[raw[i : i + 1]] for i in range(len(raw))]
    end = list(range(1, len(raw) + 1))  # of the token that begins here
    prev = list(range(-1, len(raw) - 1))
    heap = [(ranks[raw[i : i + 2]], i, i + 1, i + 2) for i in range(len(raw) - 1) if raw[i : i + 2] in ranks]
    heapq.heapify(heap)
    alive = [True] * len(raw)
    while heap:
        rank, a, b, to = heapq.heappop(heap)
        if not alive[a] or end[a] != b or not alive[b] or end[b] != to:
            continue
        ids[a], end[a], alive[b] = rank, to, False
        if to < len(raw):
            prev[to] = a
            if (piece := raw[a : end[to]]) in ranks:
                heapq.heappush(heap, (ranks[piece], a, to, end[to]))
        if prev[a] >= 0 and (piece := raw[prev[a] : to]) in ranks:
            heapq.heappush(heap, (ranks[piece], prev[a], a, to))
    return [ids[i] for i in range(len(raw)) if alive[i]]


def windows(raw: bytes) -> list[bytes]:
    """A word's pieces of WINDOW bytes, each STEP behind the one before."""
    return [raw[a : a + WINDOW] for a in range(0, max(len(raw) - WINDOW + STEP, 1), STEP)]


def splice(parts: list[np.ndarray], size: np.ndarray, pieces: list[bytes], ranks: dict[bytes, int]) -> np.ndarray:
    """The ids of a word from its windows' ids, joined at tokens that two neighbours share; without one, merged anew."""
    kept = [parts[0]]
    base, at = 0, np.cumsum(size[parts[0]]) - size[parts[0]]  # where the last kept part's tokens begin
    for k, part in enumerate(parts[1:], 1):
        mine = k * STEP + np.cumsum(size[part]) - size[part]
        _, i, j = np.intersect1d(at + base, mine, assume_unique=True, return_indices=True)
        same = np.flatnonzero(kept[-1][i] == part[j])
        if not len(same):
            whole = b"".join(b"".join(pieces[x] for x in p.tolist())[(0 if n == 0 else WINDOW - STEP) :] for n, p in enumerate(parts))
            return np.array(merge_bytes(whole, ranks), np.int32)
        i, j = i[same[0]], j[same[0]]
        kept[-1] = kept[-1][:i]
        kept.append(part[j:])
        base, at = 0, mine[j:]
    return np.concatenate(kept).astype(np.int32)


class Numbers(dict):
    """word -> its number, in the order of their first appearance."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


BLOCK_SCHEMA = "known long, words array<array<long>>, whole array<int>, parts array<int>, doc_ids array<long>, counts array<int>, numbers array<int>"


def cut_words(docs: DataFrame, ranks: dict[bytes, int], begins: np.ndarray, pairs: np.ndarray, block_chars: int = BLOCK_CHARS, most_words: int = MOST_WORDS) -> DataFrame:
    """One row a block: its new words, numbered from ``known`` on (0: all numbers begin anew), each as so many ``parts``, and for each document how many words it has and which.

    A part is the first state of its bytes' merges; one that is a piece itself has that piece's id as ``whole``, as the library's rule is.
    """
    spark = docs.sparkSession
    ship(spark)
    bound_batches(spark)
    pat, arrow = pattern(), to_arrow(BLOCK_SCHEMA)
    own = np.array([ranks[bytes([a])] for a in range(256)], np.int64)
    shared = spark.sparkContext.broadcast((ranks, own, byte_pairs(ranks), begins, pairs))  # as large as the vocabulary

    def run(batches):
        find, (pieces, *tables) = word_finder(pat), shared.value
        seen = Numbers()
        size = 0
        ids: list = []
        words: list[str] = []
        counts: list[int] = []

        def one(values: pa.Array) -> pa.ListArray:
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

        def row():
            if len(seen) >= most_words:
                seen.clear()
            known = len(seen)
            coded = pa.array(words, pa.large_string()).dictionary_encode()
            own = coded.dictionary.to_pylist()
            number = np.fromiter(map(seen.__getitem__, own), np.int32, len(own))
            new = [w.encode() for w, n in zip(own, number.tolist()) if n >= known]
            parts = [1 if len(w) <= WINDOW or w in pieces else len(windows(w)) for w in new]
            whole = [pieces.get(w, -1) for w, n in zip(new, parts) for _ in range(n)]
            units = [u for w, n in zip(new, parts) for u in ([w] if n == 1 else windows(w))]
            units = [u if k < 0 else b"\0" for u, k in zip(units, whole)]
            ends, states = first_states(units, *tables)
            flat = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(states))
            made = (pa.array([known]), one(flat), one(pa.array(whole, pa.int32())), one(pa.array(parts, pa.int32())), pa.array([ids], pa.list_(pa.int64())), one(pa.array(counts, pa.int32())), one(pa.array(number[coded.indices.to_numpy()], pa.int32())))
            return pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(made, arrow)], schema=arrow)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = find(text) if text else []
                ids.append(doc_id)
                words += found
                counts.append(len(found))
                size += len(text or "")
                if size >= block_chars:
                    yield row()
                    size, ids, words, counts = 0, [], [], []
        if ids:
            yield row()

    return docs.select("doc_id", "text").mapInArrow(lean(run), BLOCK_SCHEMA)


IDS_SCHEMA = "doc_id long, ids_sha256 string, ids array<int>"


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places starts[i] ... starts[i] + lengths[i] - 1 for each i, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def put_together(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """Each document's ids from its words' ids, and their digest."""
    arrow, spark = to_arrow(IDS_SCHEMA), encoded.sparkSession
    shared = spark.sparkContext.broadcast(ranks)  # as large as the vocabulary

    def run(batches):
        ranks_ = shared.value
        pieces = list(ranks_)
        piece_size = np.array([len(p) for p in pieces], np.int64)
        flat, offsets, length = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)  # ids of all words known so far

        def new_words(units: pa.ListArray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """(lengths, ids) of words, from those of their parts."""
            ends = np.asarray(units.offsets).astype(np.int64)
            ids = np.asarray(units.flatten())
            if not len(parts) or parts.max() == 1:
                return np.diff(ends), ids
            each = np.split(ids, ends[1:-1] - ends[0])
            starts = np.cumsum(parts) - parts
            words = [each[a] if n == 1 else splice(each[a : a + n], piece_size, pieces, ranks_) for a, n in zip(starts.tolist(), parts.tolist())]
            return np.array([len(w) for w in words], np.int64), np.concatenate(words)

        for batch in batches:
            for i in range(batch.num_rows):
                known, units, parts, doc_ids, counts, numbers = (batch.column(c)[i] for c in ("known", "ids", "parts", "doc_ids", "counts", "numbers"))
                kept = slice(0, None if known.as_py() else 0)
                more, ids = new_words(units.values, np.asarray(parts.values))
                length = np.concatenate([length[kept], more])
                flat = np.concatenate([flat[kept], ids])
                offsets = np.cumsum(length) - length
                counts, numbers = np.asarray(counts.values), np.asarray(numbers.values)
                tokens = flat[_ragged(offsets[numbers], length[numbers])]
                upto = np.concatenate([[0], np.cumsum(length[numbers])])[np.concatenate([[0], np.cumsum(counts)])]
                raw = memoryview(tokens.astype("<u4")).cast("B")
                digests = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())]
                lists = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(tokens, pa.int32()))
                yield pa.RecordBatch.from_arrays([doc_ids.values, pa.array(digests), lists.cast(arrow.field("ids").type)], schema=arrow)

    return encoded.mapInArrow(lean(run), IDS_SCHEMA)


def decode(ids: Column, ranks: dict[bytes, int]) -> Column:
    """binary: the pieces of ``ids`` (array<int>), concatenated. A byte is the code point of its number while pieces are joined."""
    # One literal, split into the pieces by a string that they don't hold, in the order of their ranks.
    texts, mark = [p.decode("latin-1") for p in ranks], "ÿþÿ"
    while mark.join(texts).split(mark) != texts:
        mark += "þÿ"
    pieces = F.split(F.lit(mark.join(texts)), mark)
    return F.encode(_let(pieces, lambda p: F.array_join(F.transform(ids, lambda i: F.get(p, i)), "")), "ISO-8859-1")


def encode_decode(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", with_ids: bool = False, block_chars: int = BLOCK_CHARS, most_words: int = MOST_WORDS) -> DataFrame:
    """doc_id, n_tokens and digests of the ids (little-endian, 32 bits) and of the decoded bytes; with ``with_ids`` both too.

    Each match of the vocabulary's pattern is encoded by itself; strings of special tokens are ordinary text. A null or
    empty text has no tokens. Repeated rows and null ids give rows of their own; other columns are ignored; an empty
    table gives no rows. Words of any length are encoded; the work grows in proportion to a long word's length.
    """
    spark = docs.sparkSession
    if docs.schema["doc_id"].dataType.simpleString() != "bigint":
        docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    ranks = load_ranks(vocabulary)
    if list(ranks.values()) != list(range(len(ranks))):
        ranks = dict(sorted(ranks.items(), key=lambda x: x[1]))
    if list(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without gaps")
    if len(ranks) >= NO_RANK:
        raise ValueError("the vocabulary has too many pieces")
    begins, pairs = pair_rows(ranks)
    blocks = cut_words(docs, ranks, begins, pairs, block_chars, most_words)
    give_back(spark)  # the literals below are large
    words = encode_words(F.col("words"), F.col("whole"), long_literal(spark, begins), long_literal(spark, pairs))
    rows = put_together(blocks.select(words.alias("ids"), "known", "parts", "doc_ids", "counts", "numbers"), ranks)
    rows = rows.select("doc_id", "ids_sha256", "ids", decode(F.col("ids"), ranks).alias("decoded"))
    also = ["ids", "decoded"] if with_ids else []
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"), *also)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"))
