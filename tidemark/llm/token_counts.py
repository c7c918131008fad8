"""Token counts of whole texts, huge ones by overlapping chunks that resynchronise.

A byte-level BPE vocabulary cuts a text into words from left to right, and where the next word begins depends on nothing
to its left. So a word boundary found from a true boundary is true as long as the text that decided it lies in the
chunk, and a later chunk that has a boundary at the same place agrees from there on. Chunks are encoded with offsets and
spliced at such a place; where an overlap has none, it is widened, up to the whole chunk before.

A text of more than SPREAD code points is first cut into blocks of that size, which overlap and are dealt to tasks; each
is counted by chunks, and blocks are spliced by the boundaries that both find in their overlap. A text of which two
blocks share none is counted in one task.
"""

from __future__ import annotations

import functools
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_column, cut, map_batches, table

#: Texts of more code points are counted by chunks of CHUNK with OVERLAP in common.
HUGE, CHUNK, OVERLAP = 4096, 4096, 128
#: Texts of more code points are dealt to several tasks, in blocks of so many that have SPREAD_OVERLAP in common.
SPREAD, SPREAD_OVERLAP = 1 << 21, 1 << 12
LIMIT = 1024


@functools.lru_cache(maxsize=2)
def load(name: str):
    """The tokenizer of a .json file; ``name`` is a path, or a file name of the installed vocabularies."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(name if "/" in name else public_tokenizers.path(name))


def margin(tokenizer) -> int:
    """Code points to the right that can decide a boundary: a special token's string, or one of look-ahead."""
    return max([1, *(len(t.content) for t in tokenizer.get_added_tokens_decoder().values())]) + 1


class Chunk:
    """The encoding of part of a text, and its word boundaries near the ends."""

    def __init__(self, tokenizer, text: str):
        self.e = tokenizer.encode(text, add_special_tokens=False)
        self.n = len(self.e)

    def _boundary(self, i: int) -> bool:
        """Whether a word begins with token i: a token in the midst of a word, or of a code point, is no boundary."""
        if i == 0:
            return True
        word = self.e.token_to_word(i)
        return (word is None or word != self.e.token_to_word(i - 1)) and self.e.token_to_chars(i)[0] >= self.e.token_to_chars(i - 1)[1]

    def starts(self, low: int, high: int) -> list[tuple[int, int]]:
        """(place, tokens before it) of the boundaries from ``low`` to ``high``, in order. Offsets rise, so they are found by bisection."""
        a, b = 0, self.n
        while a < b:
            mid = (a + b) // 2
            a, b = (mid + 1, b) if self.e.token_to_chars(mid)[0] < low else (a, mid)
        out = []
        while a < self.n and (at := self.e.token_to_chars(a)[0]) <= high:
            if self._boundary(a):
                out.append((at, a))
            a += 1
        return out


def count_block(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP, head: int = 0, tail: int = 0) -> tuple[int, list, list, int]:
    """(tokens, boundaries in the first ``head`` code points, those in the last ``tail``, overlaps that were widened).

    Boundaries are (place, tokens before it) from the block's start; the last ones are those that the text has decided.
    Never more than one chunk and its widened overlap is encoded at once, except where no overlap has a boundary.
    """
    reach, widened = margin(tokenizer), 0
    size = len(text)
    start, before, end = 0, 0, min(chunk, size)  # tokens before ``start``, a true boundary, and where the chunk ends
    now, base, skipped = Chunk(tokenizer, text[:end]), 0, 0  # its encoding, where it begins, tokens before ``start`` in it
    first: list[tuple[int, int]] = []
    last: list[tuple[int, int]] = []

    def note(low: int, high: int) -> None:
        """Remember boundaries that this chunk decides, from ``low`` on and before ``high``."""
        for at, ends, out in ((0, head, first), (size - tail, size, last)):
            a, b = max(low, at), min(high, ends - 1)
            if a <= b:
                out += [(base + p, before + n - skipped) for p, n in now.starts(a - base, b - base)]

    while end < size:
        wide = min(overlap, end - start)
        while True:
            # Boundaries that the text up to ``end`` has decided; ``start`` itself is one.
            begin = max(start, end - wide)
            own = {start: before} if begin <= start else {}
            own |= {base + p: before + n - skipped for p, n in now.starts(begin - base, end - reach - base)}
            stop = min(begin + chunk + wide, size)
            then = Chunk(tokenizer, text[begin:stop])
            at = next(((begin + p, n) for p, n in then.starts(0, end - begin) if begin + p in own), None)
            if at:
                break
            widened += 1
            if begin == start:
                at = (start, 0)  # the longer chunk begins at a true boundary
                break
            wide *= 2
        note(start, at[0] - 1)
        start, before, skipped = at[0], own.get(at[0], before), at[1]
        now, base, end = then, begin, stop
    note(start, size - reach)
    return before + now.n - skipped, first, last, widened


def count_chunked(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of ``text``."""
    return count_block(tokenizer, text, chunk, overlap)[0]


PLACES = "array<struct<place:long,before:long>>"


def _count_spread(docs: DataFrame, vocabulary: str, chunk: int, overlap: int, spread: int, spread_overlap: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens and n_widened of texts that are longer than ``spread``: their blocks are dealt to tasks."""

    def cut_up():
        def work(rows):
            out = []
            for doc_id, text in zip(rows["doc_id"], rows["text"]):
                key, n = uuid.uuid4().hex, -(-(len(text) - spread_overlap) // spread)
                out += [(key, doc_id, len(text.encode()), k, k == n - 1, text[k * spread : (k + 1) * spread + spread_overlap]) for k in range(n)]
            return by_column(["key", "doc_id", "n_bytes", "k", "final", "text"], out)

        return work

    # Written down: a row's key is drawn once.
    blocks = cut(map_batches(docs, ["doc_id", "text"], cut_up, "key string, doc_id long, n_bytes long, k int, final boolean, text string"), "blocks")

    def make():
        tokenizer = load(vocabulary)

        def work(rows):
            out = []
            for key, doc_id, n_bytes, k, final, text in zip(*(rows[c] for c in ("key", "doc_id", "n_bytes", "k", "final", "text"))):
                n, first, last, widened = count_block(tokenizer, text, chunk, overlap, spread_overlap if k else 0, 0 if final else spread_overlap)
                places = lambda found, shift: [{"place": p - shift, "before": b} for p, b in found]
                out.append((key, doc_id, n_bytes, k, n if final else 0, widened, places(first, 0), places(last, spread)))
            return by_column(["key", "doc_id", "n_bytes", "k", "n", "n_widened", "first", "last"], out)

        return work

    counted = cut(map_batches(blocks.repartition("key", "k"), ["key", "doc_id", "n_bytes", "k", "final", "text"], make, f"key string, doc_id long, n_bytes long, k int, n long, n_widened long, first {PLACES}, last {PLACES}"), "counted")
    # Where a block and the next share a boundary, tokens before it count in the one and not in the other.
    left = counted.where(F.size("last") > 0).select("key", (F.col("k") + 1).alias("k"), F.explode("last").alias("x")).select("key", "k", "x.place", F.col("x.before").alias("mine"))
    right = counted.select("key", "k", F.explode("first").alias("x")).select("key", "k", "x.place", F.col("x.before").alias("theirs"))
    joints = left.join(right, ["key", "k", "place"]).groupBy("key", "k").agg(F.min(F.struct("place", (F.col("mine") - F.col("theirs")).alias("n"))).alias("x"))
    parts = counted.select("key", "doc_id", "n_bytes", "n", "n_widened", F.lit(1).alias("blocks"), F.lit(0).alias("joints")).unionByName(
        joints.join(counted.select("key", "k", "doc_id", "n_bytes"), ["key", "k"]).select("key", "doc_id", "n_bytes", F.col("x.n").alias("n"), F.lit(0).cast("long").alias("n_widened"), F.lit(0).alias("blocks"), F.lit(1).alias("joints"))
    )
    whole = cut(parts.groupBy("key", "doc_id", "n_bytes").agg(F.sum("n").alias("n_tokens"), F.sum("n_widened").alias("n_widened"), (F.sum("blocks") == F.sum("joints") + 1).alias("joined")), "joined")
    rest = blocks.join(whole.where("NOT joined").select("key"), "key", "left_semi").groupBy("key", "doc_id", "n_bytes").agg(F.array_sort(F.collect_list(F.struct("k", "text"))).alias("parts"))

    def again():
        tokenizer = load(vocabulary)

        def work(rows):
            done = []
            for parts in rows["parts"]:
                text = "".join(p["text"] if i == len(parts) - 1 else p["text"][:spread] for i, p in enumerate(parts))
                n, _, _, widened = count_block(tokenizer, text, chunk, overlap)
                done.append((n, widened + 1))
            return {"doc_id": rows["doc_id"], "n_bytes": rows["n_bytes"], "n_tokens": [n for n, _ in done], "n_widened": [w for _, w in done]}

        return work

    return whole.where("joined").select("doc_id", "n_bytes", "n_tokens", "n_widened").unionByName(map_batches(rest, ["doc_id", "n_bytes", "parts"], again, "doc_id long, n_bytes long, n_tokens long, n_widened long"))


def count_tokens(
    docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = LIMIT, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP, spread: int = SPREAD, spread_overlap: int = SPREAD_OVERLAP
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and n_widened (overlaps that had to be widened) of every text.

    Tokens are counted as the library counts without added special tokens. A null or empty text has no bytes and no
    tokens. Special strings in a text count as the library's default has them. Repeated rows and null ids give rows of
    their own; other columns are ignored; an empty table gives no rows.
    """

    def make():
        tokenizer = load(vocabulary)

        def work(rows):
            texts = [t or "" for t in rows["text"]]
            short = [t for t in texts if len(t) <= huge]
            counts = iter([len(e) for i in range(0, len(short), 64) for e in tokenizer.encode_batch_fast(short[i : i + 64], add_special_tokens=False)])
            done = [(next(counts), 0) if len(t) <= huge else count_block(tokenizer, t, chunk, overlap)[::3] for t in texts]
            return {"doc_id": rows["doc_id"], "n_bytes": [len(t.encode()) for t in texts], "n_tokens": [n for n, _ in done], "n_widened": [w for _, w in done]}

        return work

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    long = F.coalesce(F.char_length("text") > spread, F.lit(False))
    counted = map_batches(rows.where(~long), ["doc_id", "text"], make, "doc_id long, n_bytes long, n_tokens long, n_widened long")
    counted = counted.unionByName(_count_spread(rows.where(long), vocabulary, chunk, overlap, spread, spread_overlap))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_widened")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
