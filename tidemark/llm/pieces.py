"""SentencePiece BPE encoding and decoding, with every piece's span in the original bytes.

A model file is read into its pieces, its flags and its compiled character map (a double-array trie of byte strings with the
strings that replace them). Normalising walks the text from left to right: the longest prefix that the map holds is replaced,
else one code point stays; spaces become U+2581. For each code point of the result the byte of the source that it came from
is recorded, so a piece, which is a number of code points of the result, projects to a span of original bytes.

The normalised text is cut before each run of U+2581 if no piece of the vocabulary holds one after another character: then no
merge can cross the cut, and since merges within a word don't depend on others, words are encoded once per task. A word's neighbours are
joined in the order of scores, leftmost first, in short words for thousands at once; characters that are no piece become byte pieces.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import _ragged as ragged
from .common import map_batches, table

SPACE = "▁"
#: Types of a piece in a model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Words that a task remembers before it starts anew, and code points of those that it remembers.
MOST_WORDS, MOST_CHARS = 300_000, 256


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer's fields: varints as numbers, all else as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}[kind] if kind in (1, 5) else varint()
            yield key >> 3, raw[at : at + size]
            at += size


class CharMap:
    """A compiled character map: longest prefixes and what replaces them."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if blob else ()
        self.strings = blob[4 + size :]
        self.begins: dict[str, bool] = {}

    def walk(self, node: int, raw: bytes) -> tuple[int, list[tuple[int, int]]]:
        """(node behind ``raw``, or -1; (bytes, value) of the prefixes of ``raw`` that end in a leaf)."""
        found = []
        for i, byte in enumerate(raw):
            node ^= byte
            unit = self.units[node] if node < len(self.units) else 0
            if unit & 0x800000FF != byte:
                return -1, found
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit & 0x100:
                found.append((i + 1, self.units[node] & 0x7FFFFFFF))
        return node, found

    def root(self) -> int:
        unit = self.units[0]
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def may_begin(self, char: str) -> bool:
        """Whether some prefix of the map begins with ``char``."""
        if char not in self.begins:
            node, found = self.walk(self.root(), char.encode()) if self.units else (-1, [])
            self.begins[char] = node >= 0 or bool(found)
        return self.begins[char]

    def longest(self, text: str, at: int) -> tuple[int, str] | None:
        """(code points, replacement) of the longest prefix of ``text`` from ``at`` on that the map holds."""
        best, node, i = None, self.root(), at
        while node >= 0 and i < len(text):
            node, found = self.walk(node, text[i].encode())
            i += 1
            if found and found[-1][0] == len(text[i - 1].encode()):
                value = found[-1][1]
                best = i - at, self.strings[value : self.strings.index(b"\0", value)].decode()
        return best


@dataclass
class Model:
    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    charmap: CharMap
    dummy_prefix: bool = True
    one_space: bool = True  # runs of spaces become one, and those at the ends go
    escape: bool = True
    byte_fallback: bool = False
    unknown_text: str = " ⁇ "

    def __post_init__(self):
        joinable = (NORMAL, USER_DEFINED)
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k in joinable}
        self.unknown = self.kinds.index(UNKNOWN)
        self.byte_ids = [self.pieces.index(f"<0x{b:02X}>") for b in range(256)] if self.byte_fallback else []
        own = sorted((p for p, k in zip(self.pieces, self.kinds) if k == USER_DEFINED), key=len, reverse=True)
        self.own = re.compile("|".join(map(re.escape, own))) if own else None
        # A cut before a run of spaces is safe if no piece goes on across it.
        safe = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        self.words = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if safe else r"(?s:.+)").findall
        self.raw = [self._raw(i) for i in range(len(self.pieces))]
        # For many words at once: each character's id, and each pair's place in the order of scores, by sorted keys.
        size = len(self.pieces)
        self.of_char = np.full(0x110000, -1, np.int32)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.of_char[ord(piece)] = i
        for b in range(128 if self.byte_fallback else 0):
            if self.of_char[b] < 0:
                self.of_char[b] = self.byte_ids[b]
        order = {score: k for k, score in enumerate(sorted({self.scores[i] for i in self.ids.values()}, reverse=True))}
        pairs = [(x * size + y, order[self.scores[i]], i) for p, i in self.ids.items() for k in range(1, len(p)) if (x := self.ids.get(p[:k])) is not None and (y := self.ids.get(p[k:])) is not None]
        self.keys, self.ranks, self.joined = np.array(sorted(pairs), np.int64).reshape(-1, 3).T.copy()

    def _raw(self, i: int) -> bytes:
        kind, piece = self.kinds[i], self.pieces[i]
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind in (CONTROL, UNKNOWN):
            return self.unknown_text.encode() if kind == UNKNOWN else b""
        return piece.replace(SPACE, " ").encode()


@functools.lru_cache(maxsize=2)
def load_model(name: str) -> Model:
    """A model file; ``name`` is a path, or a file name of the installed vocabularies. Other than BPE models, and those with unused pieces or a denormaliser, are refused."""
    import public_tokenizers

    with open(name if "/" in name else public_tokenizers.path(name), "rb") as f:
        return parse_model(f.read())


def parse_model(raw: bytes) -> Model:
    pieces, trainer, normaliser, denormaliser = [], {}, {}, {}
    for number, value in fields(raw):
        if number == 1:
            p = dict(fields(value))
            pieces.append((p.get(1, b"").decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
        elif number in (2, 3, 5):
            {2: trainer, 3: normaliser, 5: denormaliser}[number].update(fields(value))
    texts, scores, kinds = (list(x) for x in zip(*pieces))
    if trainer.get(3, 1) != 2 or UNUSED in kinds or denormaliser.get(2) or trainer.get(24, 0):
        raise ValueError("only BPE models without unused pieces, denormaliser and spaces as suffixes")
    flags = {k: bool(normaliser.get(n, 1)) for k, n in (("dummy_prefix", 3), ("one_space", 4), ("escape", 5))}
    return Model(texts, scores, kinds, CharMap(normaliser.get(2, b"")), **flags, byte_fallback=bool(trainer.get(35, 0)), unknown_text=trainer.get(44, b" \xe2\x81\x87 ").decode())


def byte_starts(text: str) -> np.ndarray:
    """The byte at which each code point of ``text`` begins in UTF-8, and the end."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    sizes = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
    return np.concatenate([[0], np.cumsum(sizes)])


def rewritten(model: Model, text: str) -> list[tuple[str, int, int]]:
    """(output, begin, end) in code points of ``text``, from left to right: what the map or a user's piece takes is one part, all else a part each."""
    out, at, charmap = [], 0, model.charmap
    while at < len(text):
        if model.own and (m := model.own.match(text, at)):
            part = m.end() - at, m.group()
        else:
            part = (charmap.longest(text, at) if charmap.may_begin(text[at]) else None) or (1, text[at])
        out.append((part[1], at, at + part[0]))
        at += part[0]
    return out


def normalise(model: Model, text: str) -> tuple[str, np.ndarray]:
    """(normalised text, for each of its code points and for its end the byte of ``text`` that it comes from)."""
    space, starts = SPACE if model.escape else " ", byte_starts(text)
    if not text:
        return "", starts
    if not model.one_space and not model.own and not any(map(model.charmap.may_begin, set(text))):
        front = model.dummy_prefix
        return (space if front else "") + text.replace(" ", space), np.concatenate([[0], starts]) if front else starts
    parts = rewritten(model, text)
    first = 0
    if model.one_space:
        while first < len(parts) and parts[first][0] == " ":
            first += 1
    if first == len(parts):
        return "", starts[-1:]
    chars, source, after = [], [], parts[first][1]
    if model.dummy_prefix:
        chars.append(space)
        source.append(after)
    spaced = model.one_space
    for output, begin, end in parts[first:]:
        if spaced:
            output = output.lstrip(" ")
        chars += output.replace(" ", space)
        source += [begin] * len(output)
        if output:
            spaced = model.one_space and output.endswith(" ")
        after = end
    if model.one_space:
        while chars and chars[-1] == space:
            chars.pop()
            after = source.pop()
    return "".join(chars), starts[np.array([*source, after])]


def encode_word(model: Model, word: str) -> tuple[list[int], list[int]]:
    """(ids, code points of each) of a part of a normalised text: the neighbours of best score are joined first, leftmost of equals.

    Bytes of one character have no code points but for the last one's.
    """
    symbols: list[str | None] = []
    frozen: set[int] = set()
    at = 0
    while at < len(word):
        m = model.own.match(word, at) if model.own else None
        if m:
            frozen.add(len(symbols))
        symbols.append(m.group() if m else word[at])
        at += len(symbols[-1])
    n, scores, ids = len(symbols), model.scores, model.ids
    before, behind = list(range(-1, n - 1)), list(range(1, n + 1))
    heap: list[tuple[float, int, int, str]] = []

    def offer(a: int, b: int) -> None:
        if a >= 0 and b < n and a not in frozen and b not in frozen and (i := ids.get(joined := symbols[a] + symbols[b])) is not None:
            heapq.heappush(heap, (-scores[i], a, b, joined))

    for a in range(n - 1):
        offer(a, a + 1)
    while heap:
        _, a, b, joined = heapq.heappop(heap)
        if symbols[a] is None or symbols[b] is None or len(symbols[a]) + len(symbols[b]) != len(joined):
            continue
        symbols[a], symbols[b] = joined, None
        behind[a] = behind[b]
        if behind[a] < n:
            before[behind[a]] = a
        offer(before[a], a)
        offer(a, behind[a])
    out, sizes = [], []
    for s in symbols:
        if s is None:
            continue
        i = ids.get(s, -1)
        if i < 0 and model.byte_fallback:
            raw = s.encode()
            out += [model.byte_ids[b] for b in raw]
            sizes += [0] * (len(raw) - 1) + [len(s)]
        else:
            out.append(i if i >= 0 else model.unknown)
            sizes.append(len(s))
    return out, sizes


#: Longest words that are encoded many at once, and how many.
SHORT, MANY = 48, 4096
NEVER = 1 << 40


def encode_many(model: Model, words: list[str]) -> list[np.ndarray]:
    """(number of ids of each word; all ids; all ids' code points). Short words go through the merges together, one merge of each word a round."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths) - lengths
    chars = model.of_char[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)].astype(np.int64)
    plain = (lengths <= SHORT) & (np.minimum.reduceat(chars, starts) >= 0) & (model.own is None) if len(words) else np.zeros(0, bool)
    together = np.argsort(lengths, kind="stable")
    together, alone = together[plain[together]], np.flatnonzero(~plain)
    done = []
    for at in range(0, len(together), MANY):
        some = together[at : at + MANY]
        places = np.minimum(starts[some][:, None] + np.arange(lengths[some[-1]]), len(chars) - 1)
        done.append(_merge_rounds(model, chars[places], lengths[some]))
    for i in alone.tolist():
        ids, sizes = encode_word(model, words[i])
        done.append(tuple(np.array(x, np.int64) for x in ([len(ids)], ids, sizes)))
    counts, ids, sizes = (np.concatenate(x) for x in zip((np.zeros(0, np.int64),) * 3, *done))
    order = np.argsort(np.concatenate([together, alone]))
    at = ragged((np.cumsum(counts) - counts)[order], counts[order]).astype(np.int64)
    return [counts[order], ids[at], sizes[at]]


def _merge_rounds(model: Model, chars: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of ids of each word, all ids, all ids' code points) of words given by rows of their characters' ids."""
    width, size = chars.shape[1], len(model.pieces)
    inside = np.arange(width) < lengths[:, None]
    ids = np.full((len(chars), width + 1), -1, np.int64)
    ids[:, :width][inside] = chars[inside]
    behind, before = (np.tile(np.arange(width + 1) + d, (len(chars), 1)) for d in (1, -1))

    def look(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (NEVER if it can't be joined) and what it is joined to."""
        key = a * size + b
        at = np.minimum(np.searchsorted(model.keys, key), max(len(model.keys) - 1, 0))
        fits = (model.keys[at] == key) & (a >= 0) & (b >= 0) if len(model.keys) else np.zeros(key.shape, bool)
        return (np.where(fits, model.ranks[at], NEVER), model.joined[at]) if len(model.keys) else (np.full(key.shape, NEVER), key)

    rank, into = look(ids[:, :-1], ids[:, 1:])
    rows = np.arange(len(chars))
    while len(rows):
        i = rank[rows].argmin(1)  # the leftmost of equal ones
        more = rank[rows, i] < NEVER
        rows, i = rows[more], i[more]
        j = behind[rows, i]
        k = behind[rows, j]
        ids[rows, i], ids[rows, j] = into[rows, i], -1
        behind[rows, i] = k
        before[rows, k] = i
        rank[rows, j] = NEVER
        rank[rows, i], into[rows, i] = look(ids[rows, i], ids[rows, k])
        left = before[rows, i] >= 0
        r, b = rows[left], before[rows, i][left]
        rank[r, b], into[r, b] = look(ids[r, b], ids[r, i[left]])
    alive = (ids[:, :width] >= 0) & inside
    place = np.nonzero(alive)[1]
    counts = alive.sum(1)
    ends = np.append(place[1:], 0)
    ends[np.cumsum(counts) - 1] = lengths
    return counts, ids[:, :width][alive], ends - place


def decode(model: Model, ids: list[int]) -> str:
    """The text of ``ids``: one space that the prefix put in front goes, bytes that are no UTF-8 become U+FFFD each."""
    first, at = b"", 0
    while at < len(ids):  # until something is shown: spaces in front go, one, or all where runs of spaces are one
        i, at = ids[at], at + 1
        kind = model.kinds[i]
        if kind == BYTE:
            at -= 1
            break
        piece, seen = model.raw[i], False
        if kind in (NORMAL, USER_DEFINED) and (model.dummy_prefix or model.one_space) and piece.startswith(b" "):
            piece, seen = piece[1:], not model.one_space
        if piece or seen:
            first = piece
            break
    rest = ids[at:]
    try:
        return (first + b"".join(map(model.raw.__getitem__, rest))).decode()
    except UnicodeDecodeError:  # stretches of byte pieces by themselves
        out, run = [first.decode()], bytearray()
        for i in [*rest, None]:
            if i is not None and model.kinds[i] == BYTE:
                run += model.raw[i]
                continue
            out.append(replaced(bytes(run)))
            run.clear()
            out.append(model.raw[i].decode() if i is not None else "")
        return "".join(out)


def replaced(raw: bytes) -> str:
    """``raw`` as UTF-8, U+FFFD for each byte that begins no valid code point."""
    out = ""
    while raw:
        try:
            return out + raw.decode()
        except UnicodeDecodeError as e:
            out += raw[: e.start].decode() + "�"
            raw = raw[e.start + 1 :]
    return out


class Words(dict):
    """word -> its number; new words are noted."""

    def __init__(self):
        self.new: list[str] = []
        self.count = 0

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self.count += 1
        if len(word) <= MOST_CHARS:
            self[word] = self.count - 1
        return self.count - 1


def encode_pieces(docs: DataFrame, model: str = "piece_bpe_32k.model", with_spans: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids, decoded (the ids' text) and spans_sha256 of every text; with ``with_spans`` also begins and ends.

    Ids are those of the library without begin and end ids; strings of control pieces in a text are ordinary text. begins
    and ends are each piece's place in the text's UTF-8 bytes: of the bytes of one character, the last one has the whole
    span and the others are empty at its begin. spans_sha256 is of all begins, then all ends, as little-endian unsigned
    64-bit integers. A null or empty text has no ids. Repeated rows and null ids give rows of their own; other columns
    are ignored; an empty table gives no rows. Texts of any length are encoded whole.
    """

    def make():
        m = load_model(model)
        words = Words()
        flat, size, length = (np.zeros(0, np.int64) for _ in range(3))  # ids and code points of all words, and ids of each word

        def work(rows):
            nonlocal words, flat, size, length
            if words.count > MOST_WORDS:
                words, flat, size, length = Words(), *(np.zeros(0, np.int64) for _ in range(3))
            source = [normalise(m, t or "") for t in rows["text"]]
            found = [m.words(t) for t, _ in source]
            number = np.fromiter(map(words.__getitem__, chain.from_iterable(found)), np.int64, sum(map(len, found)))
            new, words.new = encode_many(m, words.new), []
            length, flat, size = (np.concatenate(x) for x in zip((length, flat, size), new))
            at = ragged((np.cumsum(length) - length)[number], length[number]).astype(np.int64)
            ids, sizes = flat[at], size[at]
            upto = np.concatenate([[0], np.cumsum(length[number])])[np.cumsum([0, *map(len, found)])]
            keep = [[np.zeros(0, np.int64)] for _ in range(3)]  # ids, begins, ends
            digests, texts, ends = [], [], [0]
            for k, (_, origin) in enumerate(source):
                own, end = ids[upto[k] : upto[k + 1]], np.cumsum(sizes[upto[k] : upto[k + 1]])
                begin = end - sizes[upto[k] : upto[k + 1]]
                if not m.byte_fallback and len(own):  # unknown characters in a row are one piece
                    first = ~((own == m.unknown) & (np.concatenate([[-1], own[:-1]]) == m.unknown))
                    last = np.concatenate([first[1:], [True]])
                    own, begin, end = own[first], begin[first], end[last]
                begin, end = origin[begin], origin[end]
                digests.append(hashlib.sha256(begin.astype("<u8").tobytes() + end.astype("<u8").tobytes()).hexdigest())
                texts.append(decode(m, own.tolist()))
                ends.append(ends[-1] + len(own))
                for column, x in zip(keep, (own, begin, end)):
                    column.append(x)
            offsets, types = pa.array(ends, pa.int32()), (pa.int32(), pa.int64(), pa.int64())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(c), t)) for c, t in zip(keep[: 3 if with_spans else 1], types)]
            return {"doc_id": rows["doc_id"], "n_tokens": np.diff(ends).tolist(), "decoded": texts, "spans_sha256": digests} | dict(zip(("ids", "begins", "ends"), lists))

        return work

    schema = "doc_id long, n_tokens long, ids array<int>, decoded string, spans_sha256 string" + (", begins array<long>, ends array<long>" if with_spans else "")
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), ["doc_id", "text"], make, schema)


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: the contract's columns, and a digest of the pieces' spans in the text's bytes."""
    encoded = encode_pieces(table(spark, sf_dir, "documents"))
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select("doc_id", "n_tokens", F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "spans_sha256")
