"""Secret scanning with a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams that
every match must hold. A batch of documents is one index segment: its postings
(trigram -> set of documents) are built for the trigrams that the queries ask
for, the queries combine them, and only the remaining candidates are matched.
A rule whose query is "anything" (no mandatory trigram) scans every document.
Segments need no shuffle, and what they hold is bounded by an Arrow batch.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from itertools import product
from re import _constants as C
from re import _parser

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_column, map_batches, table


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    flags: int = re.ASCII
    group: int = 0
    least: int = 0  # code points of the group; shorter matches are dropped


#: The base kinds, in the order in which spans that start together are listed.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE, 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", least=18),
    Rule("hex", r"[0-9a-f]+", least=16),
)
#: Further kinds; they add spans only.
MORE = (
    Rule("pem", r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + MORE

#: A query is True (anything), a trigram, or ("and" | "or", queries).
Query = object
#: Sets of exact strings larger than this are given up for what their trigrams say.
MOST_EXACT = 48


def _join(op: str, parts: list) -> Query:
    if op == "or" and (not parts or any(p is True for p in parts)):
        return True
    flat = {p for p in parts if p is not True}
    return True if not flat else flat.pop() if len(flat) == 1 else (op, frozenset(flat))


def _of_strings(strings: set[str]) -> Query:
    """What a text must hold if it holds one of ``strings``."""
    return _join("or", [_join("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in strings])


def _walk(tokens, fold: bool) -> tuple[set[str] | None, Query]:
    """(all strings that can match, or None if they are too many; what each match must hold)."""
    exact: set[str] | None = {""}
    must: list = []
    run: set[str] = {""}  # exact strings of the current run of neighbours

    def close() -> None:
        nonlocal run
        must.append(_of_strings(run))
        run = {""}

    for op, arg in tokens:
        strings: set[str] | None = None
        query: Query = True
        if op is C.LITERAL:
            strings = {chr(arg).lower() if fold else chr(arg)}
        elif op is C.IN and all(o is C.LITERAL for o, _ in arg) and len(arg) <= 8:
            strings = {chr(a).lower() if fold else chr(a) for _, a in arg}
        elif op is C.SUBPATTERN:
            strings, query = _walk(arg[3], fold)
        elif op is C.BRANCH:
            parts = [_walk(p, fold) for p in arg[1]]
            strings = set().union(*(p[0] for p in parts)) if all(p[0] is not None for p in parts) else None
            query = _join("or", [q if s is None else _of_strings(s) for s, q in parts])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            least, most, sub = arg
            inner, inner_query = _walk(sub, fold)
            if inner is not None and most == 1:
                strings = inner | ({""} if least == 0 else set())
            elif inner is not None and least == most and len(inner) == 1:
                strings = {next(iter(inner)) * least}
            elif least:
                query = inner_query if inner is None else _of_strings(inner)
        elif op is C.AT:
            strings = {""}
        if strings is not None and len(strings) * len(run) <= MOST_EXACT:
            run = {a + b for a, b in product(run, strings)}
            exact = {a + b for a, b in product(exact, strings)} if exact is not None and len(exact) * len(strings) <= MOST_EXACT else None
        else:
            close()
            must.append(query if strings is None else _of_strings(strings))
            exact = None
    close()
    return exact, _join("and", must)


def trigram_query(rule: Rule) -> Query:
    """The Boolean trigram query of a rule; True if it has no mandatory trigram. Trigrams are in lower case for all rules,
    as the index is: folding case can only add candidates."""
    return _walk(_parser.parse(rule.pattern, rule.flags), True)[1]


def trigrams(query: Query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


class Segment:
    """The inverted index of some texts for the trigrams in ``wanted`` (ASCII)."""

    def __init__(self, texts: list[bytes], wanted: list[str], slot: np.ndarray):
        self.n = len(texts)
        joined = np.frombuffer(b"\0\0".join(texts) + b"\0\0\0", np.uint8)
        upper = (joined >= 65) & (joined <= 90)
        low = joined + (upper.view(np.uint8) << 5)
        code = low[:-2].astype(np.uint32)
        code <<= 8
        code |= low[1:-1]
        code <<= 8
        code |= low[2:]
        hit = slot[code]
        at = np.flatnonzero(hit)
        starts = np.zeros(self.n + 1, np.int64)
        np.cumsum([len(t) + 2 for t in texts], out=starts[1:])
        self.postings = np.zeros((len(wanted), self.n), bool)
        self.postings[hit[at] - 1, np.searchsorted(starts, at, "right") - 1] = True
        self.row = {t: i for i, t in enumerate(wanted)}

    def candidates(self, query: Query) -> np.ndarray:
        """Which texts satisfy ``query``."""
        if query is True:
            return np.ones(self.n, bool)
        if isinstance(query, str):
            return self.postings[self.row[query]]
        parts = [self.candidates(q) for q in query[1]]
        return np.logical_and.reduce(parts) if query[0] == "and" else np.logical_or.reduce(parts)


def slots(wanted: list[str]) -> np.ndarray:
    """For each 24-bit trigram code 1 + its place in ``wanted``, or 0."""
    out = np.zeros(1 << 24, np.uint8)
    for i, t in enumerate(wanted):
        a, b, c = t.encode("ascii")
        out[a << 16 | b << 8 | c] = i + 1
    return out


#: Bytes of text of one segment at most, unless a single text is larger: the codes take four bytes each.
SEGMENT_BYTES = 8 << 20
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_more long, n_candidates long"


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The secrets in each text: counts of the base kinds, a digest of their spans, and all spans as kind:start:end.

    Spans are code points, end exclusive, by start and then in the order of ``rules``. A null or empty text has none.
    One row for each row, repeated ones too; other columns are ignored.
    """
    queries = [trigram_query(r) for r in rules]
    wanted = sorted(set().union(*map(trigrams, queries)))
    if len(wanted) > 255:
        raise ValueError("the rules ask for more than 255 trigrams")
    base = {r.kind for r in BASE}

    def make():
        slot, compiled = slots(wanted), [re.compile(r.pattern, r.flags) for r in rules]

        def segment(texts: list[str], out: list[tuple]) -> None:
            index = Segment([t.encode("utf-8", "replace") for t in texts], wanted, slot)
            spans: list[list] = [[] for _ in texts]
            tried = np.zeros(len(texts), np.int64)
            for k, (rule, query, rx) in enumerate(zip(rules, queries, compiled)):
                found = index.candidates(query)
                tried += found
                for i in np.flatnonzero(found):
                    for m in rx.finditer(texts[i]):
                        a, b = m.span(rule.group)
                        if b - a >= rule.least:
                            spans[i].append((m.start(), k, m.end(), rule.kind))
            for i, own in enumerate(spans):
                own.sort()
                written = [(kind, f"{kind}:{a}:{b}") for a, _, b, kind in own]
                n = [sum(kind == b.kind for kind, _ in written) for b in BASE]
                digest = hashlib.sha256(",".join(s for kind, s in written if kind in base).encode()).hexdigest()
                out.append((*n, digest, ",".join(s for _, s in written), len(written) - sum(n), int(tried[i])))

        def work(rows):
            out: list[tuple] = []
            part: list[str] = []
            size = 0
            for t in rows["text"]:
                t = t or ""
                if part and size + len(t) > SEGMENT_BYTES:
                    segment(part, out)
                    part, size = [], 0
                part.append(t)
                size += len(t)
            if part:
                segment(part, out)
            return {"doc_id": rows["doc_id"], **by_column([x.split()[0] for x in SCHEMA.split(", ")[1:]], out)}

        return work

    return map_batches(docs, ["doc_id", "text"], make, SCHEMA)


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets; the scan is a narrow stage over the documents."""
    return scan(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text"))
