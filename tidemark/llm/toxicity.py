"""Toxicity by weighted finite-state transducers over clauses.

A text is cut into clauses at sentence marks and line ends. A clause is a lattice: an edge for each word, for each
multi-word pattern, and for words whose letters are spaced out or lengthened; an edge has a class (insult, threat,
target, bound, negation, report, other) and a magnitude. Five transducers read the classes: negation, reported speech and
target mark what they govern, insult and threat weigh what is marked. They are composed into one; a clause's score is
that of its best accepted path. The target transducer guesses: what comes before a target counts as aimed at it on paths
that then read one; a threat without a target weighs nothing on any path, an insult less.

A document's evidence is what its clauses sum to, their largest, and the sum a hundred words; a logistic curve, fitted
on labelled rows, makes it a score. Insults come from the same rows: a word's beginning of MIN_STEM to MAX_STEM letters,
or a whole word, whose share of toxic rows is high.
"""

from __future__ import annotations

import math
import re
from collections import deque
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_column, cut, map_batches, table

#: Labelled rows that are fitted at most; beyond, those with the least hashes of their ids.
FIT_ROWS = 20_000
MIN_STEM, MAX_STEM = 4, 8
#: A stem is kept from so many toxic documents and so large a log ratio on; MOST_STEMS is the model's size.
MIN_TOXIC, MIN_LOG_ODDS, MOST_STEMS = 8, 2.5, 4000
THRESHOLD = 0.7

# Function words of the four languages that the other transducers read.
TARGET = frozenset("you your yours u du dich dir dein deine ihr euch tu te toi ton ta vous votre usted ustedes tú ti tus".split())
# Threat verbs in the forms that threats take: infinitive, present, past and participles.
THREAT = frozenset(
    """kill kills killed killing hurt hurts hurting burn burns burned burnt burning destroy destroys destroyed destroying punish punishes punished punishing
    töten töte tötest tötet tötete töteten getötet umbringen umbringe umbringst umbringt umgebracht umzubringen verletzen verletze verletzt verletzte verletzten
    tuer tue tues tuons tuez tuent tué tuée tués tuées tuerai tueras tuera tuerons tueront tuant
    frapper frappe frappes frappons frappez frappent frappé frappée frappés frapperai frappera frapperons frapperont
    brûler brûle brûles brûlons brûlez brûlent brûlé brûlée brûlés brûlerai brûlera brûlerons brûleront
    matar mato matas mata matamos matan mató maté mataron mataré matará mataremos matarán matando matado matarte matarlos mataros
    golpear golpeo golpea golpeamos golpean golpeó golpeé golpearé golpeará golpearemos golpeando golpeado golpearte
    quemar quemo quema quemamos queman quemó quemé quemaré quemará quemaremos quemando quemado quemarte""".split()
)
#: Threats that name their target in the verb itself.
BOUND = frozenset("matarte mataros golpearte quemarte".split())
NEGATION = frozenset("not no never isn't aren't don't nicht kein keine nie pas jamais aucun nunca jamás ni".split())
REPORT = frozenset("said says called wrote quoted claimed sagte nannte schrieb dit disait écrit dijo llamó escribió".split())
# Patterns of several words; <t> is any target.
PHRASES = {
    "threat": "beat <t> up; hunt <t> down; make <t> pay; tear <t> apart; cut <t> open; smash <t> face; break <t> neck; mach <t> fertig; mache <t> fertig; faire la peau; partir la cara; romper la cara".split("; "),
    "insult": "piece of shit; piece of trash; waste of space; son of a bitch; stück scheiße; fils de pute; hijo de puta; pedazo de mierda".split("; "),
}
#: Words that a negation governs.
REACH = 3
#: Magnitudes of a threat and of an insult of several words; an insult of one word has its stem's weight.
THREAT_WEIGHT, PHRASE_WEIGHT = 2.0, 3.0
#: Factors of what is aimed at a target, negated, reported.
AIMED, NEGATED, REPORTED = 1.25, 0.5, 0.7
_CLAUSE = re.compile(r"[.!?;:\n]+")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_LONG = re.compile(r"(.)\1{2,}")
_SPACED = re.compile(r"(?<!\w)[^\W\d_](?:[ .\-*_]{1,2}[^\W\d_]){2,}(?!\w)")

CLASSES = ("other", "insult", "threat", "target", "bound", "negation", "report")


@dataclass(frozen=True)
class Transducer:
    """arcs: (state, symbol) -> arcs (symbol written, weight a unit of magnitude, next state). States count from 0, the start."""

    arcs: dict
    finals: frozenset

    def symbols(self) -> set:
        return {symbol for _, symbol in self.arcs}


def compose(one: Transducer, two: Transducer) -> Transducer:
    """What ``two`` makes of what ``one`` writes: states are pairs, weights are added."""
    number, arcs, finals, todo = {(0, 0): 0}, {}, set(), deque([(0, 0)])
    while todo:
        a, b = todo.popleft()
        if a in one.finals and b in two.finals:
            finals.add(number[a, b])
        for symbol in one.symbols():
            out = []
            for written, weight, to in one.arcs.get((a, symbol), ()):
                for last, more, then in two.arcs.get((b, written), ()):
                    if (to, then) not in number:
                        number[to, then] = len(number)
                        todo.append((to, then))
                    out.append((last, weight + more, number[to, then]))
            if out:
                arcs[number[a, b], symbol] = tuple(out)
    return Transducer(arcs, frozenset(finals))


def _marked(symbols, marks: str) -> list[str]:
    """All symbols with and without each of ``marks``."""
    out = list(symbols)
    for m in marks:
        out += [s + m for s in out]
    return out


def _class(symbol: str) -> str:
    return symbol.split("+")[0]


def negation_transducer() -> Transducer:
    """Marks the REACH words behind a negation; a state is the words still governed."""
    arcs = {}
    for left in range(REACH + 1):
        for s in CLASSES:
            arcs[left, s] = ((s, 0.0, REACH),) if s == "negation" else ((s + "+n" if left else s, 0.0, max(left - 1, 0)),)
    return Transducer(arcs, frozenset(range(REACH + 1)))


def report_transducer(symbols) -> Transducer:
    """Marks what follows a verb of reported speech."""
    arcs = {(0, s): ((s, 0.0, 1 if _class(s) == "report" else 0),) for s in symbols}
    return Transducer(arcs | {(1, s): ((s + "+r", 0.0, 1),) for s in symbols}, frozenset({0, 1}))


def target_transducer(symbols) -> Transducer:
    """Marks what is aimed at a target: all behind one, and what a path guesses to lie before one. States: 0 none, 1 guessed, 2 read."""
    arcs = {}
    for s in symbols:
        aims = _class(s) in ("target", "bound")
        arcs[0, s] = ((s + "+t", 0.0, 2),) if aims else ((s, 0.0, 0), (s + "+t", 0.0, 1))
        arcs[1, s] = ((s + "+t", 0.0, 2 if aims else 1),)
        arcs[2, s] = ((s + "+t", 0.0, 2),)
    return Transducer(arcs, frozenset({0, 2}))


def weighing_transducer(symbols, classes: tuple[str, ...], without_target: float) -> Transducer:
    """Weighs the symbols of ``classes`` by their marks; others pass."""

    def weight(s: str) -> float:
        if _class(s) not in classes:
            return 0.0
        marks = s.split("+")[1:]
        return (AIMED if "t" in marks else without_target) * (NEGATED if "n" in marks else 1.0) * (REPORTED if "r" in marks else 1.0)

    return Transducer({(0, s): ((s, weight(s), 0),) for s in symbols}, frozenset({0}))


def layers() -> list[Transducer]:
    """The five transducers, each reading what the one before writes."""
    n, r, t = (_marked(CLASSES, m) if len(m) else CLASSES for m in ((), ("+n",), ("+n", "+r")))
    every = _marked(CLASSES, ("+n", "+r", "+t"))
    return [negation_transducer(), report_transducer(r), target_transducer(t), weighing_transducer(every, ("insult",), 1.0), weighing_transducer(every, ("threat", "bound"), 0.0)]


def composed() -> Transducer:
    first, *more = layers()
    for t in more:
        first = compose(first, t)
    return first


MACHINE = composed()


def best_path(machine: Transducer, edges: list[list[tuple[int, str, float]]]) -> float:
    """The largest weight of an accepted path through a lattice: edges[i] has (place behind, symbol, magnitude) of each edge from place i."""
    best: list[dict[int, float]] = [{0: 0.0}, *({} for _ in edges)]
    for i, here in enumerate(edges):
        for to, symbol, magnitude in here:
            there = best[to]
            for state, total in best[i].items():
                for _, weight, then in machine.arcs[state, symbol]:
                    x = total + weight * magnitude
                    if x > there.get(then, -1.0):
                        there[then] = x
    return max((x for state, x in best[-1].items() if state in machine.finals), default=0.0)


@dataclass(frozen=True)
class Grammar:
    """stems: weight of a word's beginning; words: weight of a whole word; curve: logistic coefficients."""

    stems: dict
    words: dict
    curve: tuple = (0.0, 0.0, 0.0, 0.0)

    def _insult(self, word: str) -> float:
        best = self.words.get(word, 0.0)
        for n in range(MIN_STEM, min(len(word), MAX_STEM) + 1):
            best = max(best, self.stems.get(word[:n], 0.0))
        return best

    def reading(self, word: str) -> tuple[str, float]:
        """A word's class and magnitude; letters lengthened to three or more are read once and twice as well."""
        spellings = {word}
        if _LONG.search(word):
            spellings |= {_LONG.sub(r"\1", word), _LONG.sub(r"\1\1", word)}
        for s in spellings:
            if s in BOUND:
                return "bound", THREAT_WEIGHT
            if s in THREAT:
                return "threat", THREAT_WEIGHT
            for name, members in (("target", TARGET), ("negation", NEGATION), ("report", REPORT)):
                if s in members:
                    return name, 0.0
        insult = max(map(self._insult, spellings))
        return ("insult", insult) if insult else ("other", 0.0)

    def lattice(self, readings: list[tuple[str, float]], words: list[str]) -> list[list[tuple[int, str, float]]]:
        """The edges of a clause: its words, patterns of several words, and runs of single letters read as a word."""
        edges = [[(i + 1, *r)] for i, r in enumerate(readings)]
        for i, word in enumerate(words):
            for pattern, kind, magnitude in _PHRASES_BY_FIRST.get(word, ()):
                part = words[i : i + len(pattern)]
                if len(part) == len(pattern) and all(p == w or p == "<t>" and w in TARGET for p, w in zip(pattern, part)):
                    # Its target, if it has one, is a part of the pattern.
                    edges[i].append((i + len(pattern), "bound" if kind == "threat" and "<t>" in pattern else kind, magnitude))
            if len(word) == 1 and (i == 0 or len(words[i - 1]) > 1):
                end = next((j for j in range(i, len(words)) if len(words[j]) > 1), len(words))
                if end - i >= 3:
                    edges[i].append((end, *self.reading("".join(words[i:end]))))
        return edges

    def evidence(self, text: str | None, memory: dict) -> tuple[float, float, float]:
        """(sum of clause scores, largest, sum a hundred words), each on a log scale. ``memory`` holds words' readings."""
        text = (text or "").lower()
        if len(memory) > 300_000:
            memory.clear()
        every = _WORD.findall(text)
        hit = False
        for w in set(every):
            r = memory.get(w)
            if r is None:
                kind, magnitude = self.reading(w)
                r = memory[w] = (kind, magnitude, kind in ("insult", "threat", "bound") or w in _PHRASES_BY_FIRST)
            hit |= r[2]
        if not hit and not _SPACED.search(text):
            return 0.0, 0.0, 0.0  # no clause can weigh anything
        total = most = 0.0
        for part in _CLAUSE.split(text):
            words = _WORD.findall(part)
            readings = [memory[w] if w in memory else (*self.reading(w), True) for w in words]
            if any(r[2] for r in readings) or _SPACED.search(part):
                score = best_path(MACHINE, self.lattice([r[:2] for r in readings], words))
                total += score
                most = max(most, score)
        return math.log1p(total), math.log1p(most), math.log1p(100 * total / max(len(every), 20))

    def score(self, evidence: tuple[float, float, float]) -> float:
        z = self.curve[0] + sum(c * x for c, x in zip(self.curve[1:], evidence))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


_PHRASES_BY_FIRST: dict[str, list[tuple[list[str], str, float]]] = {}
for _kind, _patterns in PHRASES.items():
    for _pattern in _patterns:
        _PHRASES_BY_FIRST.setdefault(_pattern.split()[0], []).append((_pattern.split(), _kind, THREAT_WEIGHT if _kind == "threat" else PHRASE_WEIGHT))


def held_out() -> "F.Column":
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1


def fit_rows(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """(doc_id, text, toxic) of at most about ``most`` labelled ids that aren't held out, chosen by a hash of the id; of an id's rows the least text."""
    usable = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = usable.count()
    if n > most:
        usable = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * most / n))
    found = docs.join(F.broadcast(usable), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))


def _stem_counts(rows: DataFrame) -> DataFrame:
    """(feature, toxic rows with it, other rows with it), added up within tasks first."""

    def make():
        def work(batch):
            counts: dict[str, list[int]] = {}
            for text, toxic in zip(batch["text"], batch["toxic"]):
                words = set(_WORD.findall(text.lower()))
                features = {w[:n] for w in words for n in range(MIN_STEM, min(len(w), MAX_STEM) + 1)} | {f"={w}" for w in words}
                for f in features:
                    counts.setdefault(f, [0, 0])[0 if toxic else 1] += 1
            return by_column(["feature", "n_toxic", "n_other"], [(f, *n) for f, n in counts.items()])

        return work

    return map_batches(rows, ["text", "toxic"], make, "feature string, n_toxic long, n_other long").groupBy("feature").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_other").alias("n_other"))


def fit(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> Grammar:
    """The grammar of the labelled rows. Without rows of both kinds it has no stems and scores everything low."""
    rows = cut(fit_rows(docs, labels, most), "fit-rows")
    sums = {bool(r[0]): r[1] for r in rows.groupBy("toxic").count().collect()}
    if len(sums) < 2:
        return Grammar({}, {}, (-3.0, 1.0, 1.0, 0.0))
    a, b = sums[True], sums[False]
    odds = F.log((F.col("n_toxic") + 0.5) / (a + 1)) - F.log((F.col("n_other") + 0.5) / (b + 1))
    kept = _stem_counts(rows).where(F.col("n_toxic") >= MIN_TOXIC).withColumn("w", odds).where(F.col("w") >= MIN_LOG_ODDS)
    found = kept.orderBy(F.desc(F.col("w") * F.sqrt("n_toxic")), "feature").limit(MOST_STEMS).select("feature", "w").collect()
    grammar = Grammar({r[0]: float(r[1]) for r in found if r[0][0] != "="}, {r[0][1:]: float(r[1]) for r in found if r[0][0] == "="})
    seen = _evidence(rows.select("doc_id", "text", "toxic"), grammar, "toxic").collect()  # at most about FIT_ROWS rows
    x = np.array([[1.0, r[2], r[3], r[4]] for r in seen])
    y = np.array([float(bool(r[1])) for r in seen])
    order = np.lexsort(x.T)
    return Grammar(grammar.stems, grammar.words, tuple(_logistic(x[order], y[order])))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> list[float]:
    """Newton's method with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return [float(v) for v in w]


def _evidence(rows: DataFrame, grammar: Grammar, carry: str) -> DataFrame:
    def make():
        memory: dict = {}

        def work(batch):
            found = [grammar.evidence(t, memory) for t in batch["text"]]
            return {"doc_id": batch["doc_id"], "carried": batch[carry], "e1": [e[0] for e in found], "e2": [e[1] for e in found], "e3": [e[2] for e in found]}

        return work

    return map_batches(rows, ["doc_id", "text", carry], make, "doc_id long, carried int, e1 double, e2 double, e3 double")


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id, held_out, score, predicted of every text; a null or empty text has the score of no evidence.

    Repeated rows get the same score; a null doc_id is not held out; other columns are ignored.
    """

    def make():
        memory: dict = {}

        def work(batch):
            return {"doc_id": batch["doc_id"], "score": [grammar.score(grammar.evidence(t, memory)) for t in batch["text"]]}

        return work

    scored = map_batches(docs.select(F.col("doc_id").cast("long"), "text"), ["doc_id", "text"], make, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
