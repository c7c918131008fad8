"""Mixing sources to target weights: iterative proportional fitting of token weights, then sampling by calibrated probabilities.

Cells (source, language, topic) hold the documents' tokens. Raking multiplies the cells' weights until each margin's
weighted tokens have their target shares. A document is then kept with the probability fraction * weight, so the expected
tokens are that fraction of all. Weights are raked under the bound 1 / fraction: a cell at the bound is taken whole and the
others make up for it, so that what is sampled has the target shares, not only what is weighted. Where the wanted fraction
leaves no such weights (a value has too few tokens), a smaller one is taken. The draw is a hash of its id, so a document's
fate depends on nothing but its id, its cell and the cells' totals.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, cut, table

DIMENSIONS = ("source", "lang", "topic")
#: Target shares of tokens by dimension and value. Values without one share what these leave, each in proportion to its
#: own tokens to the power TEMPERATURE, so that large sources are damped and small ones raised.
TARGETS = {"lang": {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}}
TEMPERATURE = {"source": 0.5, "lang": 0.7, "topic": 0.8}
#: Tokens wanted; the factor between fractions that are tried where a fraction leaves no solution, and the share of the wanted
#: one below which the targets are given up instead (with a warning, or an error if strict).
FRACTION, STEP, LEAST = 0.6, 0.95, 0.5
#: Rounds of raking at most, and the relative departure of a margin from its target that ends it. It also ends where PATIENCE
#: rounds lower the departure by under a hundredth: then the targets contradict each other.
ROUNDS, TOLERANCE, PATIENCE = 5000, 1e-6, 30
#: Bytes of the cells' table up to which it is raked on the driver and broadcast; beyond, it stays a table.
DRIVER_BYTES = BROADCAST_BYTES
#: Parts of a cell's rows where the cells' table is too large to broadcast.
SALTS = 16


def topic(text: Column) -> Column:
    """A document's form: the tables have no topic of their own. The first that holds of table, markup, legal, list, plain."""
    return (
        F.when(text.contains(" | "), "table")
        .when(text.contains("$$$") | text.contains("%%%"), "markup")
        .when(text.contains("License") | text.contains("Copyright"), "legal")
        .when(text.contains("\n"), "list")
        .otherwise("plain")
    )


def tokens(text: Column) -> Column:
    """Words without ASCII white space: where one begins, white space or the start comes before."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def described(docs: DataFrame, topic_of=topic) -> DataFrame:
    """row (all of a document's columns, whatever their names), doc_id, source, lang, topic and n_tokens."""
    text = F.coalesce("text", F.lit(""))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    return docs.select(row, F.col("doc_id"), F.col("source").alias("source"), F.col("lang").alias("lang"), topic_of(text).alias("topic"), tokens(text).alias("n_tokens"))


def _want(d: str, values: list, own: np.ndarray, targets: dict) -> np.ndarray:
    """Target shares of a dimension's values, ``own`` being their tokens; 0 without tokens, else summing to 1."""
    named = targets.get(d) or {}
    given = np.array([float(named.get(v, np.nan)) for v in values])
    damped = np.where((own > 0) & np.isnan(given), np.maximum(own, 1e-300) ** TEMPERATURE[d], 0.0)
    left = max(0.0, 1.0 - sum(named.values()))
    want = np.where(own > 0, np.nan_to_num(given), 0.0) + damped * (left / max(damped.sum(), 1e-300))
    return want / max(want.sum(), 1e-300)


class _Progress:
    """Whether raking is done, from each round's departure."""

    def __init__(self, tolerance: float):
        self.tolerance, self.best, self.since = tolerance, float("inf"), 0

    def done(self, worst: float) -> bool:
        self.since = 0 if worst < 0.99 * self.best else self.since + 1
        self.best = min(self.best, worst)
        return worst < self.tolerance or self.since >= PATIENCE


def _factor(want, cut, free):
    """What a margin's free tokens are multiplied by, those of cells at the bound being ``cut``; numpy arrays."""
    now = cut + free
    room = (want > cut) & (free > 0)
    scaled = np.divide(want, now, out=np.ones(len(now)), where=now > 0)
    return np.where(room, np.divide(want - cut, free, out=np.ones(len(now)), where=free > 0), np.minimum(1.0, scaled))


def rake_driver(cells: list[tuple], targets: dict | None = None, rounds: int = ROUNDS, tolerance: float = TOLERANCE, bound: float = float("inf")) -> tuple[np.ndarray, float]:
    """Weights, ``bound`` at most, of cells (source, lang, topic, tokens), in their order, and the last round's worst departure."""
    t = np.array([c[3] for c in cells], float)
    margins = []
    for i, d in enumerate(DIMENSIONS):
        values = list(dict.fromkeys(c[i] for c in cells))
        number = {v: k for k, v in enumerate(values)}
        code = np.array([number[c[i]] for c in cells], np.int64)
        margins.append((code, _want(d, values, np.bincount(code, t, len(values)).astype(float), TARGETS if targets is None else targets) * t.sum()))
    w, worst, progress = np.ones(len(t)), 0.0, _Progress(tolerance)
    for _ in range(rounds):
        worst = 0.0
        for code, want in margins:
            at = w >= bound
            cut = np.bincount(code, np.where(at, t * min(bound, 1e300), 0.0), len(want))
            free = np.bincount(code, np.where(at, 0.0, t * w), len(want))
            some = (cut + free > 0) & (want > 0)
            worst = max(worst, np.abs((cut + free)[some] / want[some] - 1).max(initial=0.0))
            w *= _factor(want, cut, free)[code]
        if progress.done(worst):
            break
    return np.minimum(w, bound), float(worst)


def rake_frame(cells: DataFrame, targets: dict | None = None, rounds: int = ROUNDS, tolerance: float = TOLERANCE, bound: float = float("inf")) -> tuple[DataFrame, float]:
    """The same for any number of cells: (source, lang, topic, tokens, weight), and the departure."""
    spark, goals, targets = cells.sparkSession, {}, TARGETS if targets is None else targets
    for d in DIMENSIONS:
        named = targets.get(d) or {}
        given = spark.createDataFrame([(v, float(x)) for v, x in named.items()], "value string, given double")
        margin = cells.groupBy(F.col(d).alias("v")).agg(F.sum("tokens").alias("t")).where("t > 0").join(given, F.col("v").eqNullSafe(F.col("value")), "left")
        margin = margin.select("v", "given", F.when(F.col("given").isNull(), F.pow("t", F.lit(TEMPERATURE[d]))).otherwise(0.0).alias("damped"))
        damped = margin.agg(F.sum("damped")).first()[0] or 1.0
        margin = margin.select("v", (F.coalesce("given", F.lit(0.0)) + F.col("damped") * (max(0.0, 1.0 - sum(named.values())) / damped)).alias("want"))
        total = margin.agg(F.sum("want")).first()[0] or 1.0
        goals[d] = cut(margin.select("v", (F.col("want") / total).alias("want")), "target")
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    now, worst, progress = cells.withColumn("weight", F.lit(1.0)), 0.0, _Progress(tolerance)
    at, limit = F.col("weight") >= bound, F.lit(min(bound, 1e300))
    for _ in range(rounds):
        steps = []
        for d in DIMENSIONS:
            sums = now.groupBy(F.col(d).alias("u")).agg(F.sum(F.when(at, limit * F.col("tokens")).otherwise(0.0)).alias("c"), F.sum(F.when(at, 0.0).otherwise(F.col("weight") * F.col("tokens"))).alias("t"))
            want, whole = F.col("want") * total, F.col("c") + F.col("t")
            factor = F.when((want > F.col("c")) & (F.col("t") > 0), (want - F.col("c")) / F.col("t")).otherwise(F.least(F.lit(1.0), want / whole))
            off = F.when(want > 0, F.abs(whole / want - 1)).otherwise(0.0)
            found = sums.where("c + t > 0").join(goals[d], F.col("u").eqNullSafe(F.col("v"))).select(F.col("u").alias(f"u_{d}"), factor.alias(f"f_{d}"), off.alias(f"off_{d}"))
            now = now.join(found, F.col(d).eqNullSafe(F.col(f"u_{d}")), "left").withColumn("weight", F.col("weight") * F.coalesce(f"f_{d}", F.lit(1.0)))
            steps.append(F.coalesce(f"off_{d}", F.lit(0.0)))
        now = cut(now.select(*DIMENSIONS, "tokens", "weight", F.greatest(*steps).alias("worst")), "rake")
        worst = now.agg(F.max("worst")).first()[0] or 0.0
        now = now.drop("worst")
        if progress.done(worst):
            break
    return now.withColumn("weight", F.least("weight", F.lit(bound))), worst


def cell_probabilities(cells: DataFrame, fraction: float = FRACTION, targets: dict | None = None, strict: bool = False, driver_bytes: int = DRIVER_BYTES, rounds: int = ROUNDS, least: float = LEAST) -> DataFrame:
    """(c_source, c_lang, c_topic, c_salt, weight, probability, fraction, gap) of cells (source, lang, topic, tokens).

    c_salt is null where the table is broadcast, else each cell has SALTS rows. probability is fraction * weight, fraction
    being the largest tried of the wanted one and its multiples by powers of STEP, down to ``least`` times it, whose sampled
    tokens have the target shares. gap is the worst relative departure of a margin's sampled share from its target. Targets
    that no fraction meets (they contradict each other, or a value has far too few tokens) leave the last one tried, with a
    warning; with ``strict`` it is an error.
    """
    spark, names = cells.sparkSession, ("c_source", "c_lang", "c_topic")
    size = cells.agg(F.sum(sum((F.coalesce(F.octet_length(d), F.lit(0)) for d in DIMENSIONS), F.lit(80)))).first()[0] or 0
    rows = sorted(((r.source, r.lang, r.topic, r.tokens) for r in cells.collect()), key=repr) if size <= driver_bytes else None
    taken = fraction
    while True:
        raked, gap = rake_frame(cells, targets, rounds, bound=1 / taken) if rows is None else rake_driver(rows, targets, rounds, bound=1 / taken)
        if gap < TOLERANCE or taken * STEP < fraction * least:
            break
        taken *= STEP
    if rows is None:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("c_salt")
        out = raked.select(*(F.col(d).alias(x) for d, x in zip(DIMENSIONS, names)), salts, "weight", F.least(F.lit(1.0), F.col("weight") * taken).alias("probability"), F.lit(taken).alias("fraction"), F.lit(gap).alias("gap"))
    else:
        made = [(*r[:3], None, float(w), float(min(1.0, taken * w)), taken, gap) for r, w in zip(rows, raked)]
        out = F.broadcast(spark.createDataFrame(made, ", ".join(f"{x} string" for x in names) + ", c_salt int, weight double, probability double, fraction double, gap double"))
    if gap >= TOLERANCE:
        if strict:
            raise ValueError(f"the targets can't be met together: a margin is off by {gap:.2g}")
        warnings.warn(f"the targets can't be met together: a margin is off by {gap:.2g}", stacklevel=2)
    return out


def draw(doc_id: Column) -> Column:
    """A number from 0 to 1 that follows from the id alone: 32 bits of its MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def mixed(docs: DataFrame, fraction: float = FRACTION, targets: dict | None = None, strict: bool = False, topic_of=topic, driver_bytes: int = DRIVER_BYTES, rounds: int = ROUNDS, least: float = LEAST) -> DataFrame:
    """row (the document's columns as a struct, so that their names can't clash), doc_id, source, lang, topic, n_tokens,
    weight, probability, fraction, gap and selected of every document.

    ``targets`` are shares of tokens by dimension and value (TARGETS). Null sources and languages are values of their
    own, named None. A null or empty text has no tokens; a cell without tokens keeps the weight that its margins give it.
    Repeated rows have the same draw. A null id has one draw too. An empty table gives no rows.
    """
    full = described(docs, topic_of)
    cells = cut(full.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    found = cell_probabilities(cells, fraction, targets, strict, driver_bytes, rounds, least)
    salt = F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(SALTS)).cast("int")
    same = F.col("source").eqNullSafe(F.col("c_source")) & F.col("lang").eqNullSafe(F.col("c_lang")) & F.col("topic").eqNullSafe(F.col("c_topic"))
    joined = full.join(found, same & (F.col("c_salt").isNull() | (salt == F.col("c_salt"))))
    return joined.drop("c_source", "c_lang", "c_topic", "c_salt").withColumn("selected", draw(F.col("doc_id")) < F.col("probability"))


def shares(rows: DataFrame) -> DataFrame:
    """Of rows of ``mixed``: dimension, value, tokens, and shares of tokens: own, raked (weighted) and sampled (expected)."""
    weighted = rows.select(F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in DIMENSIONS))).alias("v"), "n_tokens", (F.col("n_tokens") * F.col("weight")).alias("w"), (F.col("n_tokens") * F.col("probability")).alias("p"))
    sums = weighted.groupBy("v.dimension", "v.value").agg(F.sum("n_tokens").alias("tokens"), F.sum("w").alias("w"), F.sum("p").alias("p"))
    whole = sums.groupBy("dimension").agg(F.sum("tokens").alias("t_all"), F.sum("w").alias("w_all"), F.sum("p").alias("p_all"))
    return sums.join(whole, "dimension").select("dimension", "value", "tokens", (F.col("tokens") / F.col("t_all")).alias("own"), (F.col("w") / F.col("w_all")).alias("raked"), (F.col("p") / F.col("p_all")).alias("sampled"))


def sample_documents(docs: DataFrame, fraction: float = FRACTION, targets: dict | None = None) -> DataFrame:
    """The selected documents, with their own columns only."""
    return mixed(docs, fraction, targets).where("selected").select("row.*")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return rows.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("weight", 9).alias("weight"), F.round("probability", 9).alias("probability"), F.round("fraction", 9).alias("fraction"), F.round("gap", 9).alias("gap"), "selected")
