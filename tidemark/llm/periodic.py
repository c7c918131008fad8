"""Periodic runs of words, found by bit-parallel lags.

A text's words become numbers, the numbers' bits become planes: one big integer per bit, with one bit per word. Shifting a
plane by a lag q and XORing it with itself marks the words that differ in that bit from the word q behind; the planes' OR
marks all mismatches. A run of period q is a long stretch without one: ANDing what is left with itself, shifted by 1, 2, 4
and so on, leaves a bit where a stretch of the least length begins. A lag is given up as soon as no such bit is left, which
for most lags is after the first plane.

Not every lag is tried. Of the lags from Q to 2Q - 1, Q a power of two, a run's stretch is at least 2Q long, so it holds Q
words from a multiple c of Q on that recur at c + q. Hashes of Q words, doubled from class to class, name the lags for which
that may be so (equal words have equal hashes, so none is missed). Where all words from c to c + q + Q lie in a run of a period below Q, the lag
is no candidate: two periods that share so many words have a common divisor as period (Fine and Wilf), so what recurs
there is no run of its own. All steps are linear in the number of words for each class and for each lag that is tried.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table

WORD = r"[^\x20\x09-\x0D]+"
#: Least number of words of a run, and least number of its periods.
LEAST, TIMES = 24, 3
#: Lags from 1 to FIRST - 1 are all tried. A power of two; a run of a longer period has LEAST words anyway.
FIRST = 8
#: Odd numbers that mix word numbers and positions into hashes.
MIX, BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


def planes(ids: np.ndarray) -> list[int]:
    """One big integer per bit of the ids: bit i of plane b is bit b of ids[i]."""
    bits = int(ids.max()).bit_length() if len(ids) else 0
    rows = np.packbits((ids[None, :] >> np.arange(bits, dtype=ids.dtype)[:, None] & 1).astype(np.uint8), axis=1, bitorder="little")
    return [int.from_bytes(row.tobytes(), "little") for row in rows]


def long_stretches(planes_: list[int], n: int, lag: int, least: int) -> int:
    """A bit for each i from which on ``least`` words are the same as those ``lag`` behind them."""
    equal = (1 << max(n - lag, 0)) - 1
    for plane in [*planes_, None]:
        if plane is not None:
            equal &= ~(plane ^ plane >> lag)
        found, have = equal, 1  # bits that begin ``have`` equal words
        while found and have < least:
            step = min(have, least - have)
            found &= found >> step
            have += step
        if not found:
            return 0
    return found


def ones(bits: int, n: int) -> list[tuple[int, int]]:
    """(begin, end) of the stretches of ones."""
    flat = np.unpackbits(np.frombuffer(bits.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little").astype(np.int8)
    edges = np.flatnonzero(np.diff(flat, prepend=0, append=0))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def proper_divisors(q: int) -> list[int]:
    """q divided by each of its prime factors: a smaller period that divides q divides one of these."""
    out, rest, p = [], q, 2
    while rest > 1:
        if p * p > rest:
            p = rest
        if rest % p == 0:
            out.append(q // p)
            while rest % p == 0:
                rest //= p
        p += 1
    return out


def candidate_lags(hashes: np.ndarray, width: int, runs: list[tuple[int, int, int]]) -> list[int]:
    """Lags from ``width`` to 2 * width - 1 for which ``width`` words at a multiple of it recur, outside known runs; hashes[i] is of the words from i on."""
    n = len(hashes)  # places from which on there are ``width`` words
    rows = -(-(n - width) // width) if n > width else 0
    if not rows:
        return []
    behind = np.zeros(rows * width, hashes.dtype)
    behind[: n - width] = hashes[width:]
    same = behind.reshape(rows, width) == hashes[: rows * width : width, None]
    same.reshape(-1)[n - width :] = False
    for start, length, _ in runs:
        first, after = -(-start // width), max((start + length - 3 * width) // width + 1, 0)
        same[first:after] = False
        at = max(first, after)
        if at < rows:  # of the last place, the lags that stay in the run
            same[at, : max(start + length - (at + 2) * width + 1, 0)] = False
    return (width + np.flatnonzero(same.any(0))).tolist()


def find_runs(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period), by start, then period, of all maximal stretches with that smallest period, ``least`` words and ``times`` >= 3 periods long at least."""
    if times < 3:
        raise ValueError("a run has three periods at least")
    n, runs = len(ids), []
    if n < least:
        return runs
    planes_ = planes(ids)

    def take(lag: int) -> None:
        shortest = max(least - lag, (times - 1) * lag, 1)
        if found := long_stretches(planes_, n, lag, shortest):
            for begin, end in ones(found, n):
                end += shortest - 1 + lag
                if all((ids[begin : end - d] != ids[begin + d : end]).any() for d in proper_divisors(lag)):
                    runs.append((begin, end - begin, lag))

    for lag in range(1, min(FIRST, n // times + 1)):
        take(lag)
    hashes, factor, width = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(MIX), BASE, 1
    hashes ^= hashes >> np.uint64(29)
    while times * width <= n:
        if width >= FIRST:
            for lag in candidate_lags(hashes, width, runs.copy()):
                if times * lag <= n:
                    take(lag)
        hashes = hashes[:-width] * np.uint64(factor) + hashes[width:]
        factor, width = factor * factor % (1 << 64), 2 * width
    return sorted(runs, key=lambda r: (r[0], r[2]))


def repeated(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words a run contains after its first period."""
    steps = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return np.cumsum(steps[:n]) > 0


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, n_words, runs (array of start, length and period in words, by start, then period) and collapsed: the text's words without those that only repeat, joined by spaces.

    A run is a stretch of words with a smallest period that no neighbouring word extends, of at least ``least`` words and
    ``times`` periods; of each, the first period is kept unless another run repeats it. A null, empty or blank text has no
    words, no runs, and the empty text as collapsed. Repeated rows and null ids give rows of their own; other columns
    are ignored; an empty table gives no rows. Texts of any length are searched whole.
    """

    def make():
        words_of = re.compile(WORD).findall

        def work(rows):
            starts, lengths, periods, ends, counts, texts = [], [], [], [0], [], []
            for text in rows["text"]:
                words = words_of(text) if text else []
                number: dict[str, int] = {}
                ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
                found = find_runs(ids, least, times)
                if found:
                    starts += [r[0] for r in found]
                    lengths += [r[1] for r in found]
                    periods += [r[2] for r in found]
                    words = [w for w, gone in zip(words, repeated(len(words), found).tolist()) if not gone]
                counts.append(len(ids))
                ends.append(len(starts))
                texts.append(" ".join(words))
            values = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (starts, lengths, periods)], ["start", "length", "period"])
            return {"doc_id": rows["doc_id"], "n_words": counts, "runs": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values), "collapsed": texts}

        return work

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), ["doc_id", "text"], make, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def strongest(runs: Column) -> Column:
    """The run of greatest length by period, compared exactly; the first of equal ones, null without runs."""
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, of which each document whose crc32(doc_id) is divisible by 10 repeats its own words from one place on, as the query's contract says.

    Other texts, and those of null ids, stay as they are.
    """
    hashed = docs.select(F.col("doc_id").cast("long"), "text", F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")).alias("h"))
    chosen = (F.col("h") % 10 == 0) & F.col("text").isNotNull()
    words = F.when(chosen, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    cut = hashed.select("doc_id", "text", F.expr("h div 10").alias("g"), words.alias("w")).withColumn("n", F.size("w"))
    cut = cut.withColumn("a", F.when(F.col("n") > 0, F.expr("cast(g % n AS int)"))).withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) AS int)"))
    again = F.transform("w", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("w", F.col("a") + (i - F.col("a")) % F.col("p"))))
    return cut.select("doc_id", F.when(F.col("n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: the contract's columns, from ``periodic_runs`` over whole texts with the planted repetitions."""
    found = periodic_runs(planted(table(spark, sf_dir, "documents"))).withColumn("best", strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
