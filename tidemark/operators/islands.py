"""Interval merging and gaps-and-islands over ordered entries (contig, start, stop[, value])."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import cut
from .ordered import WIDTH, with_context, with_islands, with_last, with_neighbour, with_running_sum

KEYS = ["contig"]


def _numbered(df: DataFrame, keys: list[str], order: list[str], begins: Callable[[Column], Column], columns: list[str], width: int) -> DataFrame:
    """Number the islands: a row begins one if it has no row before it or ``begins(previous)``."""
    return with_islands(df, keys, order, begins, columns, order[0], "island", width)


def merge_overlapping(intervals: DataFrame, keys: list[str] = KEYS, width: int = WIDTH) -> DataFrame:
    """Merge what overlaps or touches, by counting open intervals along the starts and ends (starts first at one position).

    A merged interval runs from where the count leaves zero to where it is zero again. An interval whose stop lies before
    its start takes one away where it ends and so cancels instead of merging.
    """
    marks = F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(0).alias("kind")), F.struct(F.col("stop").alias("pos"), F.lit(1).alias("kind"))))
    counted = intervals.where("start IS NOT NULL AND stop IS NOT NULL").select(*keys, marks.alias("m")).groupBy(*keys, "m.pos", "m.kind").agg(F.count(F.lit(1)).alias("n"))
    change = F.when(F.col("kind") == 0, F.col("n")).otherwise(-F.col("n"))
    running = with_running_sum(counted, keys, ["pos", "kind"], change, "pos", "open", width).withColumn("was", F.col("open") - F.when(F.col("kind") == 0, F.col("n")).otherwise(-F.col("n")))
    # A position's ends pass zero once at most, going down.
    turns = running.where("kind = 0 AND was <= 0 AND open > 0 OR kind = 1 AND was > 0 AND open <= 0").select(*keys, "pos", F.col("kind").alias("end"))
    paired = with_neighbour(cut(turns, "turns"), keys, ["pos", "end"], ["pos", "end"], "pos", "next", after=True, width=width)
    return paired.where("end = 0 AND next.end = 1").select(*keys, F.col("pos").alias("start"), F.col("next.pos").alias("stop"))


def join_touching(intervals: DataFrame, keys: list[str] = KEYS, same_value: bool = False, width: int = WIDTH) -> DataFrame:
    """Join neighbours (by start, stop) where one's stop is the next one's start; with ``same_value`` only if the values are equal, too."""
    columns = ["stop", "value"] if same_value else ["stop"]
    order = ["start", "stop", *(["value"] if same_value else [])]

    def begins(prev: Column) -> Column:
        apart = prev["stop"] != F.col("start")
        return apart | ~prev["value"].eqNullSafe(F.col("value")) if same_value else apart

    rows = _numbered(intervals, keys, order, begins, columns, width)
    return rows.groupBy(*keys, "island", *(["value"] if same_value else [])).agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")


def join_close(intervals: DataFrame, distance: int = 10, keys: list[str] = KEYS, width: int = WIDTH) -> DataFrame:
    """Join neighbours (by start, stop) whose gap is under ``distance``; the stop is that of the island's last interval."""
    rows = _numbered(intervals, keys, ["start", "stop"], lambda prev: F.col("start") - prev["stop"] >= distance, ["stop"], width)
    return rows.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max(F.struct("start", "stop")).alias("last")).select(*keys, "start", F.col("last.stop").alias("stop"))


def join_contiguous_regions(entries: DataFrame, comment: str, predicate: Column | None = None, keys: list[str] = KEYS, width: int = WIDTH) -> DataFrame:
    """Entries that satisfy ``predicate``, joined where they touch; white space in the comment becomes a visible mark."""
    kept = entries if predicate is None else entries.where(predicate)
    return join_touching(kept, keys, width=width).withColumn("comment", F.regexp_replace(F.lit(comment), r"\s", "¬"))


def predicate_runs(entries: DataFrame, predicate: Column, keys: list[str] = KEYS, width: int = WIDTH) -> DataFrame:
    """Longest runs of neighbouring entries that satisfy ``predicate``, whatever gaps lie between them."""
    rows = entries.withColumn("hit", F.coalesce(predicate, F.lit(False)))
    rows = _numbered(rows, keys, ["start", "stop"], lambda prev: prev["hit"] != F.col("hit"), ["hit"], width)
    return rows.where("hit").groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")


def intersect(a: DataFrame, b: DataFrame, keys: list[str] = KEYS, width: int = WIDTH, merged: bool = False) -> DataFrame:
    """Where both sets cover: each is merged (unless ``merged`` says it is disjoint already), then depth two is kept.

    As ends are inclusive, sets that share one position give an interval of that one position.
    """
    sides = [x if merged else merge_overlapping(x, keys, width) for x in (a, b)]
    marks = F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(0).alias("kind")), F.struct(F.col("stop").alias("pos"), F.lit(1).alias("kind"))))
    both = sides[0].select(*keys, "start", "stop").unionByName(sides[1].select(*keys, "start", "stop")).select(*keys, marks.alias("m")).groupBy(*keys, "m.pos", "m.kind").agg(F.count(F.lit(1)).alias("n"))
    change = F.when(F.col("kind") == 0, F.col("n")).otherwise(-F.col("n"))
    nexted = with_context(both, keys, ["pos", "kind"], "pos", width, after={"next": ["pos"]}, sums={"open": change})
    return nexted.where("open = 2").select(*keys, F.col("pos").alias("start"), F.col("next.pos").alias("stop"))


def fill_missing(ranges: DataFrame, keys: list[str] = KEYS, width: int = WIDTH) -> DataFrame:
    """Fill gaps between neighbouring ranges (by start): equal values join over the gap, else the longer range takes it, the left one if equal.

    A range's length counts what it took before, so each step depends on the one before. But a run of equal values either
    took the gap in front or didn't, and having taken it only makes the run longer. So whether the next run takes the gap
    in front of it either doesn't depend on that, or is its contrary: a run takes its gap as the last run before it did
    that was decided by itself, or contrary to that if an odd number of runs lies between. Windows in bins tell all that.
    """
    order = ["start", "stop", "value"]
    rows = _numbered(ranges.select(*keys, *order), keys, order, lambda prev: ~prev["value"].eqNullSafe(F.col("value")), ["value"], width)
    ends = rows.groupBy(*keys, "island").agg(F.min(F.struct("start", "stop")).alias("a"), F.max(F.struct("start", "stop")).alias("b"), F.first("value").alias("value"))
    # Of each run the first row's start and stop, and the last row's stop.
    runs = cut(ends.select(*keys, "island", F.col("a.start").alias("start"), F.col("a.stop").alias("own"), F.col("b.stop").alias("stop"), "value"), "runs")
    order = ["start", "island"]
    runs = with_neighbour(runs, keys, order, ["stop"], "start", "prev", width=width)
    early = F.coalesce(F.least("prev.stop", "start"), F.col("start"))  # where the run begins if it takes the gap
    runs = runs.withColumn("early", early).withColumn("short", F.col("stop") - F.col("start")).withColumn("long", F.col("stop") - F.col("early"))
    runs = with_context(runs, keys, order, "start", width, before={"left": ["short", "long"]}, after={"next": ["start", "own"]})
    length = F.col("own") - F.col("start")
    # Taken if the run on the left is shorter than this one's first row; null where that depends on what the left one took.
    decided = F.when(F.col("left").isNull() | (F.col("left.short") >= length), 0).when(F.col("left.long") < length, 1)
    runs = runs.withColumn("decided", F.when(decided.isNotNull(), F.struct(decided.alias("taken"), F.col("island").alias("at"))))
    runs = with_last(cut(runs, "decided"), keys, order, "decided", "start", "known", width)
    taken = (F.col("known.taken") + F.col("island") - F.col("known.at")) % 2 == 1
    start, held = F.when(taken, F.col("early")).otherwise(F.col("start")), F.when(taken, F.col("long")).otherwise(F.col("short"))
    given = F.col("next").isNull() | (held < F.col("next.own") - F.col("next.start"))
    stop = F.when(given, F.col("stop")).otherwise(F.greatest("next.start", "stop"))
    return runs.select(*keys, start.alias("start"), stop.alias("stop"), "value")
