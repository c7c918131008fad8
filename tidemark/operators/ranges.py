"""What can be told of the intervals or points of a range without making a pair for each.

* Numbers and sums of overlapping intervals are differences of running sums: those that begin by the range's stop, less those
  that end before its start. The first start and the last stop are running extremes, looked up at the range's ends.
* Intervals inside a range are those that end by its stop, less those that begin before its start, plus those that do
  both, so were taken off wrongly: they lie around the range. An interval and a range's start differ first in one bit of
  their positions, so they meet in one node of a binary tree over positions; there a running sum over stops counts them.
  An interval goes only to nodes whose middle it crosses, about half as many as its length has bits.
* The largest of a range's points is the largest of the tree's nodes that make up the range, two a level at most.

All windows run in bins of positions (``ordered``), over rows that are added up by position first, so neither long contigs
nor deep positions end up in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import cut
from .ordered import WIDTH, with_context

#: Positions are moved up by this, so that none is negative, and have so many bits then.
SHIFT, BITS = 1 << 40, 41
RANGE = ["contig", "start", "stop"]


def _nodes(at: Column, keep) -> Column:
    """array<struct<level, node>> of the tree's nodes over position ``at`` for whose levels ``keep`` holds; a node's middle has bit ``level`` set."""
    levels = F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda level: keep(_shifted(at, level), level))
    return F.transform(levels, lambda level: F.struct(level.alias("level"), F.call_function("shiftright", at, level + 1).alias("node")))


def _shifted(x: Column, level: Column) -> Column:
    return F.call_function("shiftright", x, level)


def _around(ranges: DataFrame, intervals: DataFrame, sums: list[str], width: int) -> DataFrame:
    """contig, start, stop and, for each of ``sums``, the total over intervals that begin before and end behind the range, in several rows."""
    start = F.col("start") + SHIFT
    # The first position of the node's right half must lie before the interval's stop, or no range in it is crossed.
    middle = lambda bits, level: F.call_function("shiftleft", bits + 1, level) < F.col("stop") + SHIFT
    met = intervals.select("contig", "stop", *sums, F.explode(_nodes(start, lambda bits, level: (bits % 2 == 0) & middle(bits, level))).alias("t"))
    met = met.groupBy("contig", "t.level", "t.node", "stop").agg(*(F.sum(c).alias(c) for c in sums))
    asked = ranges.select(*RANGE, F.explode(_nodes(start, lambda bits, _: bits % 2 == 1)).alias("t")).select(*RANGE, "t.level", "t.node")
    none = F.lit(None).cast("long")
    # From the highest stop down: a range is behind all stops greater than its own.
    rows = met.select("contig", "level", "node", (-F.col("stop")).alias("pos"), F.lit(1).alias("kind"), none.alias("start"), none.alias("stop"), *sums)
    rows = rows.unionByName(asked.select("contig", "level", "node", (-F.col("stop")).alias("pos"), F.lit(0).alias("kind"), "start", "stop", *(F.lit(0).cast("long").alias(c) for c in sums)))
    seen = with_context(rows, ["contig", "level", "node"], ["pos", "kind", "start"], "pos", width, sums={f"all_{c}": F.col(c) for c in sums})
    return seen.where("kind = 0").select(*RANGE, *(F.col(f"all_{c}").alias(c) for c in sums))


def aggregate_ranges(ranges: DataFrame, intervals: DataFrame, values: dict[str, Column] | None = None, within: bool = False, width: int = WIDTH) -> DataFrame:
    """Each range (contig, start, stop, ...) with ``n``, the number of intervals that overlap it (``within``: lie in it), and under each name of ``values`` the sum of that value over them (long).

    Without ``within`` also ``first``, the least start of the overlapping intervals, and ``last``, their greatest stop. Ends are
    inclusive. A range without an interval has n = 0 and nulls. Intervals and ranges with a null, or with a stop before
    their start, meet nothing. Equal ranges and equal intervals count each time.
    """
    values = values or {}
    names = ["__n", *(f"__v_{k}" for k in values)]
    sound = "contig IS NOT NULL AND start <= stop"
    own = intervals.where(sound).select("contig", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), F.lit(1).cast("long").alias("__n"), *(F.coalesce(v.cast("long"), F.lit(0)).alias(f"__v_{k}") for k, v in values.items()))
    # Equal intervals are one row from here on; written down, as they are read two or three times.
    own = cut(own.groupBy(*RANGE).agg(*(F.sum(c).alias(c) for c in names)), "intervals")
    keyed = ranges.where(sound).select("contig", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop")).distinct()
    # At one position: a range's start, then intervals' starts, their stops, and a range's stop.
    none = F.lit(None).cast("long")
    begins = own.groupBy("contig", F.col("start").alias("pos")).agg(F.max("stop").alias("reach"), *(F.sum(c).alias(c) for c in names)).select("contig", "pos", F.lit(1).alias("kind"), none.alias("start"), none.alias("stop"), "reach", none.alias("from"), *names)
    ends = own.groupBy("contig", F.col("stop").alias("pos")).agg(F.min("start").alias("from"), *(F.sum(c).alias(c) for c in names)).select("contig", "pos", F.lit(2).alias("kind"), none.alias("start"), none.alias("stop"), none.alias("reach"), "from", *names)
    zero = [F.lit(0).cast("long").alias(c) for c in names]
    asked = keyed.select("contig", F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(0).alias("kind")), F.struct(F.col("stop").alias("pos"), F.lit(3).alias("kind")))).alias("x"), "start", "stop").select("contig", "x.pos", "x.kind", "start", "stop", none.alias("reach"), none.alias("from"), *zero)
    of = lambda kind, c: F.when(F.col("kind") == kind, F.col(c)).otherwise(0)
    sums = {f"begun{c}": of(1, c) for c in names} | {f"ended{c}": of(2, c) for c in names}
    more = {} if within else {"greatest": {"last": F.col("reach")}, "least": {"first": F.col("from")}}
    seen = with_context(begins.unionByName(ends).unionByName(asked), ["contig"], ["pos", "kind", "start", "stop"], "pos", width, sums=sums, **more).where("kind IN (0, 3)")
    # Before a range's start and by its stop: what has begun and ended.
    plus, minus = ("ended", "begun") if within else ("begun", "ended")
    parts = seen.select(*RANGE, *(F.when(F.col("kind") == 3, F.col(f"{plus}{c}")).otherwise(-F.col(f"{minus}{c}")).alias(c) for c in names), *([] if within else [F.when(F.col("kind") == 0, F.col("first")).alias("first"), F.when(F.col("kind") == 3, F.col("last")).alias("last")]))
    if within:
        parts = parts.unionByName(_around(keyed, own, names, width))
    total = parts.groupBy(*RANGE).agg(F.sum("__n").alias("n"), *(F.sum(f"__v_{k}").alias(k) for k in values), *([] if within else [F.max("first").alias("first"), F.max("last").alias("last")]))
    some = F.col("n") > 0
    shown = total.select(*RANGE, "n", *(F.when(some, F.col(c)).alias(c) for c in (*values, *([] if within else ["first", "last"]))))
    return ranges.join(shown, RANGE, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def argmax_in_range(ranges: DataFrame, points: DataFrame) -> DataFrame:
    """For each range (contig, start, stop, ...) the point (contig, pos, value) of largest value in it, the first if equal.

    Ranges without a point are left out. ``best`` is the struct (pos, value). A range reads two nodes a level at most, so
    its cost grows with the logarithm of its length, whatever number of points lie in it. Null values are no points.
    """
    deepest = F.sequence(F.lit(0), F.lit(BITS - 1))
    keyed = ranges.where("contig IS NOT NULL AND start <= stop").select("contig", "start", "stop").distinct()
    # Whole nodes of a level inside the range, and of those the ones whose parent isn't: the first if odd, the last if even.
    low = lambda level: F.call_function("shiftright", F.col("start") + SHIFT + F.call_function("shiftleft", F.lit(1).cast("long"), level) - 1, level)
    high = lambda level: F.call_function("shiftright", F.col("stop") + SHIFT + 1, level) - 1
    ends = F.transform(deepest, lambda level: F.struct(level.alias("level"), low(level).alias("low"), high(level).alias("high")))
    usual = F.filter(ends, lambda x: x["low"] <= x["high"])
    chosen = F.flatten(F.transform(usual, lambda x: F.filter(F.array(F.struct(x["level"].alias("level"), F.when(x["low"] % 2 == 1, x["low"]).alias("node")), F.struct(x["level"].alias("level"), F.when(x["high"] % 2 == 0, x["high"]).alias("node"))), lambda y: y["node"].isNotNull())))
    asked = keyed.select(*RANGE, F.explode(chosen).alias("t")).select(*RANGE, "t.level", "t.node")
    at = F.col("pos") + SHIFT
    value = F.struct(F.col("value"), (-F.col("pos")).alias("back"))
    best = points.where("contig IS NOT NULL AND pos IS NOT NULL AND value IS NOT NULL").groupBy("contig", "pos").agg(F.max("value").alias("value"))
    levels = asked.select("level").distinct()  # at most BITS rows
    nodes = best.select("contig", value.alias("m"), at.alias("at"), F.explode(deepest).alias("level")).join(F.broadcast(levels), "level").groupBy("contig", "level", _shifted(F.col("at"), F.col("level")).alias("node")).agg(F.max("m").alias("m"))
    found = asked.join(nodes, ["contig", "level", "node"]).groupBy(*RANGE).agg(F.max("m").alias("m"))
    return ranges.join(found, RANGE).select(*(ranges[c] for c in ranges.columns), F.struct((-F.col("m.back")).alias("pos"), F.col("m.value").alias("value")).alias("best"))


def points_around(ranges: DataFrame, points: DataFrame, width: int = WIDTH) -> DataFrame:
    """contig, start and stop of each range once, with the structs (start, stop) ``first``: the first of the points (contig, start, stop)
    that begins at the range's start or behind it, wherever that is, and ``prior``: the last one that begins before it; null without one.
    """
    none = F.lit(None).cast("long")
    own = points.where("contig IS NOT NULL AND start IS NOT NULL").select("contig", F.col("start").cast("long").alias("pos"), F.lit(1).alias("kind"), none.alias("until"), F.struct(F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop")).alias("p"))
    keyed = ranges.where("start <= stop").select("contig", F.col("start").cast("long").alias("pos"), F.lit(0).alias("kind"), F.col("stop").cast("long").alias("until")).distinct()
    asked = keyed.withColumn("p", F.lit(None).cast("struct<start:bigint,stop:bigint>"))
    seen = with_context(own.unionByName(asked), ["contig"], ["pos", "kind", "until", "p"], "pos", width, last={"prior": "p"}, least={"first": F.col("p")})
    return seen.where("kind = 0").select("contig", F.col("pos").alias("start"), F.col("until").alias("stop"), "first", "prior")


def first_in_range(ranges: DataFrame, points: DataFrame, width: int = WIDTH) -> DataFrame:
    """For each range the first of the points (contig, start, stop) that begin in it, as struct ``first``; ranges without one are left out."""
    return ranges.join(points_around(ranges, points, width).where("first.start <= stop").drop("prior"), RANGE)
