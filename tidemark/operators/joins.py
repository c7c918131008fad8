"""Interval joins: overlap and containment by bins of several sizes, as-of lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import cut
from .ranges import RANGE, argmax_in_range, points_around

#: Positions of one bin where starts are looked up in bins of one size.
BIN = 1 << 10
#: Positions of the finest bins of an overlap join, by how much the next level's are larger, and number of levels.
FINEST, FACTOR, LEVELS = 1 << 6, 8, 13
#: Left rows of one bin that one task joins.
MOST = 100_000


def bin_size(level: Column, finest: int) -> Column:
    return F.element_at(F.array(*(F.lit(finest * FACTOR**k) for k in range(LEVELS))), level + 1)


def in_bins(df: DataFrame, left: bool, finest: int = FINEST) -> DataFrame:
    """Rows (item, contig, part, level, bin) of an overlap join's side: where each interval is to meet the other side's.

    An interval is at home on the first level whose bins are as long as it is, so in two bins at most. Two intervals meet
    at the home of the longer one, where the other one is a guest: part 1 has left homes and their right guests (of the same
    level or less), part 2 right homes and their left guests (of a lower level). Rows with nulls or with stop before start are left out.
    """
    rows = df.where("contig IS NOT NULL AND start <= stop").select(F.struct(*df.columns).alias("item"), "contig", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))
    long_as = F.array(*(F.lit(finest * FACTOR**k) for k in range(LEVELS - 1)))
    rows = rows.withColumn("home", F.size(F.filter(long_as, lambda w: w < F.col("stop") - F.col("start") + 1)))
    at_home = [(1, F.lit(True))] if left else [(1, F.lit(True)), (2, F.lit(True))]
    guest = 2 if left else 1

    def places(level: Column) -> Column:
        w = bin_size(level, finest)
        bins = F.sequence(F.floor(F.col("start") / w), F.floor(F.col("stop") / w))
        own = F.array(*(F.lit(p) for p, _ in at_home))
        parts = F.when(level == F.col("home"), own).otherwise(F.array(F.lit(guest)))
        return F.flatten(F.transform(parts, lambda p: F.transform(bins, lambda b: F.struct(p.alias("part"), level.alias("level"), b.alias("bin")))))

    every = F.flatten(F.transform(F.sequence("home", F.lit(LEVELS - 1)), places))
    return rows.select("item", "contig", "home", F.explode(every).alias("x")).select("item", "contig", "home", "x.part", "x.level", "x.bin")


def overlap_join(left: DataFrame, right: DataFrame, how: str = "overlap", bin_width: int = FINEST, most: int = MOST) -> DataFrame:
    """Pairs of rows (as structs ``a`` and ``b``) of one contig whose closed [start, stop] overlap; ``how="within"``: a lies in b.

    Intervals meet in bins that fit the longer one (``in_bins``), so it is an equi-join however lengths differ. A bin with more
    than ``most`` left rows is dealt to several tasks by a hash of them, with its right rows in each; left rows that are
    equal in all columns stay together. Rows with stop before start or nulls meet nothing.
    """
    keys = ["contig", "part", "level", "bin"]
    a, b = in_bins(left, True, bin_width), in_bins(right, False, bin_width)
    # Only levels that are some interval's home are visited: part 1 has left homes, part 2 right ones. A few rows.
    homes = a.where("part = 1").select("part", "level").distinct().unionByName(b.where("part = 2").select("part", "level").distinct())
    a, b = (x.drop("home").join(F.broadcast(homes), ["part", "level"]) for x in (a, b))
    hot = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(*keys, F.ceil(F.col("n") / most).cast("int").alias("tasks"))
    a = a.join(hot, keys, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("item"), F.col("tasks")).cast("int"), F.lit(0))).drop("tasks")
    b = b.join(hot, keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("tasks", F.lit(1)) - 1))).drop("tasks")
    a, b = a.withColumnRenamed("item", "a"), b.withColumnRenamed("item", "b")
    over = (F.col("a.start") <= F.col("b.stop")) & (F.col("b.start") <= F.col("a.stop"))
    once = F.col("bin") == F.floor(F.greatest("a.start", "b.start") / bin_size(F.col("level"), bin_width))
    inside = (F.col("a.start") >= F.col("b.start")) & (F.col("a.stop") <= F.col("b.stop")) if how == "within" else F.lit(True)
    return a.join(b, [*keys, "salt"]).where(over & once & inside).select("a", "b")


def bridge(ranges: DataFrame, bridges: DataFrame) -> DataFrame:
    """For each range (contig, start, stop, ...) the bridge that meets it, as (from, to).

    That is the first bridge that begins in the range; else the last one that begins before it, if it reaches the range's
    start: then (the range's middle, the bridge's stop). Ranges that no bridge meets are left out.
    """
    # Ranges and bridges are read several times: they are written down.
    ranges, bridges = cut(ranges, "ranges"), cut(bridges.select("contig", "start", "stop"), "bridges")
    both = points_around(ranges, bridges)
    both = both.select(*RANGE, F.when(F.col("first.start") <= F.col("stop"), F.col("first")).alias("first"), F.when(F.col("prior.stop") >= F.col("start"), F.col("prior")).alias("last"))
    middle = F.expr("start + (stop - start) div 2")
    found = both.select(*RANGE, F.when(F.col("first").isNotNull(), F.struct(F.col("first.start").cast("long").alias("from"), F.col("first.stop").cast("long").alias("to"))).when(F.col("last").isNotNull(), F.struct(middle.cast("long").alias("from"), F.col("last.stop").cast("long").alias("to"))).alias("bridge")).where("bridge IS NOT NULL")
    return ranges.join(found, RANGE)


def started_bridged_ended(starters: DataFrame, enders: DataFrame, bridges: DataFrame, around: int = 5) -> DataFrame:
    """(contig, start, stop) from a starter (contig, pos, value) over a bridge (contig, start, stop) to the ender of largest value.

    A bridge is looked up around the starter, the ender around what the bridge covers. start may lie behind stop.
    """
    near = starters.select("contig", (F.col("pos") - around).alias("start"), (F.col("pos") + around).alias("stop"), F.col("pos").alias("starter"))
    over = cut(bridge(near, bridges).select("contig", F.col("bridge.from").alias("start"), (F.col("bridge.to") + around).alias("stop"), "starter"), "bridged")
    return argmax_in_range(over, enders).select("contig", F.col("starter").alias("start"), F.col("best.pos").alias("stop"))


def reciprocal_overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Overlap as a share of the longer interval, lengths of one at least; 0 if disjoint."""
    over = F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2)).cast("double")
    return over / F.greatest(F.greatest(e1 - s1, F.lit(1)), F.greatest(e2 - s2, F.lit(1)))


def in_interval(pos: Column, start: Column, stop: Column) -> Column:
    return pos.between(start, stop)


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return (s1 <= e2) & (s2 <= e1)


def intersection(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Struct (start, stop) of the common part, null if there is none."""
    return F.when(overlaps(s1, e1, s2, e2), F.struct(F.greatest(s1, s2).alias("start"), F.least(e1, e2).alias("stop")))
