"""Jumps, falls, peaks and level segments of signals (contig, start, stop, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .islands import KEYS, _numbered
from .ordered import WIDTH, with_context, with_neighbour


def _before(signal: DataFrame, keys: list[str], width: int) -> DataFrame:
    return with_neighbour(signal, keys, ["start", "stop"], ["start", "stop", "value"], "start", "prev", width=width)


def jumps(signal: DataFrame, least: int = 10, ratio: float | None = None, keys: list[str] = KEYS, width: int = WIDTH) -> DataFrame:
    """(contig, start, start + 1, height) where a touching neighbour differs by ``least`` or more, and by ``ratio`` of the larger value if given."""
    rows = _before(signal, keys, width).withColumn("height", F.col("value") - F.col("prev.value"))
    hit = (F.col("prev.stop") == F.col("start")) & (F.abs("height") >= least)
    if ratio is not None:
        hit &= F.abs("height") >= ratio * F.greatest("value", "prev.value")
    return rows.where(hit).select(*keys, "start", (F.col("start") + 1).alias("stop"), "height")


def changes(signal: DataFrame, over: int = 10, keys: list[str] = KEYS, width: int = WIDTH) -> DataFrame:
    """Neighbours that differ by more than ``over``, touching or not: kind jump or fall and the absolute height."""
    rows = _before(signal, keys, width).withColumn("d", F.col("value") - F.col("prev.value")).where(F.abs("d") > over)
    return rows.select(*keys, "start", "stop", F.when(F.col("d") > 0, "jump").otherwise("fall").alias("kind"), F.abs("d").alias("height"))


def jumps_with_gaps(signal: DataFrame, over: int, keys: list[str] = KEYS, width: int = WIDTH) -> DataFrame:
    """Differences of more than ``over``, where what lies in a gap counts as zero; ``at_gap`` marks those at a gap's ends."""
    rows = _before(signal, keys, width)
    touching = F.coalesce(F.col("prev.stop") == F.col("start"), F.lit(False))
    into = F.struct(F.col("start").alias("pos"), (F.col("value") - F.when(touching, F.col("prev.value")).otherwise(0)).alias("height"), (~touching).alias("at_gap"))
    out = F.when(F.col("prev").isNotNull() & ~touching, F.struct(F.col("prev.stop").alias("pos"), (-F.col("prev.value")).alias("height"), F.lit(True).alias("at_gap")))
    return rows.select(*keys, F.explode(F.array(into, out)).alias("j")).where(F.abs("j.height") > over).select(*keys, "j.*")


def count_jumps(counts: DataFrame, start: int, stop: int, over: int, keys: list[str] = KEYS, width: int = WIDTH) -> DataFrame:
    """Differences of more than ``over`` between neighbouring counts (contig, pos, value) with start <= pos < stop."""
    inside = counts.where((F.col("pos") >= start) & (F.col("pos") < stop))
    rows = with_neighbour(inside, keys, ["pos"], ["value"], "pos", "prev", width=width).withColumn("height", F.col("value") - F.col("prev.value"))
    return rows.where(F.abs("height") > over).select(*keys, "pos", "height")


def derivative(signal: DataFrame, keys: list[str] = KEYS, width: int = WIDTH) -> DataFrame:
    """First differences as entries of no length."""
    return _before(signal, keys, width).where("prev IS NOT NULL").select(*keys, "start", F.col("start").alias("stop"), (F.col("value") - F.col("prev.value")).alias("value"))


def peaks(signal: DataFrame, over: int, keys: list[str] = KEYS, width: int = WIDTH) -> DataFrame:
    """Entries larger than ``over`` and than both neighbours, touching or not; the first and the last entry have one neighbour and are none."""
    rows = with_context(signal, keys, ["start", "stop"], "start", width, before={"prev": ["value"]}, after={"next": ["value"]})
    return rows.where((F.col("value") > over) & (F.col("value") > F.col("prev.value")) & (F.col("value") > F.col("next.value"))).select(*keys, "start", "stop", "value")


def level_segments(signal: DataFrame, edge: int = 6, keys: list[str] = KEYS, width: int = WIDTH) -> DataFrame:
    """Segments between edges: a gap, a zero on either side, or a difference of more than ``edge``. Value: mean weighted by length, integer division."""

    def begins(prev: Column) -> Column:
        return (prev["stop"] != F.col("start")) | (prev["value"] == 0) | (F.col("value") == 0) | (F.abs(F.col("value") - prev["value"]) > edge)

    rows = _numbered(signal, keys, ["start", "stop"], begins, ["stop", "value"], width)
    area = F.sum(F.col("value") * (F.col("stop") - F.col("start"))).alias("area")
    return rows.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), area).select(*keys, "start", "stop", F.expr("area div greatest(1, stop - start)").alias("value"))


def average_depth(signal: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Mean value by length over what is covered, integer division; null where nothing is."""
    covered = F.col("value") > 0
    length = F.col("stop") - F.col("start")
    return signal.groupBy(*keys).agg(F.sum(F.when(covered, F.col("value") * length)).alias("area"), F.sum(F.when(covered, length)).alias("length")).select(*keys, F.expr("area div nullif(length, 0)").alias("depth"))


def low_coverage(signal: DataFrame, most: int) -> DataFrame:
    """Entries of value ``most`` at most."""
    return signal.where(F.col("value") <= most)


def over_share(signal: DataFrame, depth: int, share: float = 2 / 3) -> DataFrame:
    """Entries with value 1 where the value exceeds ``share`` of ``depth``, else 0."""
    return signal.withColumn("value", F.when(F.col("value") > depth * share, 1).otherwise(0))
