"""Depth sweeps: from intervals with a score to segments of constant depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import cut
from .ordered import WIDTH, with_context


def events(intervals: DataFrame, keys: list[str], start: str, stop: str, score: Column) -> DataFrame:
    """``keys``, pos and delta: +score at the start and -score at the (inclusive) end, added up per position."""
    both = F.explode(F.array(F.struct(F.col(start).alias("pos"), score.cast("long").alias("delta")), F.struct(F.col(stop).alias("pos"), (-score).cast("long").alias("delta"))))
    return intervals.where(F.col(start).isNotNull() & F.col(stop).isNotNull()).select(*keys, both.alias("e")).groupBy(*keys, "e.pos").agg(F.sum("e.delta").alias("delta"))


def segments(changes: DataFrame, keys: list[str], width: int = WIDTH) -> DataFrame:
    """``keys``, start, stop, value: the running sum of delta from each position to the next, led in by a zero segment of one position.

    An interval that starts and ends at one position adds nothing. The last position begins no segment; a key with one
    position has only its lead-in. No segment spans two keys.
    """
    rows = with_context(changes, keys, ["pos"], "pos", width, before={"prev": ["pos"]}, after={"next": ["pos"]}, sums={"value": F.col("delta")})
    segment = F.when(F.col("next").isNotNull(), F.struct(F.col("pos").alias("start"), F.col("next.pos").alias("stop"), F.col("value").alias("value")))
    lead_in = F.when(F.col("prev").isNull(), F.struct((F.col("pos") - 1).alias("start"), F.col("pos").alias("stop"), F.lit(0).cast("long").alias("value")))
    return rows.select(*keys, F.explode(F.array(segment, lead_in)).alias("s")).where("s IS NOT NULL").select(*keys, "s.start", "s.stop", "s.value")


def depth(intervals: DataFrame, keys: list[str], start: str, stop: str, score: Column | None = None, width: int = WIDTH) -> DataFrame:
    """Segments of intervals. Their events, one row a position, are written down: intervals are read and shuffled once."""
    return segments(cut(events(intervals, keys, start, stop, F.lit(1) if score is None else score), "events"), keys, width)


def as_bed(segs: DataFrame) -> DataFrame:
    """One-based segments to BED: one is subtracted from both ends."""
    return segs.withColumn("start", F.col("start") - 1).withColumn("stop", F.col("stop") - 1)
