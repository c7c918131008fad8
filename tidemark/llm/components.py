"""Connected components by alternating large-star and small-star.

After Kiveris et al., "Connected Components in MapReduce and Beyond" (SoCC 2014).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each node's larger neighbours to the least node of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    return both.where("b > a").join(least, "a").select(F.least("a", "m").alias("a"), "b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the least of them. edges: a < b."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").where("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.unionByName(least.select(F.col("m").alias("a"), "b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in ``edges`` (a, b): component is the least node reachable.

    Self-links and null ends are left out; repeated and reversed edges count once. Without edges there are no rows.
    The rounds end when a round changes no edge; each round's edges are a table in the shared folder.
    """
    ends = edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    current, before = cut(ends, "edges"), None
    while True:
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state[0] == 0 or state == before:
            break
        before = state
        current = cut(_small_star(_large_star(current).distinct()).distinct(), "edges")
    stars = current.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return stars.unionByName(current.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
