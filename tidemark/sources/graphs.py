"""Graphs as text: JSON lines of vertices and edges, and GraphML of a sequence's bases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import vertices_of


def json_lines(edges: DataFrame) -> DataFrame:
    """``value``: a JSON object for each vertex and each edge; a missing weight is 0."""
    nodes = vertices_of(edges).select(F.to_json(F.struct(F.lit("vertex").alias("kind"), "id")).alias("value"))
    weight = F.coalesce("weight", F.lit(0).cast("long")) if "weight" in edges.columns else F.lit(0).cast("long")
    links = edges.select(F.to_json(F.struct(F.lit("edge").alias("kind"), "src", "dst", weight.alias("weight"))).alias("value"))
    return nodes.unionByName(links)


# A colour for each base, red, green and blue.
COLOURS = {"A": (0, 160, 0), "C": (0, 0, 200), "G": (220, 160, 0), "T": (200, 0, 0)}


def _element(base: Column, n: Column) -> Column:
    colour = F.lit("128,128,128")
    for b, c in COLOURS.items():
        colour = F.when(F.upper(base) == b, F.lit(",".join(map(str, c)))).otherwise(colour)
    return F.concat(F.lit('<node id="n'), n.cast("string"), F.lit('"><data key="base">'), base, F.lit('</data><data key="colour">'), colour, F.lit("</data></node>"))


def graphml(spark: SparkSession, sequence: str, backwards: bool = False) -> DataFrame:
    """``value`` by ``ord``: a chain of coloured base nodes, from the end if ``backwards``."""
    letters = spark.createDataFrame([(sequence[::-1] if backwards else sequence,)], "s string").select(F.posexplode(F.filter(F.split("s", ""), lambda x: x != "")).alias("n", "base"))
    nodes = letters.select((F.col("n") + 2).cast("long").alias("ord"), _element(F.col("base"), F.col("n")).alias("value"))
    links = letters.where("n > 0").select((F.col("n") + 2 + len(sequence)).cast("long").alias("ord"), F.concat(F.lit('<edge source="n'), (F.col("n") - 1).cast("string"), F.lit('" target="n'), F.col("n").cast("string"), F.lit('"/>')).alias("value"))
    frame = spark.createDataFrame([(0, '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">'), (1, '<graph edgedefault="directed">'), (2 * len(sequence) + 3, "</graph></graphml>")], "ord long, value string")
    return frame.unionByName(nodes).unionByName(links).orderBy("ord")
