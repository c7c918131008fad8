"""BED and bedGraph: 0-based, half-open entries of one contig, with an integer, double or text value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import read_lines, with_header

PATTERN = {"int": "\t", "double": r"\s+", "string": "\t"}


def parse(lines: DataFrame, kind: str = "int") -> DataFrame:
    """contig, start, stop, value of lines ``value`` but comments and track lines. Malformed numbers fail."""
    f = F.split("value", PATTERN[kind])
    rows = lines.where(~(F.col("value").startswith("#") | F.col("value").startswith("track")) & (F.trim("value") != ""))
    value = F.array_join(F.slice(f, F.lit(4), F.greatest(F.size(f), F.lit(1))), "\t") if kind == "string" else F.get(f, F.lit(3)).cast("long" if kind == "int" else "double")
    return rows.select(F.get(f, F.lit(0)).alias("contig"), F.get(f, F.lit(1)).cast("long").alias("start"), F.get(f, F.lit(2)).cast("long").alias("stop"), value.alias("value"))


def read_bed(spark: SparkSession, path: str, kind: str = "int") -> DataFrame:
    return parse(read_lines(spark, path), kind)


def count_map(spark: SparkSession, path: str, contig: str) -> DataFrame:
    """contig, pos, value of one contig; of entries that start together the last in the file wins."""
    return last_counts(read_lines(spark, path, ordered=True), contig)


def last_counts(lines: DataFrame, contig: str) -> DataFrame:
    """The same of lines (value, ord)."""
    f = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("#")).select(F.get(f, F.lit(0)).alias("contig"), F.get(f, F.lit(1)).cast("long").alias("pos"), F.get(f, F.lit(3)).cast("long").alias("v"), "ord").where(F.col("contig") == contig)
    return rows.groupBy("contig", "pos").agg(F.max_by("v", "ord").alias("value"))


def bed_lines(entries: DataFrame, value: str = "value") -> DataFrame:
    return entries.select("contig", "start", "stop", F.concat_ws("\t", "contig", F.col("start").cast("string"), F.col("stop").cast("string"), F.col(value).cast("string")).alias("line"))


def write_bed(entries: DataFrame, path: str, value: str = "value", compression: str = "none") -> None:
    bed_lines(entries, value).orderBy("contig", "start", "stop").select("line").write.text(path, compression=compression)


def write_bedgraph(entries: DataFrame, path: str, name: str, description: str, compression: str = "gzip") -> None:
    """With a comment and a track line; white space in the name becomes an underscore."""
    track = "track type=bedGraph name={} description={}".format(*("_".join(x.split()) for x in (name, description)))
    with_header(bed_lines(entries), ["# written by tidemark", track], ["contig", "start", "stop"], "line").write.text(path, compression=compression)


def append_bedgraph(entries: DataFrame, path: str, compression: str = "gzip") -> None:
    bed_lines(entries).orderBy("contig", "start", "stop").select("line").write.mode("append").text(path, compression=compression)


def commented(entries: DataFrame, comment: str) -> DataFrame:
    """``line`` of each entry with one comment in the fourth field, white space in it made visible."""
    return bed_lines(entries.withColumn("comment", F.regexp_replace(F.lit(comment), r"\s", "¬")), "comment")


def write_warnings(entries: DataFrame, path: str, comment: str = "low coverage") -> None:
    """BED of places to be looked at, such as entries of low coverage."""
    commented(entries, comment).orderBy("contig", "start", "stop").select("line").write.text(path)
