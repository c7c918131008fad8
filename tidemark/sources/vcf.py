"""VCF text."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.variants import coordinates, parse_lines, position_text, write_info
from .text import read_lines, with_header


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """Parsed rows with ``ord``, which grows with the line's place."""
    return parse_lines(read_lines(spark, path, ordered=True))


def header(sample: str, optional: tuple[str, ...] = (), today: datetime.date | None = None) -> list[str]:
    day = (today or datetime.date.today()).strftime("%Y%m%d")
    columns = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", sample]
    return ["##fileformat=VCFv4.1", f"##fileDate={day}", *optional, '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', "\t".join(columns)]


def variant_lines(variants: DataFrame) -> DataFrame:
    columns = ["chr", F.col("pos").cast("string"), "id", "ref", "alt", "qual", "filter", write_info(F.col("info"))]
    return variants.select("chr", "pos", F.concat_ws("\t", *columns, F.array_join("opt", "\t")).alias("line"))


def write_vcf(variants: DataFrame, path: str, sample: str, optional: tuple[str, ...] = ()) -> None:
    with_header(variant_lines(variants), header(sample, optional), ["chr", "pos", "line"], "line").write.text(path)


def calls(intervals: DataFrame, alt: str = "<SV>") -> DataFrame:
    """Variant rows of intervals (contig, start, stop): END and SVLEN, genotype 0/1."""
    info = F.create_map(F.lit("TESTING"), F.lit("TESTING"), F.lit("END"), F.col("stop").cast("string"), F.lit("SVLEN"), (F.col("stop") - F.col("start")).cast("string"))
    return intervals.select(F.col("contig").alias("chr"), F.col("start").cast("int").alias("pos"), F.lit(".").alias("id"), F.lit("N").alias("ref"), F.lit(alt).alias("alt"), F.lit(".").alias("qual"), F.lit("None").alias("filter"), info.alias("info"), F.array(F.lit("GT"), F.lit("0/1")).alias("opt"))


def write_calls(intervals: DataFrame, path: str, sample: str, alt: str = "<SV>") -> None:
    write_vcf(calls(intervals, alt), path, sample)


def position_lines(variants: DataFrame) -> DataFrame:
    """``value``: chr1:1,234-5,678 of each event."""
    return coordinates(variants).select(position_text(F.col("chr"), F.col("start"), F.col("stop")).alias("value"))


def file_name(folder: str, contig: str, predictor: str) -> str:
    return f"{folder}/{contig}_{predictor}.vcf"
