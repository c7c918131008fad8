"""SAM text as reads, and as a sink."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cigar import is_clipped, leading_clip, operations, reference_length, trailing_clip
from .text import read_lines, with_header

RAW = "file_ord long, qname string, flag int, contig string, aln_start int, mapq int, cigar string, mate_contig string, mate_start int, tlen int, seq string, qual string, nm int"


def with_derived(raw: DataFrame) -> DataFrame:
    """The columns that operators use, from the eleven of the format and the NM tag."""
    bit = lambda n: F.col("flag").bitwiseAND(F.lit(n)) != 0
    ops = operations(F.col("cigar"))
    rows = raw.withColumn("__ops", ops).withColumn("ref_len", reference_length(F.col("__ops")))
    mate = F.when(F.col("mate_contig") == "=", F.col("contig")).otherwise(F.col("mate_contig"))
    rows = rows.withColumn("mate_contig", mate).withColumn("aln_end", F.col("aln_start") + F.greatest("ref_len", F.lit(1)) - 1)
    flags = {"unmapped": 4, "mate_unmapped": 8, "is_reverse": 16, "mate_reverse": 32, "proper_pair": 2, "vendor_fail": 512}
    rows = rows.select("*", *(bit(n).alias(c) for c, n in flags.items()), F.size("__ops").alias("n_cigar"), is_clipped(F.col("__ops")).alias("is_clipped"))
    return rows.withColumn("unclipped_start", F.col("aln_start") - leading_clip(F.col("__ops"))).withColumn("unclipped_end", F.col("aln_end") + trailing_clip(F.col("__ops"))).drop("__ops")


def parse(lines: DataFrame) -> DataFrame:
    """Reads of SAM lines (value, ord); header lines are left out."""
    f = F.split("value", "\t")
    at = lambda i: F.get(f, F.lit(i))
    nm = F.regexp_extract(F.array_join(F.slice(f, F.lit(12), F.greatest(F.size(f), F.lit(1))), "\t"), r"(?:^|\t)NM:i:(-?[0-9]+)", 1)
    raw = lines.where(~F.col("value").startswith("@") & (F.col("value") != "")).select(
        F.col("ord").alias("file_ord"), at(0).alias("qname"), at(1).cast("int").alias("flag"), at(2).alias("contig"), at(3).cast("int").alias("aln_start"), at(4).cast("int").alias("mapq"),
        at(5).alias("cigar"), at(6).alias("mate_contig"), at(7).cast("int").alias("mate_start"), at(8).cast("int").alias("tlen"), at(9).alias("seq"), at(10).alias("qual"), F.when(nm != "", nm).cast("int").alias("nm"),
    )
    return with_derived(raw)


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    return parse(read_lines(spark, path, ordered=True))


def header_contigs(spark: SparkSession, path: str) -> DataFrame:
    """(region, size) of the @SQ lines."""
    lines = read_lines(spark, path).where(F.col("value").startswith("@SQ"))
    return lines.select(F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("region"), F.regexp_extract("value", r"\tLN:([0-9]+)", 1).cast("int").alias("size"))


def sam_lines(reads: DataFrame) -> DataFrame:
    columns = ["qname", "flag", "contig", "aln_start", "mapq", "cigar", "mate_contig", "mate_start", "tlen", "seq", "qual"]
    text = [F.coalesce(F.col(c).cast("string"), F.lit("*")) for c in columns]
    tag = F.when(F.col("nm").isNotNull(), F.concat(F.lit("NM:i:"), F.col("nm").cast("string")))
    return reads.select("contig", "aln_start", "file_ord", F.concat_ws("\t", *text, tag).alias("line"))


def write_sam(reads: DataFrame, path: str, contigs: list[tuple[str, int]]) -> None:
    head = ["@HD\tVN:1.6\tSO:coordinate", *(f"@SQ\tSN:{n}\tLN:{s}" for n, s in contigs)]
    with_header(sam_lines(reads), head, ["contig", "aln_start", "file_ord"], "line").write.text(path)


def write_contig_sizes(contigs: DataFrame, path: str) -> None:
    contigs.select("region", "size").write.csv(path, sep="\t")


_OPS = "MIDNSHP=X"
_TAG_SIZE = {b"A": 1, b"c": 1, b"C": 1, b"s": 2, b"S": 2, b"i": 4, b"I": 4, b"f": 4}
_TAG_FORMAT = {b"c": "<b", b"C": "<B", b"s": "<h", b"S": "<H", b"i": "<i", b"I": "<I"}


def _edit_distance(tags: bytes) -> int | None:
    at = 0
    while at + 3 <= len(tags):
        name, kind = tags[at : at + 2], tags[at + 2 : at + 3]
        at += 3
        if name == b"NM" and kind in _TAG_FORMAT:
            return struct.unpack_from(_TAG_FORMAT[kind], tags, at)[0]
        if kind in (b"Z", b"H"):
            at = tags.index(0, at) + 1
        elif kind == b"B":
            at += 5 + _TAG_SIZE[tags[at : at + 1]] * struct.unpack_from("<i", tags, at + 1)[0]
        else:
            at += _TAG_SIZE[kind]
    return None
