"""Command line: version, regions, extract-region, signal extract, vcf generate, vcf re-identify, vcf compare."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .operators.reads import Limits, fragment_thresholds, main_contigs, on_region, read_length, signal_segments
from .operators.sweep import as_bed
from .operators.variants import coordinates, renumber, statistics
from .plans.callers import callers
from .session import session
from .sources.bed import write_bedgraph
from .sources.bam import bam_contigs, read_bam, write_bam
from .sources.sam import header_contigs, read_sam, write_contig_sizes, write_sam
from .sources.text import read_lines, with_header
from .sources.vcf import read_vcf, write_calls
from .tables import clean


def _reads(spark: SparkSession, path: str) -> DataFrame:
    return read_bam(spark, path) if path.endswith(".bam") else read_sam(spark, path)


def _contigs(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame(bam_contigs(path), "region string, size int") if path.endswith(".bam") else header_contigs(spark, path)


def _limits(reads: DataFrame) -> Limits:
    t = fragment_thresholds(reads, ["file_ord"]).first()
    return Limits(int(t.low), int(t.high)) if t and t.low is not None else Limits()


def check_regions(asked: list[str], there: list[str]) -> tuple[list[str], list[str]]:
    """(asked regions that are there, those that aren't)."""
    return [r for r in asked if r in there], [r for r in asked if r not in there]


def _on_regions(reads: DataFrame, regions: list[str]) -> DataFrame:
    return reads.where(F.col("contig").isin(regions)) if regions else reads


def _extract(spark: SparkSession, a: argparse.Namespace) -> None:
    reads = _reads(spark, a.input)
    segs = signal_segments(_on_regions(reads, a.region), _limits(reads))
    segs.write.partitionBy("signal", "contig").mode("overwrite").parquet(f"{a.output}/signals")
    if a.bedgraph:
        stored = spark.read.parquet(f"{a.output}/signals")
        for name in [r.signal for r in stored.select("signal").distinct().orderBy("signal").collect()]:  # eleven at most
            write_bedgraph(as_bed(stored.where(F.col("signal") == name)), f"{a.output}/{name}.bedgraph", name, name)


def _region(spark: SparkSession, a: argparse.Namespace) -> None:
    contig, _, span = a.region.partition(":")
    start, stop = (int(x.replace(",", "")) for x in span.split("-")) if span else (1, 1 << 31)
    contigs = [(r.region, r.size) for r in _contigs(spark, a.input).collect()]  # a header's lines
    found, missing = check_regions([contig], [name for name, _ in contigs])
    if missing:
        raise SystemExit(f"no such contig: {contig}")
    reads = read_bam(spark, a.input, found[0], start, stop) if a.input.endswith(".bam") else read_sam(spark, a.input)
    rows = on_region(reads, found[0], start, stop, a.contained)
    if a.bam:
        write_bam(rows, a.output, contigs, a.files)
    else:
        write_sam(rows, a.output, contigs)


def _generate(spark: SparkSession, a: argparse.Namespace) -> None:
    reads = _on_regions(_reads(spark, a.input), a.region)
    signals = spark.read.parquet(a.signals)
    signals = signals.where(F.col("contig").isin(a.region)) if a.region else signals
    length = read_length(reads, ["file_ord"], F.length("seq").cast("long")).first().length or 100
    for name, call in callers(_limits(reads), length, a.coverage).items():
        if not a.caller or name in a.caller:
            write_calls(call(signals, reads).select("contig", "start", "stop"), f"{a.output}/{name}.vcf", a.sample)


def _regions(spark: SparkSession, a: argparse.Namespace) -> None:
    contigs = main_contigs(_contigs(spark, a.input))
    if a.output:
        write_contig_sizes(contigs, a.output)
    else:
        for r in contigs.orderBy(F.desc("size")).collect():  # a header's lines
            print(f"{r.region}\t{r.size}")


def _reidentify(spark: SparkSession, a: argparse.Namespace) -> None:
    lines = read_lines(spark, a.input, ordered=True)
    with_header(renumber(lines, "ord", a.prefix), [], ["ord"], "value").write.text(a.output)


def _compare(spark: SparkSession, a: argparse.Namespace) -> None:
    sides = [coordinates(read_vcf(spark, p)).select(F.col("chr").alias("contig"), "start", "stop", "ord") for p in (a.truth, a.candidates)]
    statistics(*sides, ["ord"]).orderBy(F.col("contig").asc_nulls_last()).show(1 << 30, truncate=False)  # a row a contig


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("tidemark", description=__doc__)
    top = p.add_subparsers(dest="task", required=True)
    top.add_parser("version", help="print the version")
    r = top.add_parser("regions", help="list the numbered and sex contigs of a SAM header, largest first")
    r.add_argument("-i", "--input", required=True)
    r.add_argument("-o", "--output")
    r.set_defaults(run=_regions)
    sig = top.add_parser("signal", help="signals of reads").add_subparsers(dest="sub", required=True)
    e = sig.add_parser("extract", help="depth of all signals, as Parquet by signal and contig")
    e.add_argument("-i", "--input", required=True)
    e.add_argument("-o", "--output", required=True)
    e.add_argument("-r", "--region", nargs="*", default=[])
    e.add_argument("--bedgraph", action="store_true")
    e.set_defaults(run=_extract)
    x = top.add_parser("extract-region", help="the reads of a region (contig or contig:start-stop) as SAM or BAM")
    x.add_argument("-i", "--input", required=True)
    x.add_argument("-o", "--output", required=True)
    x.add_argument("-r", "--region", required=True)
    x.add_argument("--contained", action="store_true", help="only reads that lie within it")
    x.add_argument("--bam", action="store_true", help="write a folder of indexed BAM files")
    x.add_argument("--files", type=int, help="how many")
    x.set_defaults(run=_region)
    vcf = top.add_parser("vcf", help="variant files").add_subparsers(dest="sub", required=True)
    g = vcf.add_parser("generate", help="call events from signals and reads")
    g.add_argument("-i", "--input", required=True)
    g.add_argument("-s", "--signals", required=True)
    g.add_argument("-o", "--output", required=True)
    g.add_argument("-r", "--region", nargs="*", default=[])
    g.add_argument("--caller", nargs="*", default=[])
    g.add_argument("--coverage", type=int, default=30)
    g.add_argument("--sample", default="sample")
    g.set_defaults(run=_generate)
    i = vcf.add_parser("re-identify", help="number the rows' ids")
    i.add_argument("-i", "--input", required=True)
    i.add_argument("-o", "--output", required=True)
    i.add_argument("-p", "--prefix", default="")
    i.set_defaults(run=_reidentify)
    c = vcf.add_parser("compare", help="precision and recall against a truth set, by contig")
    c.add_argument("-t", "--truth", required=True)
    c.add_argument("-c", "--candidates", required=True)
    c.set_defaults(run=_compare)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.task == "version":
        print(__version__)
        return 0
    began = time.perf_counter()
    spark = session()
    a.run(spark, a)
    clean(spark)
    print(f"{time.perf_counter() - began:.1f} s", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
