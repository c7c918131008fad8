"""Aligned reads: the eleven signals' predicates, filters by region, sample statistics.

Columns: file_ord (any order of the reads), qname string, contig string, aln_start int (from 1), aln_end int (inclusive), unclipped_start int,
unclipped_end int, mate_contig string, mate_start int, tlen int, mapq int, unmapped, mate_unmapped, is_reverse,
mate_reverse, proper_pair, vendor_fail boolean, cigar string, n_cigar int, is_clipped boolean, ref_len int, nm int, seq string.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import legacy_percentile
from ..tables import cut
from .ordered import WIDTH
from .sweep import as_bed, depth, segments

MAIN_CONTIG = r"^(chr)?([0-9]+|[XxYy])$"


@dataclass(frozen=True)
class Limits:
    """least and most are the insert sizes beyond which a pair counts as too close or too far; clip is a clipped read's largest reference length, exclusive."""

    least: int = 250
    most: int = 750
    clip: int = 222


def orientation() -> Column:
    """TANDEM if both mates lie on one strand, else FR if the forward mate's 5' end lies left of the reverse mate's, else RF."""
    forward = F.when(F.col("is_reverse"), F.col("mate_start")).otherwise(F.col("aln_start"))
    reverse = F.when(F.col("is_reverse"), F.col("aln_end")).otherwise(F.col("aln_start") + F.col("tlen"))
    return F.when(F.col("is_reverse") == F.col("mate_reverse"), "TANDEM").when(forward < reverse, "FR").otherwise("RF")


def signals(limits: Limits = Limits()) -> dict[str, tuple[Column, Column]]:
    """name -> (predicate, score), for mapped reads."""
    good, one = F.col("mapq") != 0, F.lit(1)
    paired, same = ~F.col("mate_unmapped"), F.col("mate_contig") == F.col("contig")
    size = F.abs("tlen")
    far = good & paired & (orientation() == "FR") & (size > limits.most)
    return {
        "Coverage": (good, one),
        "Clipped": (good & (F.col("ref_len") < limits.clip) & F.col("is_clipped"), one),
        "MAPQ0": (~good, one),
        "InterChr": (good & paired & ~same, one),
        "DiscordantTandemOrientation": (good & paired & same & (orientation() == "TANDEM"), one),
        "MappingErrors": (good & F.col("nm").isNotNull() & (F.col("nm") != 0), F.col("nm")),
        "InsertSizeTooSmall": (good & paired & (size < limits.least), one),
        "InsertSizeTooBig": (far, one),
        "CigarIndels": (good & (F.col("n_cigar") > 2), one),
        "MateUnmapped": (good & F.col("mate_unmapped"), one),
        "ForwardInsertSizeTooBig": (far & ~F.col("is_reverse"), one),
    }


def signal_segments(reads: DataFrame, limits: Limits = Limits(), names: list[str] | None = None, width: int = WIDTH) -> DataFrame:
    """(signal, contig, start, stop, value): the depth of every signal in one scan and one shuffle of the reads' events."""
    chosen = {k: v for k, v in signals(limits).items() if names is None or k in names}
    hits = F.filter(F.array(*(F.when(p, F.struct(F.lit(k).alias("signal"), s.cast("long").alias("score"))) for k, (p, s) in chosen.items())), lambda x: x.isNotNull())
    ends = F.explode(F.array(F.struct(F.col("aln_start").alias("pos"), F.col("h.score").alias("delta")), F.struct(F.col("aln_end").alias("pos"), (-F.col("h.score")).alias("delta"))))
    rows = reads.where(~F.col("unmapped")).select("contig", "aln_start", "aln_end", F.explode(hits).alias("h")).select("h.signal", "contig", ends.alias("e"))
    # One row a signal and position; written down, so that nothing behind reads the reads again.
    return segments(cut(rows.groupBy("signal", "contig", "e.pos").agg(F.sum("e.delta").alias("delta")), "events"), ["signal", "contig"], width)


def named_signal(reads: DataFrame, name: str, threshold: int = 0, width: int = WIDTH) -> DataFrame:
    """Depth by one of the plain predicates, as BED: all, clipped, mapq0, edit, tandem, tandem_mapped. tandem: any orientation but FR."""
    other = ~F.col("mate_unmapped") & (F.col("mate_contig") == F.col("contig")) & (orientation() != "FR")
    predicate = {
        "all": F.lit(True),
        "clipped": F.col("is_clipped"),
        "mapq0": F.col("mapq") == 0,
        "edit": edit_distance_over(threshold),
        "tandem": other,
        "tandem_mapped": other & (F.col("mapq") != 0),
    }[name]

    return as_bed(depth(reads.where(~F.col("unmapped") & predicate), ["contig"], "aln_start", "aln_end", width=width))


def edit_distance_over(threshold: int) -> Column:
    return F.coalesce(F.col("nm") > threshold, F.lit(False))


def on_region(reads: DataFrame, contig: str, start: int = 0, stop: int = 0, contained: bool = False) -> DataFrame:
    """Reads of a contig that overlap the closed [start, stop] (from 1; stop 0: to its end), or lie in it if ``contained``."""
    rows = reads.where(F.col("contig") == contig)
    if contained:
        return rows.where((F.col("aln_start") >= start) & ((F.col("aln_end") <= stop) if stop else F.lit(True)))
    return rows.where((F.col("aln_end") >= start) & ((F.col("aln_start") <= stop) if stop else F.lit(True)))


def main_contigs(contigs: DataFrame) -> DataFrame:
    """(region, size) of the numbered and sex contigs."""
    return contigs.where(F.col("region").rlike(MAIN_CONTIG)).select("region", "size")


def read_counts(reads: DataFrame) -> DataFrame:
    return reads.agg(F.count(F.lit(1)).alias("n_records"), F.count_if("mate_unmapped").alias("n_unmapped_mates"))


def fragment_thresholds(reads: DataFrame, order: list[str], n: int = 10_000, low: float = 0.5, high: float = 99.5) -> DataFrame:
    """Statistics of |tlen| of the first ``n`` qualifying reads by ``order``: mean, median, sample deviation, scaled MAD and the two percentiles.

    The sample is bounded by ``n``, so one sorted array holds it.
    """
    good = ~F.col("unmapped") & ~F.col("mate_unmapped") & (F.col("contig") == F.col("mate_contig")) & (F.col("mapq") > 0) & (F.col("tlen") != 0)
    sizes = reads.where(good).orderBy(*order).limit(n).select(F.abs("tlen").cast("double").alias("x"))
    one = sizes.agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("stddev"), F.sort_array(F.collect_list("x")).alias("xs"))
    one = one.withColumn("median", legacy_percentile(F.col("xs"), 50.0))
    one = one.withColumn("mad", 1.4826 * legacy_percentile(F.sort_array(F.transform("xs", lambda x: F.abs(x - F.col("median")))), 50.0))
    return one.select("mean", "median", "stddev", "mad", legacy_percentile(F.col("xs"), low).alias("low"), legacy_percentile(F.col("xs"), high).alias("high"))


def read_length(reads: DataFrame, order: list[str], length: Column, n: int = 10_000) -> DataFrame:
    """(length, homogeneous) of the first ``n`` qualifying reads: the one length, else the integer mean of the distinct ones."""
    good = ~F.col("unmapped") & (F.col("mapq") > 0)
    return reads.where(good).orderBy(*order).limit(n).agg(F.collect_set(length.cast("long")).alias("l")).select(F.expr("aggregate(l, 0L, (a, x) -> a + x) div nullif(size(l), 0)").alias("length"), (F.size("l") == 1).alias("homogeneous"))
