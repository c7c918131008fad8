"""Event callers: from signals (signal, contig, start, stop, value) and reads to intervals and variant rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.edges import average_depth, jumps, level_segments, peaks
from ..operators.islands import fill_missing, join_close, join_touching, merge_overlapping, predicate_runs
from ..operators.joins import overlap_join, started_bridged_ended
from ..operators.ordered import with_running_sum
from ..operators.reads import Limits, orientation
from ..tables import cut

#: Positions of one bin of event-to-event counts, and the count that must be exceeded.
GRAPH_BIN, GRAPH_COUNT = 2_000_000, 10


@dataclass(frozen=True)
class DeletionParameters:
    threshold: int = 3
    coverage: int = 30
    largest: int = 1_000_000


def of_signal(signals: DataFrame, name: str) -> DataFrame:
    return signals.where(F.col("signal") == name).drop("signal")


def threshold_calls(signal: DataFrame, predicate: Column) -> DataFrame:
    """Entries that satisfy ``predicate``, merged."""
    return merge_overlapping(signal.where(predicate).select("contig", "start", "stop"))


def high_edit_distance(signals: DataFrame, over: int = 400) -> DataFrame:
    return threshold_calls(of_signal(signals, "MappingErrors"), F.col("value") > over)


def many_cigar_elements(signals: DataFrame, over: int = 12) -> DataFrame:
    return threshold_calls(of_signal(signals, "CigarIndels"), F.col("value") > over)


def no_coverage(signals: DataFrame, most: int = 0) -> DataFrame:
    return threshold_calls(of_signal(signals, "Coverage"), F.col("value") <= most)


def inversion_breakpoints(signals: DataFrame, least: int = 12) -> DataFrame:
    return threshold_calls(of_signal(signals, "DiscordantTandemOrientation"), F.col("value") >= least)


def cross_contig_breakpoints(signals: DataFrame, least: int = 12) -> DataFrame:
    return threshold_calls(of_signal(signals, "InterChr"), F.col("value") >= least)


def _edges(signal: DataFrame, least: int, ratio: float | None) -> tuple[DataFrame, DataFrame]:
    """Jumps and falls as points (contig, pos, value)."""
    both = cut(jumps(signal, least, ratio).select("contig", F.col("start").alias("pos"), F.col("height").alias("value")), "jumps")
    return both.where("value > 0"), both.where("value < 0")


def bridged_increases(signals: DataFrame, least: int = 10, over: int = 0, merged: bool = True) -> DataFrame:
    """Coverage jumps that runs of clipped reads bridge to a fall."""
    ups, downs = _edges(of_signal(signals, "Coverage"), least, None)
    runs = predicate_runs(of_signal(signals, "Clipped"), F.col("value") > over)
    found = started_bridged_ended(ups, downs, runs)
    return merge_overlapping(found) if merged else found


def hard_drops(signals: DataFrame, most: int = 7, least: int = 10) -> DataFrame:
    """Coverage falls that low coverage bridges to a jump."""
    ups, downs = _edges(of_signal(signals, "Coverage"), least, None)
    low = predicate_runs(of_signal(signals, "Coverage"), F.col("value") <= most)
    return started_bridged_ended(downs, ups, low)


def drops_without_clips(signals: DataFrame, least: int = 9, ratio: float | None = None, under: int = 2, merged: bool = True) -> DataFrame:
    """Coverage falls that a lack of clipped reads bridges to a jump; with ``ratio`` only jumps that are large beside their level."""
    ups, downs = _edges(of_signal(signals, "Coverage"), least, ratio)
    clean = predicate_runs(of_signal(signals, "Clipped"), F.col("value") < under)
    found = started_bridged_ended(downs, ups, clean)
    return merge_overlapping(found) if merged else found


def as_intervals(reads: DataFrame, *columns: str) -> DataFrame:
    return reads.select("contig", F.col("aln_start").alias("start"), F.col("aln_end").alias("stop"), *columns)


def deletions_from_insert_sizes(signals: DataFrame, reads: DataFrame, over: int = 2, most: int = 750) -> DataFrame:
    """At each peak of far pairs, reads of such pairs: from the largest of their ends to the least of their mates' starts, if there are as many as the peak is high."""
    tops = peaks(of_signal(signals, "InsertSizeTooBig"), over)
    far = as_intervals(reads.where(~F.col("unmapped") & ~F.col("mate_unmapped") & (orientation() == "FR") & (F.col("tlen") > most)), "mate_start")
    pairs = overlap_join(far, tops)
    sums = pairs.groupBy("b").agg(F.max("a.stop").alias("start"), F.min("a.mate_start").alias("stop"), F.count(F.lit(1)).alias("n"))
    return sums.where("n >= b.value AND start < stop").select("b.contig", "start", "stop", "n").distinct()


def deletions_fine(signals: DataFrame, reads: DataFrame, limits: Limits, read_length: int, parameters: DeletionParameters = DeletionParameters(6)) -> DataFrame:
    """contig, start, stop, alt, kind, imprecise, n_reads, depth of islands of far forward pairs.

    start is the largest end and stop the least mate start of the island's forward reads of far pairs. Mates that spread over
    three times the largest insert size make it imprecise. By the depth of the reads within it (bases of contained reads by
    length) it is a deletion (under half the coverage), one with loss of heterozygosity (under three halves), else <SV>,
    as it is where it is inverted or too large.
    """
    p = parameters
    islands = join_close(of_signal(signals, "ForwardInsertSizeTooBig").where(F.col("value") > p.threshold).select("contig", "start", "stop"), 2 * read_length)
    forward = as_intervals(reads.where(~F.col("unmapped") & ~F.col("is_reverse") & ~F.col("mate_unmapped") & (orientation() == "FR") & (F.col("tlen") > limits.most)), "mate_start")
    found = overlap_join(forward, islands).groupBy("b").agg(F.max("a.stop").alias("start"), F.min("a.mate_start").alias("stop"), (F.max("a.mate_start") - F.min("a.mate_start")).alias("spread"), F.count(F.lit(1)).alias("n_reads"))
    events = cut(found.select("b.contig", "start", "stop", "spread", "n_reads"), "deletions")
    spans = events.where((F.col("stop") >= F.col("start")) & (F.col("stop") - F.col("start") < p.largest)).select("contig", "start", "stop").distinct()
    inside = overlap_join(as_intervals(reads.where(~F.col("unmapped"))), spans, how="within").groupBy("b").agg(F.sum(F.col("a.stop") - F.col("a.start") + 1).alias("bases")).select("b.*", "bases")
    depth = spans.join(inside, ["contig", "start", "stop"], "left").select("contig", "start", "stop", F.expr("coalesce(bases, 0) div greatest(1, stop - start)").alias("depth"))
    rows = events.join(depth, ["contig", "start", "stop"], "left")
    kind = F.when(F.col("depth") < p.coverage // 2, "DEL").when(F.col("depth") < 3 * p.coverage // 2, "LOH").otherwise("SV")
    kind = F.when(F.col("depth").isNull(), "SV").otherwise(kind)
    rows = rows.withColumn("kind", kind).withColumn("imprecise", F.col("spread") >= 3 * limits.most)
    return rows.select("contig", "start", "stop", F.when(F.col("kind") == "SV", "<SV>").otherwise("<DEL>").alias("alt"), "kind", "imprecise", "n_reads", "depth")


def inversions(signals: DataFrame, reads: DataFrame, read_length: int, over: int = 3, largest: int = 10_000, links: int = 10) -> DataFrame:
    """contig, start, stop, score: pairs of islands of tandem pairs that more than ``links`` reads link, at the islands' middles.

    Islands are longer than a read; reads of those of ``largest`` positions at most are followed to where their mates start,
    counted from either end.
    """
    islands = join_close(of_signal(signals, "DiscordantTandemOrientation").where(F.col("value") > over).select("contig", "start", "stop")).where(F.col("stop") - F.col("start") > read_length)
    islands = cut(islands, "islands").withColumn("middle", F.expr("start + (stop - start) div 2"))
    tandem = as_intervals(reads.where(~F.col("unmapped") & ~F.col("mate_unmapped") & (F.col("mapq") != 0) & (F.col("mate_contig") == F.col("contig")) & (orientation() == "TANDEM")), "mate_start")
    # Equal reads are looked up once, and mates of one island are counted by their start before they are.
    tandem = tandem.groupBy(*tandem.columns).agg(F.count(F.lit(1)).alias("n"))
    tandem = cut(tandem, "tandem")
    met = overlap_join(tandem.select("contig", "start", "stop").distinct(), islands.where(F.col("stop") - F.col("start") <= largest)).select("a.*", F.col("b.middle").alias("from"))
    mates = tandem.join(met, ["contig", "start", "stop"]).groupBy("contig", "mate_start", "from").agg(F.sum("n").alias("n"))
    mates = cut(mates.select("contig", F.col("mate_start").alias("start"), F.col("mate_start").alias("stop"), "from", "n"), "mates")
    there = overlap_join(mates, islands).select("a.contig", F.col("a.from").alias("from"), F.col("b.middle").alias("to"), "a.n").where(F.col("from") != F.col("to"))
    counted = there.groupBy("contig", F.least("from", "to").alias("start"), F.greatest("from", "to").alias("stop")).agg(F.sum("n").alias("score"))
    return counted.where(F.col("score") > links)


def breakpoints_with_mates(signals: DataFrame, reads: DataFrame, least: int = 12) -> DataFrame:
    """contig, start, stop, mates: merged regions of cross-contig pairs with the number of mates on each other contig (``chr`` put before names without it)."""
    regions = cross_contig_breakpoints(signals, least)
    far = as_intervals(reads.where(~F.col("unmapped") & ~F.col("mate_unmapped") & (F.col("mate_contig") != F.col("contig"))), "mate_contig")
    mate = F.when(F.col("a.mate_contig").startswith("chr"), F.col("a.mate_contig")).otherwise(F.concat(F.lit("chr"), F.col("a.mate_contig")))
    counts = overlap_join(far, regions).groupBy("b", mate.alias("mate")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("b").agg(F.sort_array(F.collect_list(F.struct("mate", "n"))).alias("mates")).select("b.contig", "b.start", "b.stop", F.map_from_entries("mates").alias("mates"))


def duplications(signals: DataFrame, read_length: int, edge: int = 6) -> DataFrame:
    """Level segments over one and a half times their contig's mean depth, joined when closer than two reads, longer than four."""
    depth = of_signal(signals, "Coverage")
    segments = level_segments(depth, edge)
    # One row a contig; Spark broadcasts it only while it is small.
    high = segments.join(average_depth(depth), "contig").where(F.expr("value > depth + depth div 2")).select("contig", "start", "stop")
    return join_close(high, 2 * read_length).where(F.col("stop") - F.col("start") > 4 * read_length)


def copy_numbers(signals: DataFrame, coverage: int, shortest: int = 50, over: int = 3) -> DataFrame:
    """contig, start, stop, value: depth by coverage cut to whole numbers, equal neighbours joined, longer than ``shortest``, gaps filled, over ``over``."""
    levels = of_signal(signals, "Coverage").withColumn("value", F.expr(f"value div {int(coverage)}"))
    runs = join_touching(levels, same_value=True).where(F.col("stop") - F.col("start") > shortest)
    return fill_missing(runs).where(F.col("value") > over)


def graph_bins(events: DataFrame, reads: DataFrame, width: int = GRAPH_BIN, over: int = GRAPH_COUNT) -> DataFrame:
    """contig, bin, mate_contig, mate_bin, n: cross-contig reads at events (contig, start, stop), counted by bins of both ends."""
    sound = "contig IS NOT NULL AND start <= stop"
    far = as_intervals(reads.where(~F.col("unmapped") & ~F.col("mate_unmapped") & (F.col("mapq") != 0) & (F.col("mate_contig") != F.col("contig"))), "mate_contig", F.floor(F.col("mate_start") / width).alias("mate_bin"))
    far = far.where(sound).groupBy(*far.columns).agg(F.count(F.lit(1)).alias("n"))
    # Of a bin's events a read meets those that begin by its stop, less those that end before its start: no pairs of both.
    ends = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("start").cast("long").alias("pos")), F.struct(F.lit(1).alias("kind"), F.col("stop").cast("long").alias("pos"))))
    points = events.where(sound).select("contig", F.floor(F.col("start") / width).alias("bin"), ends.alias("e")).groupBy("contig", "bin", "e.kind", "e.pos").agg(F.count(F.lit(1)).alias("m"))
    points = cut(points, "event_ends")
    reach = points.groupBy("contig", "bin").agg(F.min(F.when(F.col("kind") == 0, F.col("pos"))).alias("start"), F.max(F.when(F.col("kind") == 1, F.col("pos"))).alias("stop"))
    asks = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("a.stop").cast("long").alias("pos"), F.col("a.n").alias("w")), F.struct(F.lit(1).alias("kind"), (F.col("a.start").cast("long") - 1).alias("pos"), (-F.col("a.n")).alias("w"))))
    asked = overlap_join(far, reach).select("b.contig", "b.bin", "a.mate_contig", "a.mate_bin", asks.alias("x")).groupBy("contig", "bin", "x.kind", "x.pos", "mate_contig", "mate_bin").agg(F.sum("x.w").alias("w"))
    asked, at = cut(asked, "asked"), ["contig", "bin", "kind", "pos"]
    both = points.withColumn("ask", F.lit(0)).unionByName(asked.select(*at, F.lit(0).cast("long").alias("m"), F.lit(1).alias("ask")).distinct())
    seen = with_running_sum(both.groupBy(*at).agg(F.sum("m").alias("m"), F.max("ask").alias("ask")), at[:3], ["pos"], F.col("m"), "pos", "upto").where("ask = 1").select(*at, "upto")
    rows = asked.join(seen, at).groupBy("contig", "bin", "mate_contig", "mate_bin").agg(F.sum(F.col("w") * F.col("upto")).alias("n"))
    return rows.where(F.col("n") > over)


def graph_ends(bins: DataFrame, width: int = GRAPH_BIN) -> tuple[DataFrame, DataFrame]:
    """The two ends of each counted link as BED entries."""
    end = lambda c, b: bins.select(F.col(c).alias("contig"), (F.col(b) * width).alias("start"), ((F.col(b) + 1) * width).alias("stop"), F.col("n").alias("value"))
    return end("contig", "bin"), end("mate_contig", "mate_bin")


def callers(limits: Limits, read_length: int, coverage: int = 30) -> dict[str, Callable[[DataFrame, DataFrame], DataFrame]]:
    """All callers by name; each takes (signals, reads) and gives contig, start, stop and more."""
    return {
        "del_fine": lambda s, r: deletions_fine(s, r, limits, read_length, DeletionParameters(6, coverage)),
        "dup": lambda s, r: duplications(s, read_length),
        "inv": lambda s, r: inversions(s, r, read_length),
        "bnd_mates": breakpoints_with_mates,
        "del_coarse": lambda s, r: deletions_from_insert_sizes(s, r, most=limits.most),
        "no_coverage": lambda s, r: no_coverage(s),
        "edit_distance": lambda s, r: high_edit_distance(s),
        "inv_breakpoints": lambda s, r: inversion_breakpoints(s),
        "bnd": lambda s, r: cross_contig_breakpoints(s),
        "cnv": lambda s, r: copy_numbers(s, coverage),
        "bridged_increase": lambda s, r: bridged_increases(s),
        "cigar_indels": lambda s, r: many_cigar_elements(s),
        "hard_drops": lambda s, r: hard_drops(s),
        "drops_without_clips": lambda s, r: drops_without_clips(s),
        "relative_drops_without_clips": lambda s, r: drops_without_clips(s, ratio=0.33),
    }
