"""Variant rows: parsing, coordinates, windows, editing, comparison with a truth set."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import ratio
from ..tables import cut
from .joins import BIN, FACTOR, FINEST, LEVELS, bin_size, reciprocal_overlap


#: Stops of one start that are one row's are as far apart at most.
STOPS = 1 << 12


def parse_info(info: Column) -> Column:
    """``k=v;flag`` to a map: a flag is its own value, text after a second ``=`` is dropped, the last of equal keys wins, empty pieces are ignored."""
    def bound(value: Column, body: Callable[[Column], Column]) -> Column:
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def pair(kv: Column) -> Column:
        return F.struct(F.get(kv, F.lit(0)).alias("k"), F.coalesce(F.get(kv, F.lit(1)), F.get(kv, F.lit(0))).alias("v"))

    def last(pairs: Column) -> Column:
        return F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["k"] == p["k"]))

    # Each piece is split once, and the pairs are computed once, however often they are looked at.
    pairs = F.transform(F.transform(F.filter(F.split(info, ";"), lambda x: x != ""), lambda x: F.split(x, "=")), pair)
    return F.map_from_entries(bound(pairs, last))


def write_info(info: Column) -> Column:
    """The map back to text, by key; what is its own value is a flag."""
    return F.array_join(F.transform(F.sort_array(F.map_entries(info)), lambda e: F.when(e["key"] == e["value"], e["key"]).otherwise(F.concat(e["key"], F.lit("="), e["value"]))), ";")


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """VCF lines to chr, pos, id, ref, alt, qual, filter, info and opt. Header lines and malformed ones (under eight fields, no number) are left out.

    A contig without the prefix ``chr`` gets it.
    """
    f = F.split(F.col(column), "\t")
    rows = lines.where(~F.col(column).startswith("#")).select("*", f.alias("__f")).where("size(__f) >= 8 AND try_cast(__f[1] AS int) IS NOT NULL")
    at = lambda i: F.get("__f", F.lit(i))
    return rows.select(
        *(c for c in lines.columns if c != column),
        F.when(at(0).startswith("chr"), at(0)).otherwise(F.concat(F.lit("chr"), at(0))).alias("chr"),
        at(1).cast("int").alias("pos"),
        at(2).alias("id"),
        at(3).alias("ref"),
        at(4).alias("alt"),
        at(5).alias("qual"),
        at(6).alias("filter"),
        parse_info(at(7)).alias("info"),
        F.slice("__f", F.lit(9), F.size("__f")).alias("opt"),
    )


def coordinates(variants: DataFrame) -> DataFrame:
    """Add start, stop (END, else the position plus the reference's length) and length (|SVLEN| if it is a number)."""
    info = lambda k: F.try_element_at("info", F.lit(k))
    end = info("END").try_cast("int")
    return variants.withColumn("start", F.col("pos")).withColumn("stop", F.coalesce(end, F.col("pos") + F.char_length("ref"))).withColumn("length", F.abs(info("SVLEN").try_cast("int")))


def scaled_window(start: Column, stop: Column, factor: float, length: Column | None = None) -> tuple[Column, Column]:
    """The window ``factor`` times as long around the same middle; half the growth is cut towards zero, the start is 1 at least."""
    own = (stop - start).cast("long")
    size = F.coalesce(length.cast("long"), own) if length is not None else own
    grown = (F.lit(float(factor)) * size).cast("long") - own
    half = F.when(grown >= 0, F.floor(grown / 2)).otherwise(-F.floor(-grown / 2)).cast("long")
    return F.greatest(F.lit(1), start - half), stop + half


def position_text(contig: Column, start: Column, stop: Column) -> Column:
    """``chr1:1,234-5,678``."""
    return F.concat(contig, F.lit(":"), F.format_number(start, 0), F.lit("-"), F.format_number(stop, 0))


def window_text(contig: Column, start: Column, stop: Column) -> Column:
    return F.concat(contig, F.lit(":"), start.cast("string"), F.lit("-"), stop.cast("string"))


def filter_lines(lines: DataFrame, predicate: Column, column: str = "value") -> DataFrame:
    """Header lines, and those that satisfy ``predicate``."""
    return lines.where(F.col(column).startswith("#") | predicate)


def edit_field(lines: DataFrame, number: int, new: Column, column: str = "value") -> DataFrame:
    """Lines with tab-separated field ``number`` (from 0) replaced; header lines stay."""
    f = F.split(F.col(column), "\t")
    edited = F.array_join(F.concat(F.slice(f, 1, number), F.array(new), F.slice(f, F.lit(number + 2), F.size(f))), "\t")
    return lines.withColumn(column, F.when(F.col(column).startswith("#"), F.col(column)).otherwise(edited))


def fill_reference(lines: DataFrame, column: str = "value") -> DataFrame:
    return edit_field(lines, 3, F.lit("N"), column)


def renumber(lines: DataFrame, order: str, prefix: str, column: str = "value") -> DataFrame:
    """Field 3 := prefix and the line's number from 0 among those that aren't header, by ``order``.

    The order is dealt out by ranges first, so the numbering is a running sum over the ranges' counts, not one sorted task.
    The ranges are written down, as drawing them anew could cut them otherwise.
    """
    ranged = lines.repartitionByRange(order).sortWithinPartitions(order).withColumn("__part", F.spark_partition_id()).withColumn("__is", (~F.col(column).startswith("#")).cast("long"))
    ranged = cut(ranged.withColumn("__in", F.monotonically_increasing_id()))
    inside = W.partitionBy("__part").orderBy("__in").rowsBetween(W.unboundedPreceding, 0)
    numbered = ranged.withColumn("__nth", F.sum("__is").over(inside))
    totals = ranged.groupBy("__part").agg(F.sum("__is").alias("__n")).withColumnRenamed("__part", "__p")
    before = totals.select("__p", F.coalesce(F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    joined = numbered.join(F.broadcast(before), F.col("__part") == F.col("__p"))  # one row a partition
    number = F.concat(F.lit(prefix), (F.col("__before") + F.col("__nth") - 1).cast("string"))
    return edit_field(joined, 2, number, column).drop("__part", "__is", "__in", "__nth", "__p", "__before")


def interval_by_length(variants: DataFrame) -> DataFrame:
    """start and stop = pos and pos + |SVLEN|; rows without a number go."""
    return variants.withColumn("start", F.col("pos")).withColumn("stop", F.col("pos") + F.abs(F.try_element_at("info", F.lit("SVLEN")).try_cast("int"))).where("stop IS NOT NULL")


def interval_by_end(variants: DataFrame) -> DataFrame:
    """start and stop = pos and END; rows without a number go."""
    return variants.withColumn("start", F.col("pos")).withColumn("stop", F.try_element_at("info", F.lit("END")).try_cast("int")).where("stop IS NOT NULL")


def accept_by_length(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Reciprocal overlap of 0.6 at least where the truth is 1,000 long at most, else of 0.8."""
    return reciprocal_overlap(s1, e1, s2, e2) >= F.when(e1 - s1 <= 1000, 0.6).otherwise(0.8)


def accept_half(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return reciprocal_overlap(s1, e1, s2, e2) >= 0.5


Accept = Callable[[Column, Column, Column, Column], Column]


def matches(truth: DataFrame, candidates: DataFrame, accept: Accept = accept_by_length, around: Column | None = None, bin_width: int = BIN) -> DataFrame:
    """Pairs (struct t, struct c) of truth and candidate intervals (contig, start, stop, ...) that ``accept``.

    A candidate's start is looked for from ``around`` (the truth's length) before the truth's start to as much behind its stop.
    """
    reach = around if around is not None else F.col("stop") - F.col("start")
    low, high = F.greatest(F.lit(0), F.col("start") - reach), F.col("stop") + reach
    bins = F.sequence(F.floor(low / bin_width), F.floor(F.greatest(high - 1, low) / bin_width))
    t = truth.select(F.struct(*truth.columns).alias("t"), F.col("contig").alias("t_contig"), low.alias("low"), high.alias("high"), F.explode(bins).alias("t_bin"))
    c = candidates.select(F.struct(*candidates.columns).alias("c"), F.col("contig").alias("c_contig"), F.floor(F.col("start") / bin_width).alias("c_bin"))
    near = (F.col("t_contig") == F.col("c_contig")) & (F.col("t_bin") == F.col("c_bin")) & (F.col("c.start") >= F.col("low")) & (F.col("c.start") < F.col("high"))
    return t.join(c, near & accept(F.col("t.start"), F.col("t.stop"), F.col("c.start"), F.col("c.stop"))).select("t", "c")


def last_of_position(candidates: DataFrame, order: list[str]) -> DataFrame:
    """Of candidates that begin at one position the last by ``order``."""
    return candidates.groupBy("contig", "start").agg(F.max(F.struct(*order, "stop", *[c for c in candidates.columns if c not in ("contig", "start", "stop", *order)])).alias("m")).select("contig", "start", "m.*")


def compare(truth: DataFrame, candidates: DataFrame, order: list[str], accept: Accept = accept_by_length, bin_width: int = BIN) -> dict[str, DataFrame]:
    """found and missed truth rows, and false_positives: distinct candidates that no truth row accepts.

    Candidates of one position collapse to the last before matching; the ones that go count as false positives.
    """
    pairs = matches(truth, last_of_position(candidates, order), accept, bin_width=bin_width)
    keys = ["contig", "start", "stop"]
    hit = pairs.select(*(F.col(f"t.{k}").alias(k) for k in keys)).distinct()
    good = pairs.select(*(F.col(f"c.{k}").alias(k) for k in keys)).distinct()
    return {"found": truth.join(hit, keys, "left_semi"), "missed": truth.join(hit, keys, "left_anti"), "false_positives": candidates.select(*keys).distinct().join(good, keys, "left_anti")}


def statistics(truth: DataFrame, candidates: DataFrame, order: list[str], accept: Accept = accept_by_length) -> DataFrame:
    """contig, tp, fn, fp, n_candidates, precision, fdr, recall, fnr for each contig and for all (contig null)."""
    parts = compare(truth, candidates, order, accept)
    one = lambda df, kind: df.select("contig", F.lit(kind).alias("kind"))
    rows = one(parts["found"], "tp").unionByName(one(parts["missed"], "fn")).unionByName(one(parts["false_positives"], "fp")).unionByName(one(candidates, "n_candidates"))
    counts = rows.rollup("contig").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("tp", "fn", "fp", "n_candidates")))
    return second_order(counts)


def second_order(counts: DataFrame) -> DataFrame:
    tp, fn, fp = F.col("tp"), F.col("fn"), F.col("fp")
    return counts.select("*", ratio(tp, tp + fp).alias("precision"), ratio(fp, tp + fp).alias("fdr"), ratio(tp, tp + fn).alias("recall"), ratio(fn, tp + fn).alias("fnr"))


def compare_by_share(truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """The older comparison, per contig: candidates within 40 % (20 % beyond 1,000) of the truth's length around its start; false positives are the rest by number."""
    length = F.col("stop") - F.col("start")
    around = F.when(length <= 1000, F.floor(length * 0.4)).otherwise(F.floor(length * 0.2)).cast("long")
    own = truth.groupBy("contig", "start", "stop").agg(F.count(F.lit(1)).alias("n")).withColumns({"low": F.col("start") - around, "high": F.col("start") + around}).where("low <= high")
    # Equal truths are asked once, candidates of one start are one row, and a truth is done with the first that it accepts.
    t = cut(own.withColumn("level", F.size(F.filter(F.array(*(F.lit(FINEST * FACTOR**k) for k in range(LEVELS - 1))), lambda w: w < F.col("high") - F.col("low") + 1))), "truths")
    stops = candidates.select("contig", F.col("start").alias("c_start"), F.col("stop").alias("c_stop")).distinct()
    stops = stops.groupBy("contig", "c_start", F.floor(F.col("c_stop") / STOPS).alias("part")).agg(F.collect_list("c_stop").alias("stops")).drop("part")
    c = stops.join(F.broadcast(t.select("level").distinct()))  # LEVELS rows at most
    c = c.select(F.col("contig").alias("c_contig"), "c_start", "stops", F.col("level").alias("c_level"), F.floor(F.col("c_start") / bin_size(F.col("level"), FINEST)).alias("c_bin"))
    size = bin_size(F.col("level"), FINEST)
    t = t.withColumn("bin", F.explode(F.sequence(F.floor(F.col("low") / size), F.floor(F.col("high") / size))))
    near = (F.col("contig") == F.col("c_contig")) & (F.col("level") == F.col("c_level")) & (F.col("bin") == F.col("c_bin")) & F.col("c_start").between(F.col("low"), F.col("high"))
    some = F.exists("stops", lambda stop: accept_by_length(F.col("start"), F.col("stop"), F.col("c_start"), stop))
    hit = t.join(c, near & some, "left_semi").select("contig", "start", "stop", "n").distinct()
    n = hit.groupBy("contig").agg(F.sum("n").alias("tp"))
    per_truth = truth.groupBy("contig").agg(F.count(F.lit(1)).alias("n_truth"))
    per_candidate = candidates.groupBy("contig").agg(F.count(F.lit(1)).alias("n_candidates"))
    out = per_truth.join(per_candidate, "contig", "full").join(n, "contig", "left").na.fill(0, ["tp", "n_truth", "n_candidates"])
    return out.select("contig", "tp", (F.col("n_truth") - F.col("tp")).alias("fn"), (F.col("n_candidates") - F.col("tp")).alias("fp"), "n_candidates")
