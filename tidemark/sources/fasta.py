"""FASTA text, in chunks: no row holds more of a sequence than a chunk, no task more of a file than a split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import cut
from .text import read_lines

#: Bases of a chunk.
CHUNK = 1 << 16


def _pieces(bases: Column, offset: Column, size: int) -> Column:
    """(chunk, at, bases) of what a line that begins at ``offset`` gives to each chunk."""
    last = F.floor((offset + F.char_length(bases) - 1) / size).cast("long")
    chunk = F.sequence(F.floor(offset / size).cast("long"), last)
    first = lambda c: F.greatest(c * size, offset)
    return F.transform(chunk, lambda c: F.struct(c.alias("chunk"), first(c).alias("at"), F.substring(bases, (first(c) - offset + 1).cast("int"), (F.least((c + 1) * size, offset + F.char_length(bases)) - first(c)).cast("int")).alias("bases")))


def _gathered(rows: DataFrame) -> DataFrame:
    """(name, record, chunk, bases) of rows (name, record, x), x being a piece."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x.at", "x.bases"))), lambda p: p["bases"]), "")
    return rows.groupBy("name", "record", F.col("x.chunk").alias("chunk")).agg(joined.alias("bases"))


def read_fasta(spark: SparkSession, path: str, size: int = CHUNK) -> DataFrame:
    """name (the header's line), record, chunk (from 0) and bases: ``size`` of them in each chunk but a record's last.

    ``record`` tells records of equal names apart: file and number in it. Lines of any length are joined; what a line begins
    with and at counts as it is, white space around it aside. Each split numbers its own headers and bases; one row a split
    carries them on to the next. Bases before the first header have a null name. A record without bases, an empty file: no rows.
    """
    lines = read_lines(spark, path, ordered=True).select(F.col("ord.file").alias("file"), F.col("ord.block").alias("block"), F.col("ord.line").alias("line"), F.trim(F.regexp_replace("value", "\\r$", "")).alias("value")).where("value <> ''")
    here = Window.partitionBy("file", "block").orderBy("line")
    head = F.col("value").startswith(">")
    counted = lines.withColumn("n", F.count_if(head).over(here)).withColumn("title", F.when(head, F.substring("value", 2, 1 << 30)))
    # Within a split's own record: bases before this line; the record's header, if it is in the split.
    own = Window.partitionBy("file", "block", "n").orderBy("line")
    counted = cut(counted.withColumn("own", F.sum(F.when(head, 0).otherwise(F.char_length("value"))).over(own)).withColumn("title", F.first("title", ignorenulls=True).over(own)), "fasta")
    ends = counted.groupBy("file", "block").agg(F.max("n").alias("heads"), F.max_by(F.struct("own", "title"), "line").alias("last"))
    # A row a split: its record goes on from the last split with a header.
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("past", F.coalesce(F.sum("heads").over(before), F.lit(0))).withColumn("title0", F.last(F.when(F.col("heads") > 0, F.col("last.title")), ignorenulls=True).over(before))
    # Bases of the open record: running sums of what each split ends with, from the last split with a header on.
    section = Window.partitionBy("file").orderBy("block")
    ends = ends.withColumn("section", F.count_if(F.col("heads") > 0).over(section)).withColumn("sum", F.sum("last.own").over(Window.partitionBy("file", "section").orderBy("block")))
    ends = ends.select(F.col("file").alias("f"), F.col("block").alias("b"), "past", "title0", F.coalesce(F.lag("sum").over(section), F.lit(0)).alias("carried"))
    both = counted.where(~head).join(ends, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")))
    offset = F.col("own") - F.char_length("value") + F.when(F.col("n") == 0, F.col("carried")).otherwise(0)
    rows = both.select(F.when(F.col("n") == 0, F.col("title0")).otherwise(F.col("title")).alias("name"), F.struct("file", (F.col("past") + F.col("n")).alias("number")).alias("record"), offset.alias("o"), "value")
    return _gathered(rows.select("name", "record", F.explode(_pieces(F.col("value"), F.col("o"), size)).alias("x")))


def as_chunks(sequences: DataFrame, size: int = CHUNK) -> DataFrame:
    """(name, record, chunk, bases) of whole sequences (name, seq), as ``read_fasta`` gives them; empty and null ones have no rows."""
    rows = sequences.where("seq <> ''").select("name", F.struct(F.lit("").alias("file"), F.monotonically_increasing_id().alias("number")).alias("record"), F.lit(0).cast("long").alias("o"), "seq")
    return rows.select("name", "record", F.explode(_pieces(F.col("seq"), F.col("o"), size)).alias("x")).select("name", "record", "x.chunk", "x.bases")


def slices(chunks: DataFrame, ranges: DataFrame, size: int = CHUNK) -> DataFrame:
    """``ranges`` (contig, start, stop, ...) with ``bases``: start to stop (from 1, inclusive) of the records whose name's first word is the contig.

    Each range meets the chunks that it touches; what lies beyond a record's ends is left out, and a range that has no base in a
    record has no row. A range longer than a row holds is an error of Spark's.
    """
    start = F.greatest(F.col("start").cast("long"), F.lit(1)) - 1
    asked = ranges.where("stop >= start AND stop >= 1").select(F.struct(*(F.col(f"`{c}`") for c in ranges.columns)).alias("range"), F.col("contig").alias("c"), start.alias("low"), F.col("stop").cast("long").alias("high"), F.monotonically_increasing_id().alias("id"))
    touched = asked.withColumn("k", F.explode(F.expr(f"sequence(low div {size}, (high - 1) div {size})")))
    word = F.get(F.split("name", r"\s"), F.lit(0)).alias("word")
    met = touched.join(chunks.select(word, "record", "chunk", "bases"), (F.col("c") == F.col("word")) & (F.col("k") == F.col("chunk")))
    at = F.greatest(F.col("low") - F.col("k") * size, F.lit(0))
    piece = F.substring("bases", (at + 1).cast("int"), (F.least(F.col("high") - F.col("k") * size, F.lit(size)) - at).cast("int"))
    found = met.select("range", "id", "record", F.struct("k", piece.alias("p")).alias("x")).where("x.p <> ''").groupBy("id", "range", "record")
    whole = found.agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda e: e["p"]), "").alias("__bases"))
    return whole.select("range.*", F.col("__bases").alias("bases"))


def base_slice(chunks: DataFrame, contig: str, start: int, stop: int, size: int = CHUNK) -> DataFrame:
    """seq: bases start to stop (from 1, inclusive) of the record whose name begins with the contig's."""
    one = chunks.sparkSession.createDataFrame([(contig, start, stop)], "contig string, start long, stop long")
    return slices(chunks, one, size).select(F.col("bases").alias("seq"))
