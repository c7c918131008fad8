"""Signal events of reads that arrive as a stream, and depth segments of positions that are complete.

A sweep's state is one running number per signal and contig, but a segment is final only
when no read that begins before it can still come. Reads sorted by position within their
micro-batches are common, reads sorted over the whole stream aren't, so event sums per
position are kept as a table that each batch adds to, and segments are read from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.reads import Limits, signals
from ..operators.sweep import segments


def event_sums(reads: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(signal, contig, pos, delta) of a batch or stream of reads, not yet added up."""
    hits = F.filter(F.array(*(F.when(p, F.struct(F.lit(k).alias("signal"), s.cast("long").alias("score"))) for k, (p, s) in signals(limits).items())), lambda x: x.isNotNull())
    ends = F.explode(F.array(F.struct(F.col("aln_start").cast("long").alias("pos"), F.col("h.score").alias("delta")), F.struct(F.col("aln_end").cast("long").alias("pos"), (-F.col("h.score")).alias("delta"))))
    return reads.where(~F.col("unmapped")).select("contig", "aln_start", "aln_end", F.explode(hits).alias("h")).select("h.signal", "contig", ends.alias("e")).select("signal", "contig", "e.pos", "e.delta")


def start(reads: DataFrame, table: str, checkpoint: str, limits: Limits = Limits(), **trigger) -> StreamingQuery:
    """Append each micro-batch's sums to the Parquet folder ``table``, one sub-folder a batch, so that a batch that is run again replaces its own."""

    def add(batch: DataFrame, number: int) -> None:
        sums = event_sums(batch, limits).groupBy("signal", "contig", "pos").agg(F.sum("delta").alias("delta"))
        sums.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return reads.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def depth(spark, table: str) -> DataFrame:
    """The segments of all that has arrived."""
    sums = spark.read.parquet(table).groupBy("signal", "contig", "pos").agg(F.sum("delta").alias("delta"))
    return segments(sums, ["signal", "contig"])


def windowed_counts(reads: DataFrame, time: str, late: str = "10 minutes", every: str = "5 minutes") -> DataFrame:
    """Reads by arrival window and contig, for a stream with a timestamp column: late ones count until the watermark."""
    return reads.withWatermark(time, late).groupBy(F.window(time, every).alias("w"), "contig").agg(F.count(F.lit(1)).alias("n_reads")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "contig", "n_reads")
