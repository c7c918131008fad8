from __future__ import annotations

from tidemark import fixtures
from tidemark.operators.reads import Limits, signal_segments
from tidemark.streaming import coverage


def test_stream_as_batch(spark, tmp_path):
    reads = fixtures.reads(spark, "/root/testdata/sf0.001")
    limits = Limits(fixtures.LEAST, fixtures.MOST, fixtures.CLIP)
    reads.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(reads.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    coverage.start(stream, str(tmp_path / "sums"), str(tmp_path / "ck"), limits).awaitTermination()
    got = sorted(map(tuple, coverage.depth(spark, str(tmp_path / "sums")).select("signal", "contig", "start", "stop", "value").collect()))
    assert got == sorted(map(tuple, signal_segments(reads, limits).select("signal", "contig", "start", "stop", "value").collect()))
