"""Text lines, plain or gzip by their suffix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str, ordered: bool = False) -> DataFrame:
    """``value``; with ``ordered`` also ``ord``, by which lines sort as they stand: file, place of its split, line within the split."""
    lines = spark.read.text(path)
    if not ordered:
        return lines
    return lines.select("value", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("ord"))


def write_lines(df: DataFrame, path: str, compression: str = "none", mode: str = "errorifexists") -> None:
    """One string column as text part files."""
    df.write.mode(mode).text(path, compression=compression)


def with_header(df: DataFrame, header: list[str], order: list[str], line: str) -> DataFrame:
    """``value``: the header's lines, then the column ``line`` by ``order`` (sorted by ranges, so parts read in order)."""
    spark = df.sparkSession
    top = spark.createDataFrame([(i, h) for i, h in enumerate(header)], "i int, value string").coalesce(1).sortWithinPartitions("i").select("value")
    return top.unionByName(df.orderBy(*order).select(F.col(line).alias("value")))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in any store that Spark reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
