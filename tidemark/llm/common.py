"""What several operators share: reading tables, shared-folder tables, Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship
from ..tables import cut as cut  # for this subpackage's modules

#: Rows and bytes of one Arrow batch: texts may be long, so a batch of the default 10,000 rows could be large.
ARROW_ROWS, ARROW_BYTES = 1000, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Up to so many bytes a side is broadcast; beyond, it is joined by shuffling.
BROADCAST_BYTES = 64 << 20


def small_side(df: DataFrame, row_bytes: int, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if its ``rows`` rows of ``row_bytes`` fit the bound, else as it is."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


#: A key that holds more than one row in HOT is dealt to SALTS tasks. Fewer than HOT keys can be.
HOT, SALTS = 1000, 64


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], total: int, vary: list[str]) -> DataFrame:
    """``rows`` with the columns of their group: ``groups`` has one row for each of ``keys`` (never null), and how many of ``total`` rows it has as ``size``.

    A large group's rows are dealt by a hash of ``vary``, columns that differ within it, and its one row is sent to each part.
    """
    hot = F.col("size") * HOT > total
    salts = F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    few = groups.where(hot).select(*keys, F.lit(True).alias("__hot"))  # fewer than HOT rows
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(*vary), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    salted = rows.join(F.broadcast(few), keys, "left").withColumn("__salt", salt).drop("__hot")
    return salted.join(groups.withColumn("__salt", salts).drop("size"), [*keys, "__salt"]).drop("__salt")


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of bounded rows and bytes, unless the session has bounds of its own."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 10000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in ("67108864b", "67108864"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that are over: it does so once the driver has collected what referred to them."""
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` with Arrow on the system's allocator and freed memory given back at the end: Python workers stay alive between tasks."""

    def leanly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            gc.collect()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
                ctypes.CDLL(None).malloc_trim(0)

    return leanly


def map_batches(df: DataFrame, columns: list[str], make: Callable[[], Callable[[dict], dict]], schema: str) -> DataFrame:
    """Apply ``make()`` (called once in each task) to dicts of column lists, batch by batch, without a shuffle."""
    spark = df.sparkSession
    ship(spark)
    bound_batches(spark)
    arrow = to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            out = work({c: batch.column(c).to_pylist() for c in columns})
            yield pa.RecordBatch.from_arrays([x if isinstance(x := out[f.name], pa.Array) else pa.array(x, f.type) for f in arrow], schema=arrow)

    return df.select(*columns).mapInArrow(lean(run), schema)


def to_arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


class WordHashes(dict):
    """64-bit hash of each word's bytes, remembered; emptied when it has grown past ``most`` words."""

    most = 1 << 16

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = x = xxhash.xxh3_64_intdigest(word)
        return x


def by_column(names: list[str], rows: list[tuple]) -> dict[str, list]:
    return {n: [r[i] for r in rows] for i, n in enumerate(names)}
