"""Make this package importable in the Python workers of every executor, and keep those small."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors, once for each application (Spark's own file server carries it)."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tidemark-src-")) / "tidemark_src.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


#: Bytes of one Arrow batch where the session has the default: a worker holds a batch as Arrow and as Python's objects.
BATCH_BYTES = 8 << 20


def lean(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow`` in batches of bounded bytes, with Arrow on the system's allocator and freed memory given back at a task's end, as workers live on."""
    conf, size = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(size) in ("67108864b", "67108864"):
        conf.set(size, str(BATCH_BYTES))

    def leanly(batches):
        import pyarrow as pa

        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            gc.collect()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
                ctypes.CDLL(None).malloc_trim(0)

    return df.mapInArrow(leanly, schema)
