"""Tables that end a lineage, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, in local mode only, a new temporary folder that goes when Python ends."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: What this process has written, by application.
_written: dict[str, list[str]] = {}


def give_back(spark: SparkSession, share: float = 0.5) -> None:
    """Collect the driver's garbage once its heap has grown past ``share`` of what it may take, so that it shrinks again.

    Plans of many short jobs, and literals in them, are garbage soon; the heap keeps what they took until then. By itself a
    collection leaves up to 70 % of the heap empty, so it would hardly shrink and be due again at once: here it leaves 40 %.
    """
    jvm = spark.sparkContext._jvm
    runtime = jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() <= share * runtime.maxMemory():
        return
    option = "MaxHeapFreeRatio"
    try:
        options = jvm.java.lang.management.ManagementFactory.getPlatformMXBean(jvm.java.lang.Class.forName("com.sun.management.HotSpotDiagnosticMXBean"))
        before = options.getVMOption(option).getValue()
        options.setVMOption(option, options.getVMOption("MinHeapFreeRatio").getValue())
    except Py4JError:  # other virtual machines have no such option
        options = None
    try:
        jvm.java.lang.System.gc()
    finally:
        if options:
            options.setVMOption(option, before)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: the lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    give_back(spark)
    return spark.read.schema(schema).parquet(path)


def clean(spark: SparkSession) -> int:
    """Delete the tables that ``cut`` has written for this application; results that read them must have been used. Their number."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)
