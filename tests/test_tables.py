"""The driver's memory between the tables that end a lineage."""

from __future__ import annotations

from tidemark.tables import give_back


def test_the_heap_shrinks_to_what_is_used(spark):
    sc = spark.sparkContext
    runtime = sc._jvm.java.lang.Runtime.getRuntime()
    held = [sc._jvm.java.lang.StringBuilder(100 << 20) for _ in range(10)]
    grown = runtime.totalMemory()
    assert grown > 1000 << 20
    for x in held:
        x.trimToSize()
    option = sc._jvm.java.lang.management.ManagementFactory.getPlatformMXBean(sc._jvm.java.lang.Class.forName("com.sun.management.HotSpotDiagnosticMXBean")).getVMOption
    before = option("MaxHeapFreeRatio").getValue()
    give_back(spark, 0)
    used = runtime.totalMemory() - runtime.freeMemory()
    assert runtime.totalMemory() < 2 * used + (48 << 20) < grown
    assert option("MaxHeapFreeRatio").getValue() == before
    give_back(spark, 1)
