"""CIGAR strings as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def operations(cigar: Column) -> Column:
    """array<struct<n int, op string>>; ``*`` has none."""
    parts = F.regexp_extract_all(cigar, F.lit(r"([0-9]+[MIDNSHP=X])"), F.lit(1))
    return F.transform(parts, lambda p: F.struct(F.substring(p, F.lit(1), F.char_length(p) - 1).cast("int").alias("n"), F.right(p, F.lit(1)).alias("op")))


def _total(ops: Column, letters: str) -> Column:
    return F.aggregate(ops, F.lit(0), lambda a, o: a + F.when(o["op"].isin(*letters), o["n"]).otherwise(0))


def reference_length(ops: Column) -> Column:
    return _total(ops, "MDN=X")


def leading_clip(ops: Column) -> Column:
    first, second = F.get(ops, F.lit(0)), F.get(ops, F.lit(1))
    return F.when(first["op"].isin("S", "H"), first["n"] + F.when((first["op"] == "H") & (second["op"] == "S"), second["n"]).otherwise(0)).otherwise(0)


def trailing_clip(ops: Column) -> Column:
    return leading_clip(F.reverse(ops))


def is_clipped(ops: Column) -> Column:
    return F.exists(ops, lambda o: o["op"].isin("S", "H"))
