"""Neighbour and running-sum windows that don't put one key's rows into one task.

Rows are cut into bins of positions. A window runs within each (key, bin); what crosses a bin's edge comes from one row
per bin, over which a second, small window runs. Both big steps hash by (key, bin), so the join back needs no further
shuffle of the rows. All that one order can tell is computed in one such pass: neighbours, sums and last values together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Positions of one bin.
WIDTH = 1 << 16


def _binned(df: DataFrame, pos: str, width: int) -> DataFrame:
    return df.withColumn("__bin", F.floor(F.col(pos) / width))


def _join_bins(rows: DataFrame, by_bin: DataFrame, keys: list[str]) -> DataFrame:
    """Each row with the columns of its bin's one row, keys and bins compared null-safely."""
    renamed = by_bin.withColumnsRenamed({k: f"__k_{k}" for k in keys} | {"__bin": "__b"})
    on = F.col("__bin").eqNullSafe(F.col("__b"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return rows.join(renamed, on).drop("__bin", "__b", *(f"__k_{k}" for k in keys))


def with_context(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    pos: str,
    width: int = WIDTH,
    before: dict[str, list[str]] | None = None,
    after: dict[str, list[str]] | None = None,
    sums: dict[str, Column] | None = None,
    last: dict[str, str] | None = None,
    greatest: dict[str, Column] | None = None,
    least: dict[str, Column] | None = None,
) -> DataFrame:
    """Add, within ``keys`` by ``order`` (total, ``pos`` first), under each name: ``before`` and ``after`` the struct of these columns
    of the row before or behind (null at the end), ``sums`` the sum of these values up to and with the row, ``last`` the last
    value of the column that isn't null up to and with the row, ``greatest`` the largest value up to and with the row, ``least``
    the least value from the row on. Rows with a null ``pos`` sort into a bin of their own, first.
    """
    before, after, sums, last, greatest, least = (x or {} for x in (before, after, sums, last, greatest, least))
    valued = sums | greatest | least
    rows = _binned(df, pos, width).withColumns({f"__v_{n}": v for n, v in valued.items()})
    inside = W.partitionBy(*keys, "__bin").orderBy(*order)
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    edge = {n: F.max(F.struct(*order, F.struct(*c).alias("__c"))) for n, c in before.items()} | {n: F.min(F.struct(*order, F.struct(*c).alias("__c"))) for n, c in after.items()}
    edge |= {n: F.sum(f"__v_{n}") for n in sums} | {n: F.max(F.when(F.col(c).isNotNull(), F.struct(*order, F.col(c).alias("__c")))) for n, c in last.items()}
    edge |= {n: F.max(f"__v_{n}") for n in greatest} | {n: F.min(f"__v_{n}") for n in least}
    bins = rows.groupBy(*keys, "__bin").agg(*(x.alias(f"__e_{n}") for n, x in edge.items()))
    across = W.partitionBy(*keys).orderBy("__bin")
    prior = across.rowsBetween(W.unboundedPreceding, -1)
    # Frames that end at the last row are computed anew for each row; running the other way they aren't.
    later = W.partitionBy(*keys).orderBy(F.col("__bin").desc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    onward = W.partitionBy(*keys, "__bin").orderBy(*(F.col(c).desc_nulls_last() for c in order)).rowsBetween(W.unboundedPreceding, 0)
    carried = {n: F.lag(f"__e_{n}.__c").over(across) for n in before} | {n: F.lead(f"__e_{n}.__c").over(across) for n in after}
    carried |= {n: F.coalesce(F.sum(f"__e_{n}").over(prior), F.lit(0)) for n in sums} | {n: F.last(f"__e_{n}.__c", ignorenulls=True).over(prior) for n in last}
    carried |= {n: F.max(f"__e_{n}").over(prior) for n in greatest} | {n: F.min(f"__e_{n}").over(later) for n in least}
    bins = bins.select(*keys, "__bin", *(x.alias(f"__x_{n}") for n, x in carried.items()))
    within = {n: F.lag(F.struct(*c)).over(inside) for n, c in before.items()} | {n: F.lead(F.struct(*c)).over(inside) for n, c in after.items()}
    within |= {n: F.sum(f"__v_{n}").over(upto) for n in sums} | {n: F.last(c, ignorenulls=True).over(upto) for n, c in last.items()}
    within |= {n: F.max(f"__v_{n}").over(upto) for n in greatest} | {n: F.min(f"__v_{n}").over(onward) for n in least}
    rows = rows.withColumns({f"__i_{n}": x for n, x in within.items()}).drop(*(f"__v_{n}" for n in valued))
    joined = _join_bins(rows, bins, keys)
    joint = {n: F.greatest for n in greatest} | {n: F.least for n in least} | {n: lambda i, x: F.col(i) + F.col(x) for n in sums}
    made = {n: joint.get(n, F.coalesce)(f"__i_{n}", f"__x_{n}") for n in carried}
    return joined.withColumns(made).drop(*(f"__{p}_{n}" for n in carried for p in "ix"))


def with_neighbour(df: DataFrame, keys: list[str], order: list[str], columns: list[str], pos: str, name: str, after: bool = False, width: int = WIDTH) -> DataFrame:
    """Add the struct ``name`` with ``columns`` of the row before (``after``: of the row behind)."""
    return with_context(df, keys, order, pos, width, **{"after" if after else "before": {name: columns}})


def with_running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, pos: str, name: str, width: int = WIDTH) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows up to and with this one."""
    return with_context(df, keys, order, pos, width, sums={name: value})


def with_last(df: DataFrame, keys: list[str], order: list[str], column: str, pos: str, name: str, width: int = WIDTH) -> DataFrame:
    """Add ``name``: the last value of ``column`` that isn't null, up to and with this row."""
    return with_context(df, keys, order, pos, width, last={name: column})


def with_islands(df: DataFrame, keys: list[str], order: list[str], begins: Callable[[Column], Column], columns: list[str], pos: str, name: str, width: int = WIDTH) -> DataFrame:
    """Add ``name``: a number of the row's island within ``keys``. A row begins one if it has no row before it or
    ``begins(previous)``, where previous is the struct of ``columns`` of the row before, and ``begins`` reads, of the row itself,
    columns of ``order`` and ``columns`` only. Null counts as false.
    """
    inside = W.partitionBy(*keys, "__bin").orderBy(*order)
    rows = _binned(df, pos, width).withColumn("__prev", F.lag(F.struct(*columns)).over(inside))
    # A bin's first row is decided by its bin's row, which knows the bin before.
    rows = rows.withColumn("__new", F.when(F.col("__prev").isNotNull() & begins(F.col("__prev")), 1).otherwise(0))
    own = list(dict.fromkeys([*order, *columns]))
    bins = rows.groupBy(*keys, "__bin").agg(F.sum("__new").alias("__n"), F.min(F.struct(*own)).alias("__f"), F.max(F.struct(*order, F.struct(*columns).alias("__c"))).alias("__l"))
    across = W.partitionBy(*keys).orderBy("__bin")
    bins = bins.withColumn("__prev", F.lag("__l.__c").over(across)).select(*keys, "__bin", "__n", "__prev", *(F.col(f"__f.{c}").alias(c) for c in own if c not in keys))
    bins = bins.withColumn("__first", F.when(F.col("__prev").isNull() | begins(F.col("__prev")), 1).otherwise(0))
    earlier = F.sum(F.col("__n") + F.col("__first")).over(across.rowsBetween(W.unboundedPreceding, -1))
    bins = bins.select(*keys, "__bin", (F.coalesce(earlier, F.lit(0)) + F.col("__first")).alias("__x"))
    rows = rows.withColumn("__i", F.sum("__new").over(inside.rowsBetween(W.unboundedPreceding, 0))).drop("__prev", "__new")
    return _join_bins(rows, bins, keys).withColumn(name, F.col("__i") + F.col("__x")).drop("__i", "__x")
