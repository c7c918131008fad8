"""Statistics whose definitions differ from Spark's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def legacy_percentile(xs: Column, p: float) -> Column:
    """Percentile of a sorted array at place p (n + 1) / 100, between neighbours in proportion; ends beyond the first and last place."""
    n = F.size(xs)
    place = F.lit(p / 100.0) * (n + 1)
    k = F.floor(place).cast("int")
    low = F.try_element_at(xs, F.greatest(F.least(k, n), F.lit(1)))
    high = F.try_element_at(xs, F.greatest(F.least(k + 1, n), F.lit(1)))
    return F.when(n == 0, F.lit(None)).when(place < 1, F.try_element_at(xs, F.lit(1))).when(place >= n, F.try_element_at(xs, F.lit(-1))).otherwise(low + (place - k) * (high - low))


def mean_or_zero(x: Column) -> Column:
    return F.coalesce(F.avg(x), F.lit(0.0))


def population_deviation(x: Column) -> Column:
    return F.coalesce(F.stddev_pop(x), F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; 0 / 0 is NaN."""
    return F.when(b == 0, F.when(a == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))).otherwise(a.cast("double") / b)
