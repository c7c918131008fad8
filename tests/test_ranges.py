"""Aggregates over ranges against loops over all pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark import tables
from tidemark.operators import ranges as rg

INTERVALS = "contig string, start long, stop long, value long"


def intervals(n, seed, longest):
    """Of two contigs, with repeats, inverted ones, nulls, negative positions, and lengths from 0 on, of every order."""
    r, out = random.Random(seed), []
    for _ in range(n):
        start = r.randrange(-50, 300) if r.random() < 0.7 else r.randrange(longest)
        out.append((r.choice("cd"), start, start + r.randrange(10 ** r.randrange(len(str(longest)))), r.randrange(100)))
    return [*out, *out[:5], ("c", 9, 3, 1), (None, 1, 5, 1), ("c", None, 5, 1), ("c", 1, None, 1), ("d", 4, 4, None)]


def sound(x):
    return None not in x[:3] and x[1] <= x[2]


@pytest.mark.parametrize(("width", "longest"), [(16, 100), (1 << 16, 10**8)])
@pytest.mark.parametrize("within", [False, True])
def test_aggregates_against_all_pairs(spark, width, longest, within):
    own, asked = intervals(150, 1, longest), intervals(120, 2, longest)
    df = rg.aggregate_ranges(spark.createDataFrame(asked, INTERVALS), spark.createDataFrame(own, INTERVALS), {"total": F.col("value")}, within, width)
    got = sorted((tuple(r) for r in df.collect()), key=repr)
    want = []
    for x in asked:
        met = [y for y in own if sound(x) and sound(y) and x[0] == y[0] and ((x[1] <= y[1] and y[2] <= x[2]) if within else (y[1] <= x[2] and x[1] <= y[2]))]
        more = () if within else ((min(y[1] for y in met), max(y[2] for y in met)) if met else (None, None))
        want.append((*x, len(met), sum(y[3] or 0 for y in met) if met else None, *more))
    # The join puts the keys first, as they come first in the rows.
    assert df.columns == ["contig", "start", "stop", "value", "n", "total", *([] if within else ["first", "last"])]
    assert got == sorted(want, key=repr)


def test_empty_sides(spark):
    some, none = spark.createDataFrame([("c", 1, 5, 1)], INTERVALS), spark.createDataFrame([], INTERVALS)
    for within in (False, True):
        assert [r.n for r in rg.aggregate_ranges(some, none, within=within).collect()] == [0]
        assert rg.aggregate_ranges(none, some, within=within).collect() == []
    points = spark.createDataFrame([], "contig string, pos long, value long")
    assert rg.argmax_in_range(some, points).collect() == []
    assert rg.first_in_range(some, none).collect() == [] and rg.first_in_range(none, some).collect() == []


@pytest.mark.parametrize("longest", [100, 10**8])
def test_argmax_and_first_against_all_pairs(spark, longest):
    r = random.Random(3)
    asked = intervals(100, 4, longest)
    points = [(r.choice("cd"), r.choice([r.randrange(-60, 300), r.randrange(longest)]), r.choice([None, *range(6)])) for _ in range(200)]
    got = sorted((*x[:4], *x.best) for x in rg.argmax_in_range(spark.createDataFrame(asked, INTERVALS), spark.createDataFrame(points, "contig string, pos long, value long")).collect())
    want = []
    for x in asked:
        met = [p for p in points if sound(x) and p[0] == x[0] and x[1] <= p[1] <= x[2] and p[2] is not None]
        if met:
            best = max(met, key=lambda p: (p[2], -p[1]))
            want.append((*x, best[1], best[2]))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    starts = intervals(100, 5, longest)
    got = [(*x[:4], *x.first) for x in rg.first_in_range(spark.createDataFrame(asked, INTERVALS), spark.createDataFrame(starts, INTERVALS), 64).collect()]
    want = []
    for x in asked:
        met = [(p[1], p[2] if p[2] is not None else -1) for p in starts if sound(x) and p[0] == x[0] and p[1] is not None and x[1] <= p[1] <= x[2]]
        if met:
            want.append((*x, *min(met)))
    assert sorted(((*g[:5], -1 if g[5] is None else g[5]) for g in got), key=repr) == sorted(want, key=repr)


def test_a_range_over_a_million_points_reads_few_nodes(spark):
    points = spark.range(1 << 20).selectExpr("'c' AS contig", "id AS pos", "(id * 7919) % 1048573 AS value")
    asked = spark.createDataFrame([("c", 3, (1 << 20) - 5, 0)], INTERVALS)
    best = max(range(3, (1 << 20) - 4), key=lambda i: ((i * 7919) % 1048573, -i))
    out = rg.argmax_in_range(asked, points)
    assert [r.best.pos for r in out.collect()] == [best]


def test_equal_intervals_are_one_row(spark):
    reads = spark.createDataFrame([("c", 5, 9, 2)] * 4000 + [("c", 1, 9, 3)] * 3, "contig string, start long, stop long, v long")
    asked = spark.createDataFrame([("c", 4, 9), ("c", 0, 20)], "contig string, start long, stop long")
    found = rg.aggregate_ranges(asked, reads, {"v": F.col("v")}, within=True)
    assert sorted((r.start, r.n, r.v) for r in found.collect()) == [(0, 4003, 8009), (4, 4000, 8000)]
    # The tree's nodes are made for the two distinct intervals only.
    written = [p for p in tables._written[spark.sparkContext.applicationId] if "/intervals-" in p][-1]
    assert spark.read.parquet(written).count() == 2
