"""Windows over bins against plain loops, and the island operators against folds."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.operators import edges as ed
from tidemark.operators import islands as isl
from tidemark.operators import joins as jn
from tidemark.operators import ranges as rg
from tidemark.operators.ordered import with_last, with_neighbour, with_running_sum
from tidemark.operators.sweep import as_bed, depth

INTERVALS = "contig string, start long, stop long"


def intervals(n=120, seed=1, inverted=False, value=False):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        a = r.randrange(-30, 200)
        b = a + (r.randrange(-6, 15) if inverted else r.randrange(0, 15))
        out.append((r.choice(["c1", "c1", "c2"]), a, b, *([r.randrange(5)] if value else [])))
    return out


@pytest.mark.parametrize("width", [1, 7, 1 << 16])
def test_neighbours_sums_and_last(spark, width):
    r = random.Random(2)
    rows = [(k, r.randrange(60), i, r.choice([None, i])) for i, k in enumerate(r.choice(["a", "b", None]) for _ in range(150))]
    df = spark.createDataFrame(rows, "k string, pos long, i long, v long")
    before = {x.i: x.p.i if x.p else None for x in with_neighbour(df, ["k"], ["pos", "i"], ["i"], "pos", "p", width=width).collect()}
    after = {x.i: x.p.i if x.p else None for x in with_neighbour(df, ["k"], ["pos", "i"], ["i"], "pos", "p", after=True, width=width).collect()}
    sums = {x.i: x.s for x in with_running_sum(df, ["k"], ["pos", "i"], F.col("i"), "pos", "s", width).collect()}
    last = {x.i: x.l for x in with_last(df, ["k"], ["pos", "i"], "v", "pos", "l", width).collect()}
    assert len(before) == len(after) == len(sums) == len(last) == len(rows)
    for k in ("a", "b", None):
        own = sorted(((p, i, v) for kk, p, i, v in rows if kk == k), key=lambda x: x[:2])
        total, seen = 0, None
        for n, (_, i, v) in enumerate(own):
            total += i
            seen = v if v is not None else seen
            assert before[i] == (own[n - 1][1] if n else None) and after[i] == (own[n + 1][1] if n + 1 < len(own) else None)
            assert sums[i] == total and last[i] == seen


@pytest.mark.parametrize("width", [5, 1 << 16])
def test_depth(spark, width):
    rows = intervals()
    got = sorted(map(tuple, depth(spark.createDataFrame(rows, INTERVALS), ["contig"], "start", "stop", width=width).select("contig", "start", "stop", "value").collect()))
    want = []
    for c in ("c1", "c2"):
        d = defaultdict(int)
        for k, a, b in rows:
            if k == c:
                d[a] += 1
                d[b] -= 1
        at, run = sorted(d), 0
        want.append((c, at[0] - 1, at[0], 0))
        for p, q in zip(at, at[1:]):
            run += d[p]
            want.append((c, p, q, run))
    assert got == sorted(want)
    assert depth(spark.createDataFrame([], INTERVALS), ["contig"], "start", "stop").collect() == []
    one = depth(spark.createDataFrame([("c", 4, 4)], INTERVALS), ["contig"], "start", "stop")
    assert sorted(map(tuple, as_bed(one).collect())) == [("c", 2, 3, 0)]


def merge_fold(rows):
    """Starts where the count of open intervals leaves zero, stops where it comes back, starts first at one position."""
    out = []
    for c in sorted({r[0] for r in rows}):
        marks = sorted([(a, 0) for k, a, _ in rows if k == c] + [(b, 1) for k, _, b in rows if k == c])
        starts, stops, n = [], [], 0
        for pos, kind in marks:
            if kind == 0:
                starts += [pos] if n == 0 else []
                n += 1
            else:
                stops += [pos] if n == 1 else []
                n -= 1
        out += [(c, a, b) for a, b in zip(starts, stops)]
    return out


@pytest.mark.parametrize("width", [5, 1 << 16])
def test_merge(spark, width):
    for seed in range(3):
        rows = intervals(60, seed)
        assert sorted(map(tuple, isl.merge_overlapping(spark.createDataFrame(rows, INTERVALS), width=width).collect())) == merge_fold(rows)
    touching = [("c", 1, 5), ("c", 5, 9), ("c", 10, 10), ("c", 12, 13)]
    assert sorted(map(tuple, isl.merge_overlapping(spark.createDataFrame(touching, INTERVALS)).collect())) == [("c", 1, 9), ("c", 10, 10), ("c", 12, 13)]


def test_inverted_intervals_cancel(spark):
    rows = [("c", 10, 4), ("c", 2, 20), ("c", 30, 40)]
    assert sorted(map(tuple, isl.merge_overlapping(spark.createDataFrame(rows, INTERVALS)).collect())) == merge_fold(rows)


def test_join_touching_and_close(spark):
    rows = [("c", a, b) for a, b in [(1, 10), (10, 16), (16, 17), (18, 19), (30, 40), (40, 42)]]
    df = spark.createDataFrame(rows, INTERVALS)
    assert sorted(map(tuple, isl.join_touching(df).select("contig", "start", "stop").collect())) == [("c", 1, 17), ("c", 18, 19), ("c", 30, 42)]
    assert sorted(map(tuple, isl.join_close(df, 11).select("contig", "start", "stop").collect())) == [("c", 1, 19), ("c", 30, 42)]
    assert sorted(map(tuple, isl.join_close(df, 12).select("contig", "start", "stop").collect())) == [("c", 1, 42)]
    assert isl.join_close(spark.createDataFrame([], INTERVALS)).collect() == []


def fill_fold(rows):
    out = []
    for c in sorted({r[0] for r in rows}):
        held = None
        for _, a, b, v in sorted(r for r in rows if r[0] == c):
            if held is None:
                held = [a, b, v]
            elif held[2] == v:
                held[1] = b
            elif held[1] - held[0] >= b - a:
                out.append((c, held[0], max(a, held[1]), held[2]))
                held = [a, b, v]
            else:
                out.append((c, *held))
                held = [min(a, held[1]), b, v]
        out.append((c, *held))
    return sorted(out)


@pytest.mark.parametrize("width", [7, 64, 1 << 16])
def test_fill(spark, width):
    """Ranges apart, touching and overlapping; chains in which each decision is the contrary of the one before, over many bins."""
    r, rows = random.Random(5), []
    for c in ("c1", "c2", "c3"):
        at = 0
        for _ in range(60):
            a = at + r.randrange(0, 6)
            at = a + r.randrange(1, 9)
            rows.append((c, a, at, r.randrange(3)))
    rows += [("chain", 10 * i, 10 * i + 6 - i % 2, i % 5) for i in range(100)]
    rows += [("long", 10 * i, 10 * i + 5, i) for i in range(60)]
    rows += [(f"mixed{k}", a, b, v) for k in range(6) for _, a, b, v in intervals(60, k, value=True)]
    df = spark.createDataFrame(rows, INTERVALS + ", value long")
    assert sorted(map(tuple, isl.fill_missing(df, width=width).collect())) == fill_fold(rows)
    tie = [("c", 0, 4, 1), ("c", 6, 10, 2), ("c", 12, 14, 2), ("c", 20, 40, 3)]
    assert sorted(map(tuple, isl.fill_missing(spark.createDataFrame(tie, INTERVALS + ", value long")).collect())) == [("c", 0, 6, 1), ("c", 6, 14, 2), ("c", 14, 40, 3)]
    assert isl.fill_missing(spark.createDataFrame([], INTERVALS + ", value long")).collect() == []


@pytest.mark.parametrize("width", [1, 16, 1024])
def test_overlap_join_by_bins(spark, width):
    a, b = intervals(80, 1, inverted=True), intervals(80, 2)
    left, right = spark.createDataFrame(a, INTERVALS), spark.createDataFrame(b, INTERVALS)
    got = sorted((tuple(r.a), tuple(r.b)) for r in jn.overlap_join(left, right, bin_width=width).collect())
    assert got == sorted((x, y) for x in a for y in b if x[0] == y[0] and x[1] <= x[2] and x[1] <= y[2] and y[1] <= x[2])
    within = sorted((tuple(r.a), tuple(r.b)) for r in jn.overlap_join(left, right, "within", width).collect())
    assert within == sorted((x, y) for x in a for y in b if x[0] == y[0] and x[1] <= x[2] and y[1] <= x[1] and x[2] <= y[2])


def test_overlap_join_of_all_lengths(spark):
    """Lengths from 1 to 10^8, bins dealt to several tasks, repeated rows, nulls; and how many places an interval has."""
    r = random.Random(7)
    rows = lambda n: [(r.choice("cd"), s := r.choice([r.randrange(-100, 2000), r.randrange(10**8)]), s + r.randrange(10 ** r.randrange(9)), i) for i in range(n)]  # noqa: E731, F841
    a, b = rows(150), rows(150)
    a, b = [*a, *a[:3], ("c", 0, 249_999_999, -1), (None, 1, 2, -2), ("c", None, 2, -3), ("c", 5, 4, -4)], [*b, *b[:3], ("c", 3, None, -5)]
    schema = INTERVALS + ", i long"
    left, right = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    sound = lambda x: None not in x and x[1] <= x[2]
    for how in ("overlap", "within"):
        got = sorted((tuple(x.a), tuple(x.b)) for x in jn.overlap_join(left, right, how, most=5).collect())
        assert got == sorted((x, y) for x in a for y in b if sound(x) and sound(y) and x[0] == y[0] and ((x[1] <= y[2] and y[1] <= x[2]) if how == "overlap" else (y[1] <= x[1] and x[2] <= y[2])))
    homes = jn.in_bins(left, True).where("part = 1").groupBy("item.i").count()
    assert homes.agg(F.max("count")).first()[0] <= 4  # a repeated row's two copies, in two bins each
    assert homes.where("i = -1").first()["count"] <= 2


def test_argmax_takes_the_first_of_equals(spark):
    ranges = spark.createDataFrame([("c", 0, 10), ("c", 20, 30)], INTERVALS)
    points = spark.createDataFrame([("c", 3, 5), ("c", 2, 5), ("c", 10, 4), ("c", 31, 9), ("d", 1, 9)], "contig string, pos long, value long")
    assert [(r.start, r.best.pos, r.best.value) for r in rg.argmax_in_range(ranges, points).collect()] == [(0, 2, 5)]


def test_bridges(spark):
    ranges = spark.createDataFrame([("c", 10, 20), ("c", 40, 50), ("c", 70, 80), ("c", 100, 101)], INTERVALS)
    bridges = spark.createDataFrame([("c", 20, 25), ("c", 12, 30), ("c", 5, 45), ("c", 60, 70), ("c", 90, 95)], INTERVALS)
    got = sorted((r.start, *r.bridge) for r in jn.bridge(ranges, bridges).collect())
    assert got == [(10, 12, 30), (70, 75, 70)]


def test_edges_at_their_thresholds(spark):
    rows = [("c", 0, 5, 0), ("c", 5, 9, 10), ("c", 9, 12, 1), ("c", 14, 20, 30), ("c", 20, 22, 30)]
    df = spark.createDataFrame(rows, INTERVALS + ", value long")
    assert sorted((r.start, r.height) for r in ed.jumps(df, 10).collect()) == [(5, 10)]
    assert sorted((r.start, r.height) for r in ed.jumps(df, 9).collect()) == [(5, 10), (9, -9)]
    assert sorted((r.start, r.kind, r.height) for r in ed.changes(df, 10).collect()) == [(14, "jump", 29)]
    assert sorted((r.pos, r.height, r.at_gap) for r in ed.jumps_with_gaps(df, 0).collect()) == [(5, 10, False), (9, -9, False), (12, -1, True), (14, 30, True)]
    assert sorted(tuple(r)[1:] for r in ed.level_segments(df, 8).collect()) == [(0, 5, 0), (5, 9, 10), (9, 12, 1), (14, 22, 30)]
    assert [r.depth for r in ed.average_depth(df).collect()] == [(40 + 3 + 180 + 60) // 15]


def test_plans_read_their_input_few_times(spark):
    """One window pass reads its input twice, once for the rows and once for the bins; what feeds several branches is written down."""
    from tidemark import catalog

    def scans(name):
        return catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString().count("FileScan")

    found = {name: scans(name) for name in ("signal_segments", "level_segments", "bridged_increases", "asof_bridge")}
    assert all(n <= most for n, most in zip(found.values(), (2, 4, 9, 8))), found
