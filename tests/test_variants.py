from __future__ import annotations

import datetime
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark import tables
from tidemark.functions.align import alignment_ops, cigar
from tidemark.functions.stats import legacy_percentile, mean_or_zero, population_deviation
from tidemark.operators import variants as va
from tidemark.plans import callers as ca
from tidemark.sources import vcf

INFO = "IMPRECISE;SVTYPE=DEL;END=321887;SVLEN=-205;CIPOS=-56,20;CIPOS=-1,2;x=a=b;;NS"


def lines(spark, *rows):
    return spark.createDataFrame([(r, i) for i, r in enumerate(rows)], "value string, ord long")


def test_info(spark):
    got = spark.createDataFrame([(INFO,), ("",), (None,)], "i string").select(va.parse_info(F.col("i")).alias("m"), va.write_info(va.parse_info(F.col("i"))).alias("t")).collect()
    assert got[0].m == {"IMPRECISE": "IMPRECISE", "SVTYPE": "DEL", "END": "321887", "SVLEN": "-205", "CIPOS": "-1,2", "x": "a", "NS": "NS"}
    assert got[0].t == "CIPOS=-1,2;END=321887;IMPRECISE;NS;SVLEN=-205;SVTYPE=DEL;x=a"
    assert got[1].m == {} and got[2].m is None


def test_rows_and_coordinates(spark):
    rows = lines(spark, "##head", "#CHROM\tPOS", "1\t10632\ta\tC\t<DEL>\t.\tPASS\tEND=10743;SVLEN=+261\tGT\t0/1", "chr1\t67811\tb\tT\t<INV>\t.\tPASS\tSVLEN=False", "1\tno\tc\tA\tT\t.\t.\tX", "short\t1")
    got = va.coordinates(va.parse_lines(rows)).orderBy("ord").collect()
    assert [(r.chr, r.start, r.stop, r.length, r.opt) for r in got] == [("chr1", 10632, 10743, 261, ["GT", "0/1"]), ("chr1", 67811, 67812, None, [])]
    assert [r.stop for r in va.interval_by_length(va.parse_lines(rows)).collect()] == [10632 + 261]
    assert [r.stop for r in va.interval_by_end(va.parse_lines(rows)).collect()] == [10743]
    assert [r.value for r in vcf.position_lines(va.parse_lines(rows)).collect()] == ["chr1:10,632-10,743", "chr1:67,811-67,812"]


@pytest.mark.parametrize(("factor", "want"), [(0.5, (101, 104)), (1.0, (100, 105)), (3.0, (95, 110))])
def test_scaled_windows(spark, factor, want):
    df = spark.createDataFrame([(100, 105), (1, 9)], "a int, b int")
    got = [tuple(r) for r in df.select(*va.scaled_window(F.col("a"), F.col("b"), factor)).collect()]
    assert got[0] == want and got[1][0] >= 1


def test_edits(spark):
    rows = lines(spark, "#h", "c\t1\tx\tA\tT", "c\t2\ty\tG\tC")
    numbered = va.fill_reference(va.renumber(rows, "ord", "n")).orderBy("ord").collect()
    assert [r.value for r in numbered] == ["#h", "c\t1\tn0\tN\tT", "c\t2\tn1\tN\tC"]
    assert [r.value for r in va.filter_lines(rows, F.col("value").contains("y")).orderBy("ord").collect()] == ["#h", "c\t2\ty\tG\tC"]


SETS = "contig string, start long, stop long, ord long"


def test_compare(spark):
    truth = spark.createDataFrame([("c", 1000, 2000, 0), ("c", 5000, 6001, 1), ("d", 10, 20, 2)], SETS)
    found = spark.createDataFrame([("c", 1000, 1600, 0), ("c", 5000, 5800, 1), ("c", 1000, 1650, 2), ("e", 1, 2, 3)], SETS)
    parts = {k: sorted((r.contig, r.start, r.stop) for r in v.collect()) for k, v in va.compare(truth, found, ["ord"]).items()}
    assert parts == {"found": [("c", 1000, 2000)], "missed": [("c", 5000, 6001), ("d", 10, 20)], "false_positives": [("c", 1000, 1600), ("c", 5000, 5800), ("e", 1, 2)]}
    stats = {r.contig: r for r in va.statistics(truth, found, ["ord"]).collect()}
    assert (stats[None].tp, stats[None].fn, stats[None].fp, stats[None].n_candidates) == (1, 2, 3, 4)
    assert stats["c"].precision == pytest.approx(1 / 3) and stats["e"].recall != stats["e"].recall
    half = va.compare(truth, found, ["ord"], va.accept_half)
    assert half["found"].count() == 2
    none = truth.limit(0)
    assert va.statistics(none, none, ["ord"]).where("contig IS NOT NULL").collect() == []


def test_vcf_round_trip(spark, tmp_path):
    calls = vcf.calls(spark.createDataFrame([("chr1", 5, 25), ("chr2", 7, 9)], "contig string, start long, stop long"), "<DEL>")
    vcf.write_vcf(calls, str(tmp_path / "v"), "s1", ("##one", "##two"))
    back = vcf.read_vcf(spark, str(tmp_path / "v")).orderBy("chr").collect()
    assert [(r.chr, r.pos, r.alt, r.info["END"], r.info["SVLEN"], r.info["TESTING"], r.opt) for r in back] == [("chr1", 5, "<DEL>", "25", "20", "TESTING", ["GT", "0/1"]), ("chr2", 7, "<DEL>", "9", "2", "TESTING", ["GT", "0/1"])]
    head = vcf.header("s1", ("##one",), datetime.date(2024, 12, 30))
    assert head[1] == "##fileDate=20241230" and head[2] == "##one" and head[-1].endswith("FORMAT\ts1")
    assert vcf.file_name("out", "chr1", "dup") == "out/chr1_dup.vcf"


@pytest.mark.parametrize(("a", "b", "want"), [("ACGT", "CG", "1I2M1I"), ("AACAA", "AACGTAA", "3M2D2M"), ("", "ACG", "3D"), ("AC", "", "2I"), ("", "", ""), ("acgt", "ACGT", "4M"), ("A", None, None)])
def test_cigars(a, b, want):
    assert cigar(a, b) == want


def test_alignment_is_optimal_and_whole():
    import random

    r = random.Random(1)

    def score(s, t):
        """Best score by the textbook three-state recursion."""
        low = -(10**9)
        m = {(0, 0): 0}
        x, y = {}, {}
        for i in range(len(s) + 1):
            for j in range(len(t) + 1):
                if i or j:
                    x[i, j] = max(m.get((i - 1, j), low) - 5, x.get((i - 1, j), low) - 1, y.get((i - 1, j), low) - 5)
                    y[i, j] = max(m.get((i, j - 1), low) - 5, y.get((i, j - 1), low) - 1, x.get((i, j - 1), low) - 5)
                    diag = max(d.get((i - 1, j - 1), low) for d in (m, x, y)) if i and j else low
                    m[i, j] = diag + (5 if i and j and s[i - 1] == t[j - 1] else -4)
        return max(d.get((len(s), len(t)), low) for d in (m, x, y))

    for _ in range(60):
        s, t = ("".join(r.choice("ACGT") for _ in range(r.randrange(0, 14))) for _ in range(2))
        ops, i, j, total = alignment_ops(s, t), 0, 0, 0
        for k, op in enumerate(ops):
            if op == "M":
                total += 5 if s[i] == t[j] else -4
                i, j = i + 1, j + 1
            else:
                total -= 1 if k and ops[k - 1] == op else 5
                i, j = i + (op == "I"), j + (op == "D")
        assert (i, j) == (len(s), len(t)) and total == score(s, t), (s, t, ops)


def test_percentiles_and_moments(spark):
    df = spark.createDataFrame([([float(i) for i in range(1, 1001)],), ([3.0],), ([1.0, 2.0],), ([],)], "x array<double>")
    got = [tuple(r) for r in df.select(*(legacy_percentile(F.col("x"), p) for p in (0.5, 50.0, 99.5))).collect()]
    assert got[0] == pytest.approx((5.005, 500.5, 995.995)) and got[1] == (3.0, 3.0, 3.0) and got[2] == (1.0, 1.5, 2.0) and got[3] == (None, None, None)
    none = spark.createDataFrame([], "x int").agg(mean_or_zero(F.col("x")), population_deviation(F.col("x"))).first()
    assert tuple(none) == (0.0, 0.0)


def share_brute(truth, candidates):
    def ok(s1, e1, s2, e2):
        return max(0, min(e1, e2) - max(s1, s2)) / max(max(e1 - s1, 1), max(e2 - s2, 1)) >= (0.6 if e1 - s1 <= 1000 else 0.8)

    def hit(c, s, e):
        r = int((e - s) * (0.4 if e - s <= 1000 else 0.2) // 1)
        return any(c == c2 and s - r <= s2 <= s + r and ok(s, e, s2, e2) for c2, s2, e2 in set(candidates))

    tp = Counter(c for c, s, e in truth if hit(c, s, e))
    n, m = Counter(c for c, *_ in truth), Counter(c for c, *_ in candidates)
    return {(c, tp[c], n[c] - tp[c], m[c] - tp[c], m[c]) for c in n | m}


def test_shares_of_piled_and_long_intervals(spark):
    r = random.Random(4)

    def some(n):
        return [(r.choice("xy"), s, s + r.choice([-3, 0, 1, 10, 40, 90, 900, 1001, 5000, 70000]) + r.randrange(9)) for s in (r.randrange(-50, 3000) for _ in range(n))]

    truth, candidates = some(300) + [("z", 7, 90)] * 30, some(300) + [("z", 8, 91)] * 3 + [("w", 1, 2)]
    schema = "contig string, start long, stop long"
    got = va.compare_by_share(spark.createDataFrame(truth, schema), spark.createDataFrame(candidates, schema)).collect()
    assert {(x.contig, x.tp, x.fn, x.fp, x.n_candidates) for x in got} == share_brute(truth, candidates)


def test_share_makes_no_pairs(spark):
    rows = spark.createDataFrame([("c", 100 + i % 50, 190 + i % 70) for i in range(20_000)], "contig string, start long, stop long")
    found = va.compare_by_share(rows, rows)
    assert "LeftSemi" in found._jdf.queryExecution().toString().split("near")[0] and found.first().tp == 20_000
    written = [p for p in tables._written[spark.sparkContext.applicationId] if "/truths-" in p][-1]
    assert spark.read.parquet(written).count() == rows.distinct().count()


def test_links_and_inversions_of_piled_reads(spark):
    r = random.Random(5)
    events = [("c", s, s + r.choice([-1, 0, 5, 40, 300])) for s in (r.randrange(-20, 400) for _ in range(80))] * 3
    reads = [("c", s, s + r.randrange(0, 30), r.choice("de"), r.randrange(0, 300)) for s in (r.randrange(-20, 500) for _ in range(150))] * 2
    df = spark.createDataFrame(reads, "contig string, aln_start long, aln_end long, mate_contig string, mate_start long").withColumns({"unmapped": F.lit(False), "mate_unmapped": F.lit(False), "mapq": F.lit(9)})
    want = Counter((c, s // 50, mc, ms // 50) for c, s, e in events for c2, a, b, mc, ms in reads if s <= e and a <= e and s <= b)
    got = ca.graph_bins(spark.createDataFrame(events, "contig string, start long, stop long"), df, 50).collect()
    assert {(x.contig, x.bin, x.mate_contig, x.mate_bin): x.n for x in got} == {k: n for k, n in want.items() if n > 10}
    written = [p for p in tables._written[spark.sparkContext.applicationId] if "/asked-" in p][-1]
    assert spark.read.parquet(written).count() < len(got) * 300
