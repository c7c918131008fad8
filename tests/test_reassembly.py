"""Local reassembly against plain loops, on the smallest tables."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest

from tidemark import catalog

SF, K = "/root/testdata/sf0.001", 9


@pytest.fixture(scope="module")
def reads(spark):
    return [r.asDict() for r in catalog._short_reads(spark, SF).collect()]


def de_bruijn(seqs):
    return Counter((s[i : i + K], s[i + 1 : i + K + 1]) for s in seqs for i in range(len(s) - K))


def places(reads):
    """Each k-mer's places and votes; a place is unknown where too many of the k-mer's bases are clipped."""
    out, allowed = defaultdict(Counter), int(0.3 * K) - 1
    for r in reads:
        for i in range(max(len(r["seq"]) - K + 1, 1)):
            at = r["unclipped_start"] + i
            if max(0, r["aln_start"] - at) <= allowed and max(0, at + K - 1 - r["aln_end"]) <= allowed:
                out[r["seq"][i : i + K]][at] += 1
    return out


def vote(votes):
    """The one place, or one with over twice the next one's votes."""
    ranked = sorted(((n, -p) for p, n in votes.items()), reverse=True)
    return -ranked[0][1] if ranked and (len(ranked) == 1 or ranked[0][0] > 2 * ranked[1][0]) else None


def test_haplotypes(spark, reads):
    edges = {e: n for e, n in de_bruijn([r["seq"] for r in reads]).items() if n >= 4}
    trusted = {r["seq"][i : i + K] for r in reads if r["mapq"] > 0 for i in range(max(len(r["seq"]) - K + 1, 1))}
    edges = {(a, b): n for (a, b), n in edges.items() if a in trusted and b in trusted}
    ways = defaultdict(list)
    for a, b in edges:
        ways[a].append(b)
    paths = set()

    def go(path):
        if not ways[path[-1]]:
            paths.add(tuple(path))
        for b in ways[path[-1]]:
            if b in path:
                paths.add(tuple(path))
            else:
                go([*path, b])

    for start in {a for a, _ in edges} - {b for _, b in edges}:
        go([start])
    known, found = {k: vote(v) for k, v in places(reads).items()}, []
    for p in paths:
        at = [known.get(x) for x in p]
        ends = [at[:3], at[-3:]]
        if len(p) >= 3 and all(None not in e and e[1] == e[0] + 1 and e[2] == e[1] + 1 for e in ends):
            seq = p[0] + "".join(x[-1] for x in p[1:])
            if len(p) > (106 - 98) // 2 // 2:
                found.append((round(sum(edges[e] for e in zip(p, p[1:])) / (len(p) - 1), 6), seq, at[0], at[-1] + K - 1))
    want = [(s, p, q, w) for w, s, p, q in sorted(found)[:4] if p < q]
    assert want and sorted(map(tuple, catalog.haplotypes(spark, SF).select("seq", "pos", "stop", "mean_weight").collect())) == sorted(want)


def test_best_contig(spark, reads):
    edges = de_bruijn([r["seq"] for r in reads])
    least = next(w for w in range(1, 10**6) if all(max(Counter(x[side] for x, n in edges.items() if n > w).values(), default=0) <= 1 for side in (0, 1)))
    kept = {a: b for (a, b), n in edges.items() if n > least}
    seqs = []
    for start in (set(kept) | set(kept.values())) - set(kept.values()):
        at, seq = start, start
        while at in kept:
            at = kept[at]
            seq += at[-1]
        seqs.append(seq)
    longest, known = max(seqs, key=lambda s: (len(s), s)), places([r for r in reads if r["mapq"] != 0])
    ends = [max(((n, -p) for p, n in known.get(x, {}).items()), default=None) for x in (longest[:K], longest[-K:])]
    want = [(longest, -ends[0][1], -ends[1][1] + K - 1)] if all(ends) else []
    assert want and list(map(tuple, catalog.best_contig(spark, SF).collect())) == want


def test_records_of_a_region_with_mates_elsewhere(spark):
    """Ten reads of a changed genome, their mates far off with other bases: these are no part of the graph; records align to the FASTA."""
    import random

    from tidemark.plans import reassembly as ra

    r = random.Random(3)
    genome = "".join(r.choice("ACGT") for _ in range(60))
    sample = genome[:25] + {"A": "C", "C": "G", "G": "T", "T": "A"}[genome[25]] + genome[26:]
    far = "".join(r.choice("ACGT") for _ in range(30))
    schema = "qname string, contig string, aln_start long, aln_end long, unclipped_start long, mapq int, seq string, unmapped boolean"
    rows = [(f"q{i}", "chr7", 11, 40, 11, 60, sample[10:40], False) for i in range(10)]
    rows += [(f"q{i}", "chr7", 5001, 5030, 5001, 60, far, False) for i in range(10)] + [(f"z{i}", "chr7", 20, 49, 20, 0, far[::-1], False) for i in range(10)]
    reads = spark.createDataFrame(rows, schema)
    p = ra.Parameters(k=15)
    assert ra.region_reads(reads, "chr7", 1, 60).count() == 20 and ra.region_reads(reads, "chr7", 1, 60, mates=True).count() == 30
    fasta = spark.createDataFrame([("8 other", far), ("7 main", genome)], "name string, seq string")
    out = ra.region_records(reads, fasta, "chr7", 1, 60, p).collect()
    assert [(x.contig, x.aln_start, x.mapq, x.seq, x.cigar, x.flag, x.qual) for x in out] == [("chr7", 11, 60, sample[10:40], "30M", 0, "*")]
    assert out[0].qname.startswith("Haplotype_chr7:11-40_")
    # The path has 16 k-mers: no more than a quarter of this region.
    assert ra.haplotypes(reads, "chr7", 1, 66, p).count() == 0
    found = spark.createDataFrame([(sample[10:40], 11, 40)], "seq string, pos long, stop long")
    assert ra.as_reads(found, fasta.where("false"), "chr7", p).collect() == []


def test_best_contig_of_all_reads(spark):
    """Reads of low quality make edges, but not places."""
    from tidemark.plans import reassembly as ra

    schema = "qname string, contig string, aln_start long, aln_end long, unclipped_start long, mapq int, seq string"
    genome = "ACGTTGCAGGATCA"
    rows = [("a", "chr7", 11, 20, 11, 5, genome[:10]), ("b", "chr7", 15, 24, 15, 60, genome[4:]), ("d", "chr7", 15, 24, 15, 60, genome[4:]), ("c", "chr7", 90, 99, 90, 0, genome[:10])]
    one = ra.best_contig(spark.createDataFrame(rows, schema), "chr7", 1, 120, ra.Parameters(k=6)).collect()
    assert [(x.seq, x.pos, x.stop) for x in one] == [(genome, 11, 24)]
