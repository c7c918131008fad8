from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import graph as gr
from tidemark.operators import kmers as km
from tidemark.plans import reassembly as ra


def edges(spark, pairs, weight=1):
    return spark.createDataFrame([(a, b, weight) if len(p) == 2 else p for p in pairs for a, b in [p[:2]]], gr.EDGE_SCHEMA)


TRIANGLE = [("A", "B"), ("B", "C"), ("C", "A")]


@pytest.mark.parametrize(("more", "loop"), [([], None), ([("B", "D")], ["B", "C", "A", "B", "D"]), ([("B", "D"), ("D", "C")], None)])
def test_loops(spark, more, loop):
    e = edges(spark, TRIANGLE + more)
    found = [r.path for r in gr.find_loop(gr.vertices_of(e), e).collect()]
    assert found == ([loop] if loop else [])


def test_loop_from_an_end(spark):
    e = edges(spark, TRIANGLE + [("D", "C")])
    assert [r.path for r in gr.find_loop(gr.vertices_of(e), e).collect()] == [["D", "C", "A", "B", "C"]]


def paths_brute(pairs):
    out, dst = {}, {b for _, b in pairs}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
    found = set()

    def go(path):
        ways = out.get(path[-1], [])
        if not ways:
            found.add(tuple(path))
        for w in ways:
            if w in path:
                found.add(tuple(path))
            else:
                go([*path, w])

    for s in {a for a, _ in pairs} - dst:
        go([s])
    return found


def test_simple_paths_and_strands(spark):
    r = random.Random(1)
    for _ in range(1):
        pairs = sorted({(f"v{r.randrange(7)}", f"v{r.randrange(7)}") for _ in range(8)} | {("s", "v1"), ("t", "v2")})
        e = edges(spark, pairs)
        assert {tuple(x.path) for x in gr.simple_paths(gr.vertices_of(e), e).collect()} == paths_brute(pairs)
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("c", "e"), ("x", "y"), ("y", "x"), ("z", "x")])
    assert sorted(x.path for x in gr.single_strands(gr.vertices_of(e), e).collect()) == [["a", "b", "c"], ["z", "x", "y"]]


def test_paths_of_any_length(spark):
    chain = [f"v{i:04d}" for i in range(1101)]
    e = edges(spark, list(zip(chain, chain[1:])))
    assert [r.path for r in gr.single_strands(gr.vertices_of(e), e).collect()] == [chain]
    short = chain[:111]
    e = edges(spark, list(zip(short, short[1:])))
    assert [r.path for r in gr.simple_paths(gr.vertices_of(e), e).collect()] == [short]
    e = edges(spark, list(zip(short, short[1:])) + [(short[-1], short[1])])
    assert [r.path for r in gr.find_loop(gr.vertices_of(e), e).collect()] == [[*short, short[1]]]


def test_a_given_depth_fails_loudly(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "d")])
    assert [r.path for r in gr.simple_paths(gr.vertices_of(e), e, deepest=3).collect()] == [["a", "b", "c", "d"]]
    with pytest.raises(Exception, match="longer than 2 steps"):
        gr.simple_paths(gr.vertices_of(e), e, deepest=2).collect()


def test_pruning_and_ends(spark):
    e = edges(spark, [("a", "b", 5), ("b", "c", 1), ("c", "d", 7), ("e", "e", 9)])
    v = gr.vertices_of(e)
    pruned, kept = gr.prune_edges(v, e, F.col("weight") < 5)
    assert {r.id for r in pruned.collect()} == {"a", "b", "c", "d", "e"} and kept.count() == 3
    left, links = gr.prune_vertices(v, e, spark.createDataFrame([("b",)], "id string"))
    assert {r.id for r in left.collect()} == {"c", "d", "e"} and links.count() == 2
    assert {r.id for r in gr.starting_points(v, e).collect()} == {"a"} and {r.id for r in gr.ending_points(v, e).collect()} == {"d"}
    assert {tuple(r) for r in gr.transpose(e).collect()} == {("b", "a", 5), ("c", "b", 1), ("d", "c", 7), ("e", "e", 9)}
    none_v, none_e = gr.empty(spark)
    assert gr.starting_points(none_v, none_e).collect() == [] and gr.remove_unconnected(none_v, none_e).collect() == []


def test_edge_weights(spark):
    e = edges(spark, [("a", "b", 2)])
    assert [tuple(r) for r in gr.add_edges(e, e).collect()] == [("a", "b", 4)]
    assert gr.add_edges(e, e, parallel=True).count() == 2
    assert [tuple(r) for r in gr.set_weights(e, edges(spark, [("a", "b", 1)])).collect()] == [("a", "b", 1)]
    assert [(r.src, r.out) for r in gr.adjacency(edges(spark, [("a", "c"), ("a", "b"), ("a", "b")])).collect()] == [("a", ["b", "c"])]


def threshold_loop(rows, limit):
    for w in range(1, limit + 1):
        kept = [(a, b) for a, b, x in rows if x > w]
        if len({a for a, _ in kept}) == len(kept) and len({b for _, b in kept}) == len(kept):
            return w
    return None


def test_thread_threshold_as_the_loop(spark):
    r = random.Random(7)
    for limit in (4, 30):
        for _ in range(2):
            rows = [(a, b, r.randrange(1, 12)) for a, b in sorted({(f"v{r.randrange(6)}", f"v{r.randrange(6)}") for _ in range(r.randrange(1, 9))})]
            assert gr.thread_threshold(edges(spark, rows), limit).first().threshold == threshold_loop(rows, limit)
    assert gr.thread_threshold(edges(spark, [])).first().threshold == 1


def test_degree_checks(spark):
    for pairs, want in [([("a", "b"), ("b", "c")], (True, True, True, True)), ([("a", "b"), ("c", "d")], (True, True, True, False)), ([("a", "b"), ("a", "c")], (False, True, False, False)), ([("a", "b"), ("c", "b")], (True, False, False, False))]:
        e = edges(spark, pairs)
        assert tuple(gr.degree_checks(gr.vertices_of(e), e).first()) == want


def test_long_chains_by_pointer_jumping(spark):
    pairs = [(f"v{i:04d}", f"v{i + 1:04d}") for i in range(300)] + [("x", "y"), ("x", "z"), ("z", "w"), ("c1", "c2"), ("c2", "c1")]
    got = {r.id: (r.head, r.distance) for r in gr.longest_runs(edges(spark, pairs)).collect()}
    assert all(got[f"v{i:04d}"] == ("v0000", i) for i in range(301))
    assert got["y"] == ("y", 0) and got["w"] == ("z", 1) and "c1" not in got


def test_kmers_and_contigs(spark):
    reads = spark.createDataFrame([("ACGTAC",), ("ACG",), ("AC",), ("",), (None,)], "seq string")
    assert sorted(r.kmer for r in km.kmers(reads, 3).collect()) == sorted(["ACG", "CGT", "GTA", "TAC", "ACG", "AC"])
    assert sorted(map(tuple, km.de_bruijn(reads, 3).collect())) == [("ACG", "CGT", 1), ("CGT", "GTA", 1), ("GTA", "TAC", 1)]
    assert [r.seq for r in km.contigs(km.de_bruijn(reads, 3)).collect()] == ["ACGTAC"]
    assert sorted((r.kmer, r.reads) for r in km.read_sets(reads.withColumn("i", F.monotonically_increasing_id() * 0), 3, "i").collect())[0] == ("AC", [0])


@pytest.mark.parametrize("k", [1, 2, 9, 31, 32, 52, 62, 63])
def test_packed_counts_as_texts(spark, k, monkeypatch):
    monkeypatch.setattr(km, "SLICE", 50)
    r = random.Random(k)
    seqs = ["".join(r.choice("ACGT" * 9 + "Nac") for _ in range(r.randrange(0, 300))) for _ in range(30)] + ["A" * 200] * 3 + ["ACGé" * 40, "ACG\nTT", "", None, "ACGT" * 20]
    want = Counter(s[i : i + k] for s in seqs if s for i in range(len(s) - k + 1))
    reads = spark.createDataFrame([(s,) for s in seqs], "seq string")
    assert {x.kmer: x.n for x in km.count_kmers(reads, k).collect()} == want
    total = Counter()
    for (numbers, counts), odd in km._count_batch([s for s in seqs if s], k) if k <= km.TWO_LONGS else []:
        total.update(odd)
        for row in zip(*(c.tolist() for c in numbers), counts.tolist()):
            number = row[0] if k <= km.ONE_LONG else row[0] << 62 | row[1]
            total["".join("ACGT"[number >> 2 * (k - 1 - i) & 3] for i in range(k))] += row[-1]
    assert total == (want if k <= km.TWO_LONGS else {})


ODD_READS = [(i % 7 if i % 5 else None, x) for i, x in enumerate(["ACGTACGTTTGACA" * 4, "ACGTACNTTTGACA" * 3, "ACGé" * 9, "AC", "N", "", None, "ACG\nTTA", "A" * 70, "AC", "ACGTACGTTTGACA" * 2] * 3)]


def pieces_brute(s, k):
    return [s[i : i + k] for i in range(max(len(s) - k + 1, 1))] if s else []


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("k", [1, 2, 5, 11, 31, 32])
def test_kmers_by_stretches(spark, k, monkeypatch, small_batches):
    monkeypatch.setattr(km, "SLICE", 50)
    monkeypatch.setattr(km, "BUCKETS", 3)
    reads = spark.createDataFrame(ODD_READS, "i long, seq string")
    n, sets = Counter(), {}
    for i, s in ODD_READS:
        for x in pieces_brute(s, k):
            n[x] += 1
            sets.setdefault(x, set()).update([i] if i is not None else [])
    for chosen in (reads, reads.withColumn("i", F.col("i").cast("string"))):
        got = {r.kmer: r.reads for r in km.read_sets(chosen, k, "i").collect()}
        assert {x: set(map(int, y)) for x, y in got.items()} == sets and all(y == sorted(set(y)) for y in got.values())
    got = km.counts_and_reads(reads, k, "i").collect()
    assert len(got) == len(n) and {r.kmer: (r.n, r.n_reads) for r in got} == {x: (n[x], len(sets[x])) for x in n}
    numbers = km.annotate_reads(reads, k).collect()
    want = {r.seq: r.x for r in reads.select("seq", F.transform(km.pieces(F.col("seq"), k), km.number_of).alias("x")).collect()}
    assert len(numbers) == len(ODD_READS) and all(r.numbers == want[r.seq] for r in numbers)


@pytest.mark.parametrize("k", [11, 29, 31, 51, 62])
def test_clean_reads_keep_all_letters(spark, k):
    r = random.Random(k)
    seqs = ["".join(r.choice("ACGT") for _ in range(200)) for _ in range(20)]
    reads = spark.createDataFrame(list(enumerate(seqs)), "i long, seq string")
    want = Counter(x for s in seqs for x in pieces_brute(s, k))
    assert {x.kmer: x.n for x in km.count_kmers(reads, k).collect()} == want
    assert {x.kmer for x in km.read_sets(reads, k, "i").collect()} == set(want)


@pytest.mark.parametrize("k", [3, 11, 32])
def test_votes_as_positions(spark, k):
    rows = [(s, 100 + i % 3, 102 + i % 4 if i % 6 else None, 140 + i % 9) for i, (_, s) in enumerate(ODD_READS)]
    reads = spark.createDataFrame(rows, "seq string, unclipped_start int, aln_start int, aln_end int")
    want = {}
    for s, u, a, e in rows:
        for j, x in enumerate(pieces_brute(s, k)):
            left, right, most = max(0, (a or u) - u - j), max(0, u + j + k - 1 - e), int(0.3 * k) - 1
            pos = u + j if left <= most and right <= most else None
            want.setdefault(x, Counter())[pos] += 1
    assert {r.kmer: {p.pos: p.n for p in r.positions} for r in km.kmer_positions(reads, k).collect()} == want
    votes = {}
    for x, c in want.items():
        ranked = sorted((-n, p) for p, n in c.items() if p is not None)
        if ranked:
            votes[x] = (ranked[0][1], ranked[0][1] if len(ranked) < 2 or ranked[0][0] < 2 * ranked[1][0] else None)
    assert {r.kmer: (r.best, r.voted) for r in km.kmer_votes(reads, k).collect()} == votes


@pytest.mark.parametrize("k", [4, 11, 29, 31])
def test_votes_by_blocks_of_positions(spark, k, monkeypatch, small_batches):
    """Reads across blocks, positions below zero, hot k-mers and tasks that send on what they hold early; no k-mer is a row of a shuffle."""
    r = random.Random(k)
    genome = "".join(r.choice("ACGT") for _ in range(150))
    rows = []
    for i in range(60):
        a = r.randrange(120)
        at = r.choice([a - 70, a - 70, a + 300, a])
        rows.append((genome[a : a + r.randrange(3, 90)], at if i % 9 else None, at + r.randrange(5) if i % 4 else None, at + r.randrange(20, 90) if i % 3 else None))
    rows += [("A" * 80, 5, 5, 90)] * 3 + [("ACGNACGTTGCATTGCAACGTNN" * 3, 40, 41, 300), ("ACGNACGTTGCATTGCAACGTNN" * 3, 40, 40, None), (None, 1, 1, 9)]
    reads = spark.createDataFrame(rows, "seq string, unclipped_start int, aln_start int, aln_end int").repartition(3)
    want = {}
    for s, u, a, e in rows:
        for j, x in enumerate(pieces_brute(s, k)):
            most = int(0.3 * k) - 1
            if u is not None and (a or 0, u)[a is None] - u - j <= most and (e is None or u + j + k - 1 - e <= most):
                want.setdefault(x, Counter())[u + j] += 1
    votes = {}
    for x, c in want.items():
        ranked = sorted((-n, p) for p, n in c.items())
        votes[x] = (ranked[0][1], ranked[0][1] if len(ranked) < 2 or ranked[0][0] < 2 * ranked[1][0] else None)
    for slices, buckets, held in ((1 << 22, 1 << 18, 1 << 23), (60, 3, 20)):
        monkeypatch.setattr(km, "SLICE", slices)
        monkeypatch.setattr(km, "BUCKETS", buckets)
        monkeypatch.setattr(km, "HELD", held)
        found = km.kmer_votes(reads, k)
        assert "explode" not in found._jdf.queryExecution().toString()
        got = found.collect()
        assert len(got) == len(votes) and {q.kmer: (q.best, q.voted) for q in got} == votes


def test_best_of_parts():
    """Most votes, least place and next votes are the same from whole counts, by either way of sorting, and from parts."""
    r = np.random.default_rng(3)
    number, place = (x.ravel() for x in np.meshgrid(np.arange(40), np.arange(-30, 30), indexing="ij"))
    n = r.integers(1, 5, len(number))
    want = []
    for x in range(40):
        ranked = sorted((-v, p) for v, p in zip(n[number == x].tolist(), place[number == x].tolist()))
        want.append((x, -ranked[0][0], ranked[0][1], -ranked[1][0]))
    assert list(zip(*(x.tolist() for x in km._best(number, n, place)))) == want
    far = km._best(number << 55, n, place)
    assert list(zip((far[0] >> 55).tolist(), *(x.tolist() for x in far[1:]))) == want
    part = r.integers(0, 3, len(number))
    parts = [km._best(*(x[part == i] for x in (number, n, place))) for i in range(3)]
    assert list(zip(*(x.tolist() for x in km._best(*(np.concatenate(x) for x in zip(*parts)))))) == want


@pytest.mark.parametrize("k", [3, 14, 31])
def test_read_sets_as_records(spark, k, monkeypatch, small_batches):
    """Ids of any size, unknown ones and equal reads, with slices, buckets and shares of large ones so small that all are crossed."""
    r = random.Random(k)
    genome = "".join(r.choice("ACGT") for _ in range(200))
    ids = [None, 0, 5, 6, 300, 70_000, 1 << 40, -(1 << 63), (1 << 63) - 1, -7]
    rows = [(r.choice(ids), genome[a : a + r.randrange(1, 90)]) for a in (r.randrange(190) for _ in range(60))]
    rows += [(None, "T" * 45), (8, "A" * 70), (9, "A" * 70), (9, "ACGTNACGTACGTACGTTT"), (None, "NNNN"), (4, "NNNN"), (3, ""), (3, None)]
    want = {}
    for i, s in rows:
        for x in pieces_brute(s, k):
            want.setdefault(x, set()).update([] if i is None else [i])
    for slices, buckets in ((1 << 22, 1 << 18), (30, 2)):
        monkeypatch.setattr(km, "SLICE", slices)
        monkeypatch.setattr(km, "BUCKETS", buckets)
        for few in (rows, [x for x in rows if x[0] is None or 0 <= x[0] < 1 << 31]):
            kind = "long" if few is rows else "int"
            found = km.read_sets(spark.createDataFrame(few, f"i {kind}, seq string").repartition(3), k, "i")
            assert found.schema["reads"].dataType.elementType.simpleString() == {"long": "bigint", "int": "int"}[kind]
            assert "packed" not in found._jdf.queryExecution().toString()
            got = found.collect()
            if few is rows:
                assert len(got) == len(want) and {q.kmer: q.reads for q in got} == {x: sorted(y) for x, y in want.items()}
            else:
                assert all(set(q.reads) == {i for i, s in few if i is not None and q.kmer in pieces_brute(s, k)} for q in got)


def test_numbers_are_exact(spark):
    texts = ["", "A", "AA", "C", "T" * 31, "ACGT" * 7, "N", "ACGTN", "T" * 32]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in texts], "x string").select(km.number_of(F.col("x"))).collect()]
    assert got[:6] == [int("1" + "".join(str("ACGT".index(c)) for c in x), 4) for x in texts[:6]]
    assert all(x < 0 for x in got[6:]) and len(set(got)) == len(got)


def chains_brute(pairs):
    out, into = {}, {}
    for a, b in set(pairs):
        out.setdefault(a, []).append(b)
        into.setdefault(b, []).append(a)
    follows = {a: b[0] for a, b in out.items() if len(b) == 1 and len(into[b[0]]) == 1}
    reached, made = set(follows.values()), []
    for v in set(out) | set(into):
        if v not in reached:
            seq = v
            while v in follows:
                v = follows[v]
                seq += v[-1]
            made.append(seq)
    return sorted(made)


def test_contigs_of_branching_and_circular_graphs(spark):
    r = random.Random(8)
    genome = "".join(r.choice("ACGT") for _ in range(400))
    texts = [genome, genome[:100] + "ACGT" + genome[130:300], genome[200:260] + genome[:40], "ACGTTGCA" * 9, "A" * 30]
    e = km.de_bruijn(spark.createDataFrame([(t,) for t in texts], "seq string"), 11)
    want = chains_brute([(t[i : i + 11], t[i + 1 : i + 12]) for t in texts for i in range(len(t) - 11)])
    assert len(want) >= 5 and sorted(x.seq for x in km.contigs(e).collect()) == want
    chunks = {}
    for x in km.contig_chunks(e, 7).orderBy("head", "chunk").collect():
        assert len(x.bases) <= 7 + 10
        chunks[x.head] = chunks.get(x.head, "") + x.bases
    assert sorted(chunks.values()) == want


def test_contigs_of_reads(spark, monkeypatch):
    r = random.Random(9)
    genome = "".join(r.choice("ACGT") for _ in range(600))
    short = [genome[i : i + r.randrange(12, 60)] for i in (r.randrange(560) for _ in range(60))]
    odd = [genome[:100] + "ACGT" + genome[130:300], genome[200:260] + genome[:40], "ACGTTGCA" * 9, "A" * 30, "A" * 25 + "C" + "A" * 20, "", "ACG", None]
    # One vertex that begins a chain in one read and ends it in another: C and G before it, A and T behind the next.
    x = "".join(r.choice("ACGT") for _ in range(11))
    alone = ["C" + x, "C" + x[:10] + "A", x + "G", "T" + x[1:] + "G"]
    many = ["".join(r.choice("AC") for _ in range(r.randrange(8, 40))) for _ in range(80)]
    for texts in (short, [*short, *odd, genome], odd, alone, many, [*odd, "ACGTNACGTACGTACGTACG"]):
        monkeypatch.setattr(km, "BUCKETS", 3 if texts is many else 1 << 18)
        got = sorted(q.seq for q in km.read_contigs(spark.createDataFrame([(t,) for t in texts], "seq string").repartition(3), 11).collect())
        assert got == chains_brute([(t[i : i + 11], t[i + 1 : i + 12]) for t in texts if t for i in range(len(t) - 11)])


def test_contigs_of_reads_write_no_graph_in_rounds(spark, monkeypatch):
    """Reads whose chains are held whole need no rounds of pointer jumping, whatever the graph's size."""
    monkeypatch.setattr(km, "longest_runs", lambda edges: pytest.fail("the graph was walked"))
    r = random.Random(10)
    texts = ["".join(r.choice("ACGT") for _ in range(300)) for _ in range(20)] * 2
    assert sorted(q.seq for q in km.read_contigs(spark.createDataFrame([(t,) for t in texts], "seq string"), 25).collect()) == sorted(set(texts))


def test_contigs_of_reads_in_slices(spark, monkeypatch):
    """Slices, buckets and texts so small that reads, stretches and large buckets cross them; equal to the plain graph's chains."""
    r = random.Random(12)
    genome = "".join(r.choice("ACGT") for _ in range(300))
    texts = [genome[i : i + r.randrange(20, 120)] for i in (r.randrange(280) for _ in range(40))] + ["ACGTTGCA" * 9, "A" * 90, genome, genome] + ["".join(r.choice("AC") for _ in range(60)) for _ in range(9)]
    reads = spark.createDataFrame([(t,) for t in texts], "seq string").repartition(2)
    for slices, buckets, longest in ((1 << 22, 1 << 18, 1 << 24), (200, 3, 16), (900, 1 << 18, 40)):
        monkeypatch.setattr(km, "SLICE", slices)
        monkeypatch.setattr(km, "BUCKETS", buckets)
        monkeypatch.setattr(km, "LONGEST", longest)
        for k in (4, 11, 28, 31) if slices == 200 else (12, 31) if slices < 1000 else (25,):
            got = sorted(q.seq for q in km.read_contigs(reads, k).collect())
            assert got == chains_brute([(t[i : i + k], t[i + 1 : i + k + 1]) for t in texts for i in range(len(t) - k)])


def test_vertices_travel_in_few_rows(spark):
    """A slice's stretches are one row a bucket, which is a small part of the k-mers' number, in under two bytes a k-mer."""
    r = random.Random(13)
    codes = np.array([r.randrange(4) for _ in range(50_000)], np.uint8)
    least = km._minimizers(codes, 25, 9)
    place, size = km._runs(np.ones(len(least), bool), least, 17)
    assert size.sum() == len(least) and (place[1:] == place[:-1] + size[:-1]).all() and size.max() <= 17
    key, blobs = km._dealt(least[place], np.zeros((len(place), 15), np.uint8))
    assert len(key) == len(set(key.tolist())) <= 1 << km.BUCKET_BITS and 15 * len(place) < 2 * len(least)
    assert len(km._records(pa.chunked_array([blobs[:7], blobs[7:]]), 15)[0]) == len(place)


def test_whole_keys():
    """Every row once and in order, no key in two tables, and no table of more than the least beyond one key."""
    r = random.Random(5)
    keys = sorted(r.randrange(30) for _ in range(400))
    rows = pa.table({"key": keys, "bits": pa.array([None if i % 7 == 0 else b"x" * r.randrange(9) for i in range(400)], pa.binary())})
    for least in (1, 50, 10_000):
        for size in (1, 7, 400):
            made = [t.column("key").to_pylist() for t in km._whole_keys(rows.to_batches(size), "bits", least)]
            assert sum(made, []) == keys and all(a[-1] < b[0] for a, b in zip(made, made[1:]))
            assert all(len(set(x)) <= 1 or 4 * len([y for y in x if y != x[-1]]) <= least for x in made)


def test_positions(spark):
    reads = spark.createDataFrame([("AACCGGTT", 10, 17, 10), ("AACCGGTT", 12, 17, 10)], "seq string, aln_start int, aln_end int, unclipped_start int")
    got = {r.kmer: [(p.pos, p.n) for p in r.positions] for r in km.kmer_positions(reads, 4, 0.5).collect()}
    assert got["AACC"] == [(None, 1), (10, 1)] and got["ACCG"] == [(11, 2)]
    one = spark.createDataFrame([([(5, 9), (7, 4)],), ([(5, 8), (7, 4)],), ([(None, 9), (7, 4)],), ([(None, 1)],)], "p array<struct<pos:int,n:int>>")
    assert [r[0] for r in one.select(km.position_of(F.col("p"))).collect()] == [5, None, 7, None]
    paths = spark.createDataFrame([([1, 2, 3, 9, 5, 6, 7],), ([1, 2, 4, 5, 6],), ([1, 2],), ([None, 2, 3, 4],)], "p array<int>")
    assert [r[0] for r in paths.select(km.anchored(F.col("p"))).collect()] == [True, False, False, False]
    assert [r[0] for r in paths.select(km.is_increasing(F.col("p"))).collect()] == [False, True, True, True]
    bases = spark.createDataFrame([(12, 10, 14, 6)], "s int, u int, e int, n int").select(km.base_positions(F.col("s"), F.col("u"), F.col("e"), F.col("n"))).first()[0]
    assert bases == [None, None, 12, 13, 14, None]


def test_reassembly(spark):
    r = random.Random(3)
    genome = "".join(r.choice("ACGT") for _ in range(36))
    rows = [(f"q{i}", "c", 1 + s, s + 24, 1 + s, 60, genome[s : s + 24]) for i, s in enumerate([*range(0, 13, 3)] * 5)]
    reads = spark.createDataFrame(rows, "qname string, contig string, aln_start int, aln_end int, unclipped_start int, mapq int, seq string")
    parameters = ra.Parameters(k=15)
    found = spark.createDataFrame(ra.haplotypes(reads, "c", 1, 36, parameters, deepest=50).collect(), "seq string, pos int, stop int, mean_weight double")
    assert [(x.seq, x.pos, x.stop) for x in found.collect()] == [(genome, 1, 36)]
    assert [(x.seq, x.pos, x.stop) for x in ra.best_contig(reads, "c", 1, 36, parameters).collect()] == [(genome, 1, 36)]
    out = ra.as_reads(found, spark.createDataFrame([("c", genome)], "name string, seq string"), "c").collect()
    assert [(x.cigar, x.mapq, x.aln_start) for x in out] == [("36M", 60, 1)]


def test_levels_of_many_edges_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(gr, "BROADCAST", 3)
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("b", "d"), ("d", "b")])
    paths = gr.simple_paths(gr.vertices_of(e), e)
    assert "strategy=merge" in paths._jdf.queryExecution().toString()
    assert {tuple(r.path) for r in paths.collect()} == {("a", "b", "c", "d"), ("a", "b", "d")}
