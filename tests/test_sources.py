from __future__ import annotations

import gzip
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

from tidemark import cli
from tidemark.operators import reads as rd
from tidemark.sources import bam as bm
from tidemark.sources import bed, fasta, sam
from tidemark.sources.text import path_exists, read_lines

SAM = "\n".join([
    "@HD\tVN:1.6", "@SQ\tSN:chr1\tLN:1000", "@SQ\tSN:chrUn\tLN:50", "@SQ\tSN:X\tLN:70",
    "r1\t99\tchr1\t11\t60\t2S8M\t=\t101\t100\tACGTACGTAC\t*\tNM:i:2\tXX:Z:a",
    "r1\t147\tchr1\t101\t60\t4M2D4M3H\t=\t11\t-100\tACGTACGT\t*",
    "r2\t4\t*\t0\t0\t*\t*\t0\t0\tAC\t*",
]) + "\n"


def block(data):
    body = zlib.compressobj(6, zlib.DEFLATED, -15)
    raw = body.compress(data) + body.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(raw) + 25) + raw + struct.pack("<II", zlib.crc32(data), len(data))


def bam_data():
    head = SAM[: SAM.index("r1")].encode()
    out = b"BAM\1" + struct.pack("<i", len(head)) + head + struct.pack("<i", 3)
    for name, size in ((b"chr1", 1000), (b"chrUn", 50), (b"X", 70)):
        out += struct.pack("<i", len(name) + 1) + name + b"\0" + struct.pack("<i", size)

    def record(name, flag, ref, pos, mapq, ops, mate, mate_pos, tlen, seq, tags=b""):
        packed = bytes("=ACMGRSVTWYHKDBN".index(a) << 4 | "=ACMGRSVTWYHKDBN".index(b) for a, b in zip(seq[::2], seq[1::2] + ("=" if len(seq) % 2 else "")))
        body = struct.pack("<iiBBHHHiiii", ref, pos - 1, len(name) + 1, mapq, 0, len(ops), flag, len(seq), mate, mate_pos - 1, tlen) + name.encode() + b"\0"
        body += b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(o)) for n, o in ops) + packed + b"\xff" * len(seq) + tags
        return struct.pack("<i", len(body)) + body

    out += record("r1", 99, 0, 11, 60, [(2, "S"), (8, "M")], 0, 101, 100, "ACGTACGTAC", b"XXZa\0NMC\x02")
    out += record("r1", 147, 0, 101, 60, [(4, "M"), (2, "D"), (4, "M"), (3, "H")], 0, 11, -100, "ACGTACGT")
    out += record("r2", 4, -1, 0, 0, [], -1, 0, 0, "AC")
    return out


def bam():
    out = bam_data()
    return block(out[:100]) + block(out[100:]) + block(b"")


def test_lines_plain_and_gzip(spark, tmp_path):
    for name, opener in (("a.txt", open), ("b.gz", gzip.open), ("c.gzip", gzip.open)):
        with opener(tmp_path / name, "wt") as f:
            f.write("one\ntwo\nthree\n")
        if name == "c.gzip":
            continue
        assert [r.value for r in read_lines(spark, str(tmp_path / name), ordered=True).orderBy("ord").collect()] == ["one", "two", "three"]


def test_sam(spark, tmp_path):
    (tmp_path / "x.sam").write_text(SAM)
    path = str(tmp_path / "x.sam")
    a, b, c = sam.read_sam(spark, path).orderBy("file_ord").collect()
    assert (a.aln_start, a.aln_end, a.unclipped_start, a.unclipped_end, a.nm, a.n_cigar, a.is_clipped, a.mate_contig, a.is_reverse, a.mate_reverse) == (11, 18, 9, 18, 2, 2, True, "chr1", False, True)
    assert (b.aln_end, b.unclipped_end, b.ref_len, b.nm, b.is_reverse) == (110, 113, 10, None, True)
    assert c.unmapped and not a.unmapped and a.proper_pair
    assert sorted(map(tuple, rd.main_contigs(sam.header_contigs(spark, path)).collect())) == [("X", 70), ("chr1", 1000)]
    reads = sam.read_sam(spark, path)
    assert reads.where(~F.col("unmapped")).select(rd.orientation()).distinct().collect()[0][0] == "FR"
    sam.write_sam(reads, str(tmp_path / "out"), [("chr1", 1000)])
    columns = [x for x in reads.columns if x != "file_ord"]
    assert sorted(map(str, sam.read_sam(spark, str(tmp_path / "out")).select(columns).collect())) == sorted(map(str, reads.select(columns).collect()))


def test_bam_as_sam(spark, tmp_path):
    (tmp_path / "x.sam").write_text(SAM)
    (tmp_path / "x.bam").write_bytes(bam())
    columns = [c for c in sam.read_sam(spark, str(tmp_path / "x.sam")).columns if c not in ("file_ord", "mate_start", "aln_start", "aln_end", "unclipped_start", "unclipped_end")]
    want = [str(r) for r in sam.read_sam(spark, str(tmp_path / "x.sam")).orderBy("file_ord").select(columns).collect()]
    assert [str(r) for r in bm.read_bam(spark, str(tmp_path / "x.bam")).orderBy("file_ord").select(columns).collect()] == want
    spark.dataSource.register(bm.BamSource)
    raw = spark.read.format("bam").load(str(tmp_path / "x.bam")).orderBy("file_ord").collect()
    assert [(r.qname, r.flag, r.cigar, r.nm) for r in raw] == [("r1", 99, "2S8M", 2), ("r1", 147, "4M2D4M3H", None), ("r2", 4, "*", None)]


def test_bed(spark, tmp_path):
    (tmp_path / "x.bed").write_text("# c\ntrack name=x\nchr1\t0\t5\t7\nchr1\t5\t9\t-2\nchr1\t0\t3\t8\n")
    path = str(tmp_path / "x.bed")
    rows = bed.read_bed(spark, path)
    assert sorted(map(tuple, rows.collect())) == [("chr1", 0, 3, 8), ("chr1", 0, 5, 7), ("chr1", 5, 9, -2)]
    (tmp_path / "y.bed").write_text("chr1 0\t5  1.5\n")
    assert [tuple(r) for r in bed.read_bed(spark, str(tmp_path / "y.bed"), "double").collect()] == [("chr1", 0, 5, 1.5)]
    (tmp_path / "z.bed").write_text("chr1\t0\t5\ta b\tc\n")
    assert [r.value for r in bed.read_bed(spark, str(tmp_path / "z.bed"), "string").collect()] == ["a b\tc"]
    (tmp_path / "m.bed").write_text("# c\nchr1\t0\t5\t7\nchr1\t5\t9\t-2\nchr1\t0\t3\t8\nchr2\t0\t3\t8\n")
    assert sorted(map(tuple, bed.count_map(spark, str(tmp_path / "m.bed"), "chr1").collect())) == [("chr1", 0, 8), ("chr1", 5, -2)]
    bed.write_bedgraph(rows, str(tmp_path / "g"), "my name", "what it is")
    bed.append_bedgraph(rows, str(tmp_path / "g"))
    assert bed.read_bed(spark, str(tmp_path / "g")).count() == 6
    head = [r.value for r in spark.read.text(str(tmp_path / "g")).where(F.col("value").startswith("track")).collect()]
    assert head == ["track type=bedGraph name=my_name description=what_it_is"]


def test_fasta(spark, tmp_path):
    (tmp_path / "x.fa").write_text("TT\n>chr1 first\r\nACGT\r\n\nAC\n>none\n>chr2\nGG\n")
    rows = fasta.read_fasta(spark, str(tmp_path / "x.fa"))
    assert sorted(((r.name, r.chunk, r.bases) for r in rows.collect()), key=repr) == sorted([("chr1 first", 0, "ACGTAC"), ("chr2", 0, "GG"), (None, 0, "TT")], key=repr)
    assert fasta.base_slice(rows, "chr1", 3, 5).first().seq == "GTA"
    (tmp_path / "e.fa").write_text("")
    assert fasta.read_fasta(spark, str(tmp_path / "e.fa")).collect() == []


def test_fasta_in_chunks_across_splits(spark, tmp_path):
    """Contigs far larger than a split and than a chunk; every split but the first begins within a record."""
    r = random.Random(4)
    whole = {name: "".join(r.choice("ACGTN") for _ in range(n)) for name, n in [("a", 60_000), ("b", 1), ("c x", 24_576), ("d", 9000)]}
    text = "".join(f">{name}\n" + "\n".join(seq[i : i + 61] for i in range(0, len(seq), 61)) + "\n" for name, seq in whole.items())
    (tmp_path / "x.fa").write_text(text + ">d\n" + "T" * 5000 + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        for size in (4096, 1000):
            rows = fasta.read_fasta(spark, str(tmp_path / "x.fa"), size)
            got = {}
            for x in rows.orderBy("record", "chunk").collect():
                assert len(x.bases) <= size and len(got.get((x.name, x.record.number), "")) == x.chunk * size
                got[x.name, x.record.number] = got.get((x.name, x.record.number), "") + x.bases
            assert got == {("a", 1): whole["a"], ("b", 2): whole["b"], ("c x", 3): whole["c x"], ("d", 4): whole["d"], ("d", 5): "T" * 5000}
            asked = [("a", 1, 60_000, 1), ("a", 990, 9001, 2), ("c", 4096, 4097, 3), ("a", 59_999, 70_000, 4), ("b", 2, 9, 5), ("zz", 1, 5, 6), ("a", -5, 3, 7), ("a", 5, 4, 8)]
            ranges = spark.createDataFrame(asked, "contig string, start long, stop long, tag int")
            found = fasta.slices(rows, ranges, size).collect()
            assert {x.tag: x.bases for x in found} == {1: whole["a"], 2: whole["a"][989:9001], 3: whole["c x"][4095:4097], 4: whole["a"][59_998:], 7: whole["a"][:3]}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "x.sam").write_text(SAM)
    assert cli.main(["version"]) == 0
    cli.main(["regions", "-i", str(tmp_path / "x.sam")])
    assert capsys.readouterr().out.split("\n")[1:3] == ["chr1\t1000", "X\t70"]
    cli.main(["signal", "extract", "-i", str(tmp_path / "x.sam"), "-o", str(tmp_path / "o"), "--bedgraph"])
    signals = spark.read.parquet(str(tmp_path / "o/signals"))
    assert signals.where("signal = 'Coverage' AND value = 1").count() == 2
    assert bed.read_bed(spark, str(tmp_path / "o/Coverage.bedgraph")).count() == signals.where("signal = 'Coverage'").count()
    cli.main(["vcf", "generate", "-i", str(tmp_path / "x.sam"), "-s", str(tmp_path / "o/signals"), "-o", str(tmp_path / "v"), "--caller", "no_coverage"])
    assert spark.read.text(str(tmp_path / "v/no_coverage.vcf")).where(~F.col("value").startswith("#")).count() >= 1
    cli.main(["vcf", "re-identify", "-i", str(tmp_path / "v/no_coverage.vcf"), "-o", str(tmp_path / "r"), "-p", "id_"])
    assert spark.read.text(str(tmp_path / "r")).where(F.col("value").contains("\tid_0\t")).count() == 1
    assert cli.check_regions(["chr1", "chr9"], ["chr1", "X"]) == (["chr1"], ["chr9"])


def test_regions_paths_and_warnings(spark, tmp_path):
    (tmp_path / "x.sam").write_text(SAM)
    path = str(tmp_path / "x.sam")
    assert path_exists(spark, path) and not path_exists(spark, path + "x")
    cli.main(["extract-region", "-i", path, "-o", str(tmp_path / "part"), "-r", "chr1:1-50"])
    assert [(r.qname, r.aln_start) for r in sam.read_sam(spark, str(tmp_path / "part")).collect()] == [("r1", 11)]
    cli.main(["extract-region", "-i", path, "-o", str(tmp_path / "whole"), "-r", "chr1"])
    assert sam.read_sam(spark, str(tmp_path / "whole")).count() == 2
    with pytest.raises(SystemExit, match="no such contig"):
        cli.main(["extract-region", "-i", path, "-o", str(tmp_path / "none"), "-r", "chr7"])
    bed.write_warnings(spark.createDataFrame([("chr1", 5, 9)], "contig string, start long, stop long"), str(tmp_path / "w"))
    assert [r.value for r in spark.read.text(str(tmp_path / "w")).collect()] == ["chr1\t5\t9\tlow¬coverage"]


def many_reads(spark, n=4000, seed=3):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        size = r.choice([0, 1, 35, 150, 151])
        seq = "".join(r.choice("ACGTN") for _ in range(size)) or "*"
        qual = "".join(chr(33 + r.randrange(60)) for _ in range(size)) if size and r.random() < 0.8 else "*"
        contig = r.choice(["chr1", "chr1", "chr2", "*"])
        start = 0 if contig == "*" else r.randrange(1, 3_000_000)
        cigar = "*" if contig == "*" or not size else r.choice([f"{size}M", f"{size}M200000N5M", f"3S{size}M2D"])
        rows.append((i, f"read{i}", r.randrange(4096), contig, start, r.randrange(61), cigar, r.choice(["chr1", "chr2", "*"]), r.randrange(9000), r.randrange(-500, 500), seq, qual, r.choice([None, 0, 7])))
    return spark.createDataFrame(rows, sam.RAW)


CONTIGS = [("chr1", 3_500_000), ("chr2", 3_500_000), ("chr3", 10)]


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("bam")
    reads = many_reads(spark)
    bm.write_bam(reads, str(folder / "out"), CONTIGS, files=3)
    return str(folder / "out"), sorted((tuple(r)[1:] for r in reads.collect()), key=repr)


def test_bam_round_trip_by_any_split(spark, written):
    path, want = written
    whole = bm.read_bam(spark, path).select(*bm.COLUMNS).orderBy("file_ord").collect()
    assert sorted((tuple(r)[1:] for r in whole), key=repr) == want
    files = bm.bam_files(path)
    assert len(files) == 3 and len({r.file_ord for r in whole}) == len(want)
    # In file order: sorted, rows without a contig last.
    place = [({"chr1": 0, "chr2": 1}.get(r.contig, 2), r.aln_start) for r in whole]
    assert place == sorted(place)
    for split in (7_000, 40_000, 100_003):
        df = bm.read_bam(spark, path, split_bytes=split)
        assert df.rdd.getNumPartitions() == sum(-(-size // split) for _, size in files)
        assert df.select(*bm.COLUMNS).orderBy("file_ord").collect() == whole


def test_bam_records_larger_than_splits(spark, tmp_path):
    r = random.Random(5)
    rows = [(i, f"r{i}", 0, "chr1", i + 1, 9, f"{n}M", "*", 0, 0, "".join(r.choice("ACGT") for _ in range(n)), "".join(chr(33 + r.randrange(90)) for _ in range(n)), None) for i, n in enumerate([10, 400_000, 20, 300_000, 5])]
    bm.write_bam(spark.createDataFrame(rows, sam.RAW), str(tmp_path / "o"), CONTIGS, files=1)
    got = bm.read_bam(spark, str(tmp_path / "o"), split_bytes=30_000).select(*bm.COLUMNS).orderBy("file_ord").collect()
    assert [tuple(x)[1:] for x in got] == [x[1:] for x in rows]


@pytest.mark.parametrize("region", [("chr1", 1, 10), ("chr1", 1_000_000, 1_001_000), ("chr2", 16_384, 16_385), ("chr2", 2_999_000, 4_000_000), ("chr3", 1, 10), ("chr1", None, None), ("chr9", 1, 5)])
def test_bam_regions(spark, written, region):
    path, _ = written
    contig, low, high = region[0], region[1] or 1, region[2] or 1 << 31
    want = bm.read_bam(spark, path).where((F.col("contig") == contig) & (F.col("aln_start") <= high) & (F.col("aln_end") >= low)).select(*bm.COLUMNS).orderBy("file_ord").collect()
    for split in (bm.SPLIT_BYTES, 9_000):
        assert bm.read_bam(spark, path, *region, split_bytes=split).select(*bm.COLUMNS).orderBy("file_ord").collect() == want
    assert want or region not in (("chr1", 1_000_000, 1_001_000), ("chr1", None, None), ("chr2", 2_999_000, 4_000_000))


def bytes_read(options, filters=()):
    reader, total, rows = bm.PushingReader(options), 0, 0
    list(reader.pushFilters(list(filters)))
    for part in reader.partitions():
        if part.path:
            blocks = bm.Blocks(part.path)
            rows += sum(1 for _ in bm.records(blocks, part))
            total += blocks.bytes_read
    return total, rows


def test_bam_index_bounds_what_is_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bm.Blocks, "FETCH", 1 << 12)
    r = random.Random(9)
    seqs = ["".join(r.choice("ACGT") for _ in range(200)) for _ in range(50)]
    rows = [(i, f"r{i}", 0, "chr1", 1 + i * 100, 9, "200M", "*", 0, 0, r.choice(seqs), "".join(chr(33 + r.randrange(60)) for _ in range(200)), 1) for i in range(20_000)]
    path = str(tmp_path / "o")
    bm.write_bam(spark.createDataFrame(rows, sam.RAW).repartition(4), path, CONTIGS, files=1)
    size = bm.bam_files(path)[0][1]
    assert size > 2_000_000
    total, n = bytes_read({"path": path, "contig": "chr1", "start": "1000000", "stop": "1000500"})
    assert n == sum(1 for x in rows if x[4] <= 1_000_500 and x[4] + 199 >= 1_000_000) and total < size / 10
    pushed, n = bytes_read({"path": path}, [EqualTo(("contig",), "chr1"), GreaterThanOrEqual(("aln_start",), 1_000_000), LessThan(("aln_start",), 1_000_500)])
    assert n >= 5 and pushed < size / 10
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = bm.read_bam(spark, path).where("contig = 'chr1' AND aln_start >= 1000000 AND aln_start < 1000500")
        assert got.count() == 5 and got.rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_bam_odd_files(spark, tmp_path):
    (tmp_path / "x.bam").write_bytes(bam())
    assert bm.bam_contigs(str(tmp_path / "x.bam")) == [("chr1", 1000), ("chrUn", 50), ("X", 70)]
    assert bm.read_bam(spark, str(tmp_path / "x.bam"), "chr1", 105, 200).count() == 1  # no index: read whole
    (tmp_path / "cut.bam").write_bytes(block(bam_data()[:-9]) + block(b""))
    with pytest.raises(Exception, match="ends within a record"):
        bm.read_bam(spark, str(tmp_path / "cut.bam")).collect()
    empty = spark.createDataFrame([], sam.RAW)
    bm.write_bam(empty, str(tmp_path / "none"), CONTIGS)
    assert bm.read_bam(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="there already"):
        bm.write_bam(empty, str(tmp_path / "none"), CONTIGS)
    bm.write_bam(many_reads(spark, 10), str(tmp_path / "none"), CONTIGS, overwrite=True)
    assert bm.read_bam(spark, str(tmp_path / "none")).count() == 10


def test_extract_region_from_bam_to_bam(spark, written, tmp_path):
    path, _ = written
    one = bm.bam_files(path)[0][0]
    cli.main(["extract-region", "-i", one, "-o", str(tmp_path / "r"), "-r", "chr1:500000-600000", "--bam", "--files", "1"])
    want = bm.read_bam(spark, one, "chr1", 500_000, 600_000)
    got = bm.read_bam(spark, str(tmp_path / "r"))
    columns = [c for c in bm.COLUMNS if c != "file_ord"]
    assert want.count() > 3 and sorted(map(repr, got.select(columns).collect())) == sorted(map(repr, want.select(columns).collect()))
