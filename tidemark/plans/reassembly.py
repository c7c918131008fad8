"""Local reassembly: reads of a region to haplotypes along a De Bruijn graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.align import align_cigar
from ..operators.graph import prune_edges, prune_vertices, simple_paths, thread_threshold, vertices_of
from ..operators.kmers import anchored, contigs, de_bruijn, kmer_positions, kmers, map_sequence, path_sequence, position_of
from ..operators.reads import on_region
from ..sources.fasta import as_chunks, slices
from ..tables import cut


@dataclass(frozen=True)
class Parameters:
    k: int = 51
    mapq: int = 60
    quality: str = "*"
    prune_until: int = 30
    prune_less_than: int = 4
    haplotypes: int = 4


def region_reads(reads: DataFrame, contig: str, start: int, stop: int, least_mapq: int = 0, mates: bool = False) -> DataFrame:
    """Reads that overlap the region, of ``least_mapq`` at least; with ``mates`` also their mates, wherever they lie."""
    here = on_region(reads, contig, start, stop).where(F.col("mapq") >= least_mapq)
    if not mates:
        return here
    return here.unionByName(reads.join(here.select("qname").distinct(), "qname", "left_semi").select(*reads.columns)).distinct()


def haplotypes(reads: DataFrame, contig: str, start: int, stop: int, parameters: Parameters = Parameters(), deepest: int | None = None) -> DataFrame:
    """seq, pos, stop, mean_weight of anchored simple paths of more k-mers than a quarter of the region's positions: the ``haplotypes`` lightest of them, by sequence if equal.

    The graph is of the region's reads, without their mates. Edges under ``prune_less_than`` go, and k-mers that only reads of
    mapping quality 0 hold. pos and stop are the places of the first k-mer's first and the last k-mer's last base; of the
    lightest paths, those that don't begin before their stop are left out. With ``deepest``, a path of more k-mers than
    that is an error.
    """
    p = parameters
    local = region_reads(reads, contig, start, stop)
    edges = cut(de_bruijn(local, p.k))
    vertices, edges = prune_edges(vertices_of(edges), edges, F.col("weight") < p.prune_less_than)
    trusted = kmers(local.where("mapq > 0").select("seq"), p.k).select(F.col("kmer").alias("id")).distinct()
    vertices, edges = prune_vertices(vertices, edges, vertices.join(trusted, "id", "left_anti"))
    vertices, edges = cut(vertices), cut(edges)
    paths = cut(simple_paths(vertices, edges, deepest=deepest).withColumn("pid", F.xxhash64("path")))
    steps = paths.select("pid", F.posexplode("path").alias("i", "kmer"))
    places = kmer_positions(local, p.k).select("kmer", position_of(F.col("positions")).alias("pos"))
    placed = steps.join(places, "kmer", "left").groupBy("pid").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "pos"))), lambda x: x["pos"]).alias("positions"))
    links = paths.select("pid", F.explode(F.zip_with(F.slice("path", 1, F.size("path") - 1), F.slice("path", 2, F.size("path")), lambda a, b: F.struct(a.alias("src"), b.alias("dst")))).alias("e")).select("pid", "e.src", "e.dst")
    weights = links.join(edges, ["src", "dst"]).groupBy("pid").agg(F.avg("weight").alias("mean_weight"))
    rows = paths.join(placed, "pid").join(weights, "pid").where(anchored(F.col("positions")))
    rows = rows.where(F.size("path") > (stop - start) // 2 // 2)
    last = F.element_at("positions", -1) + (p.k - 1)
    rows = rows.select(path_sequence(F.col("path")).alias("seq"), F.col("positions")[0].alias("pos"), last.alias("stop"), "mean_weight")
    return rows.orderBy("mean_weight", "seq").limit(p.haplotypes).where("pos < stop")


def best_contig(reads: DataFrame, contig: str, start: int, stop: int, parameters: Parameters = Parameters()) -> DataFrame:
    """seq, pos, stop of the longest contig after pruning to single threads, from its first k-mer's place to its last one's end.

    All reads of the region make the graph; those of mapping quality 0 don't vote for places. No row if the first or the
    last k-mer has no known place, or if no threshold up to ``prune_until`` leaves single threads.
    """
    p = parameters
    local = region_reads(reads, contig, start, stop)
    edges = cut(de_bruijn(local, p.k))
    threshold = thread_threshold(edges, p.prune_until)
    kept = edges.join(F.broadcast(threshold), F.col("weight") > F.col("threshold")).select("src", "dst", "weight")  # one row
    longest = contigs(kept).agg(F.max(F.struct(F.length("seq").alias("n"), "seq")).alias("m")).select("m.seq").where("seq IS NOT NULL")
    mapped = map_sequence(longest, kmer_positions(local.where("mapq <> 0"), p.k), p.k).where((F.col("idx") == 0) | (F.col("idx") == F.length("seq") - p.k))
    ends = mapped.groupBy("seq").agg(F.max(F.when(F.col("idx") == 0, F.col("pos"))).alias("pos"), (F.max(F.when(F.col("idx") == F.length("seq") - p.k, F.col("pos"))) + (p.k - 1)).alias("stop"))
    return ends.where("pos IS NOT NULL AND stop IS NOT NULL")


def as_reads(found: DataFrame, fasta: DataFrame, contig: str, parameters: Parameters = Parameters(), record: str | None = None) -> DataFrame:
    """SAM-like rows of sequences (seq, pos, stop; as few as ``haplotypes`` gives), each aligned to its own slice of the reference.

    The slice is bases pos to stop of the FASTA record (chunks, or name and seq) whose name's first word is ``record``: the contig without
    "chr", unless given. Names hold the place and a hash of the sequence. Without such a record there are no rows.
    """
    chunks = fasta if "chunk" in fasta.columns else as_chunks(fasta)
    both = slices(chunks, found.select(F.lit(record or contig.replace("chr", "")).alias("contig"), F.col("pos").alias("start"), "stop", "seq", "pos"))
    place = F.concat(F.lit(f"Haplotype_{contig}:"), F.col("pos").cast("string"), F.lit("-"), F.col("stop").cast("string"), F.lit("_"), F.hex(F.xxhash64("seq")))
    return both.select(place.alias("qname"), F.lit(0).alias("flag"), F.lit(contig).alias("contig"), F.col("pos").cast("long").alias("aln_start"), F.lit(parameters.mapq).alias("mapq"), align_cigar(F.col("seq"), F.col("bases")).alias("cigar"), "seq", F.lit(parameters.quality).alias("qual"))


def region_records(reads: DataFrame, fasta: DataFrame, contig: str, start: int, stop: int, parameters: Parameters = Parameters()) -> DataFrame:
    """SAM-like rows of a region's haplotypes, aligned to the reference."""
    return as_reads(cut(haplotypes(reads, contig, start, stop, parameters), "haplotypes"), fasta, contig, parameters)
