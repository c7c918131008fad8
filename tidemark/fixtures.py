"""Deterministic stand-ins for reads, variants, sequences and edges, projected from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day(x: str) -> Column:
    return F.datediff(F.col(x), F.lit("1992-01-01").cast("date")).cast("long")


#: Insert sizes beyond which the stand-in's pairs count as close or far, and its largest clipped reference length, exclusive.
LEAST, MOST, CLIP = 100, 700, 25


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of 24 contigs (one for each supplier modulo 24) at ship days, as long as quantities."""
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate")
    reverse = F.col("l_linestatus") == "O"
    contig = F.concat(F.lit("chr"), (1 + F.col("l_suppkey") % 24).cast("string"))
    size = F.floor(F.col("l_extendedprice") / 100).cast("long")
    return x.select(
        F.col("l_orderkey").alias("qname"),
        F.col("l_linenumber").alias("file_ord"),
        contig.alias("contig"),
        day("l_shipdate").alias("aln_start"),
        (day("l_shipdate") + F.col("l_quantity").cast("long")).alias("aln_end"),
        (F.col("l_quantity").cast("long") + 1).alias("ref_len"),
        F.when(F.col("l_linenumber") == 7, 0).otherwise(10 * F.col("l_linenumber")).alias("mapq"),
        F.round(100 * F.col("l_discount")).cast("long").alias("nm"),
        reverse.alias("is_reverse"),
        (reverse == (F.col("l_partkey") % 5 == 0)).alias("mate_reverse"),
        F.lit(False).alias("unmapped"),
        (F.col("l_partkey") % 97 == 0).alias("mate_unmapped"),
        F.when(F.col("l_partkey") % 10 == 0, F.concat(F.lit("chr"), (1 + F.col("l_partkey") % 24).cast("string"))).otherwise(contig).alias("mate_contig"),
        (day("l_shipdate") + F.col("l_partkey") % 200).alias("mate_start"),
        (F.col("l_returnflag") == "R").alias("is_clipped"),
        (1 + F.col("l_linenumber") % 4).alias("n_cigar"),
        F.when(reverse, -size).otherwise(size).alias("tlen"),
    )


READS_SQL = """
SELECT l_orderkey AS qname, l_linenumber AS file_ord, 'chr' || (1 + l_suppkey % 24) AS contig,
  date_diff('day', TIMESTAMP '1992-01-01', l_shipdate) AS aln_start,
  date_diff('day', TIMESTAMP '1992-01-01', l_shipdate) + l_quantity::BIGINT AS aln_end,
  l_quantity::BIGINT + 1 AS ref_len,
  CASE WHEN l_linenumber = 7 THEN 0 ELSE 10 * l_linenumber END AS mapq,
  round(100 * l_discount)::BIGINT AS nm,
  l_linestatus = 'O' AS is_reverse, (l_linestatus = 'O') = (l_partkey % 5 = 0) AS mate_reverse,
  l_partkey % 97 = 0 AS mate_unmapped,
  CASE WHEN l_partkey % 10 = 0 THEN 'chr' || (1 + l_partkey % 24) ELSE 'chr' || (1 + l_suppkey % 24) END AS mate_contig,
  date_diff('day', TIMESTAMP '1992-01-01', l_shipdate) + l_partkey % 200 AS mate_start,
  l_returnflag = 'R' AS is_clipped, 1 + l_linenumber % 4 AS n_cigar,
  CASE WHEN l_linestatus = 'O' THEN -floor(l_extendedprice / 100)::BIGINT ELSE floor(l_extendedprice / 100)::BIGINT END AS tlen
FROM lineitem
"""

ORIENTATION_SQL = """CASE WHEN is_reverse = mate_reverse THEN 'TANDEM'
  WHEN (CASE WHEN is_reverse THEN mate_start ELSE aln_start END) < (CASE WHEN is_reverse THEN aln_end ELSE aln_start + tlen END) THEN 'FR' ELSE 'RF' END"""


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.concat(F.lit("chr"), (1 + F.col("o_custkey") % 24).cast("string")).alias("contig"), day("o_orderdate").alias("start"), (day("o_orderdate") + 10 + F.col("o_orderkey") % 90).alias("stop"), F.col("o_orderkey").alias("ord"))


TRUTH_SQL = "SELECT 'chr' || (1 + o_custkey % 24) AS contig, date_diff('day', TIMESTAMP '1992-01-01', o_orderdate) AS start, date_diff('day', TIMESTAMP '1992-01-01', o_orderdate) + 10 + o_orderkey % 90 AS stop, o_orderkey AS ord FROM orders"


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders again, a few days off, and every fourth by half a year, so that it meets its truth no more."""
    o = table(spark, sf_dir, "orders")
    pos = day("o_orderdate") + F.col("o_orderkey") % 7 - 3 + F.when(F.col("o_orderkey") % 4 == 0, 180).otherwise(0)
    return o.select(F.concat(F.lit("chr"), (1 + F.col("o_custkey") % 24).cast("string")).alias("contig"), pos.alias("start"), (pos + 10 + F.col("o_orderkey") % 90 + F.col("o_orderkey") % 11 - 5).alias("stop"), F.col("o_orderkey").alias("ord"))


CANDIDATES_SQL = """SELECT 'chr' || (1 + o_custkey % 24) AS contig, pos AS start, pos + 10 + o_orderkey % 90 + o_orderkey % 11 - 5 AS stop, o_orderkey AS ord
  FROM (SELECT *, date_diff('day', TIMESTAMP '1992-01-01', o_orderdate) + o_orderkey % 7 - 3 + CASE WHEN o_orderkey % 4 = 0 THEN 180 ELSE 0 END AS pos FROM orders)"""


def vcf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``value`` (VCF lines) and ``ord``."""
    o = table(spark, sf_dir, "orders")
    pos = (1 + day("o_orderdate")).cast("string")
    kind = F.when(F.col("o_orderkey") % 2 == 0, "DEL").otherwise("DUP")
    size = F.when(F.col("o_orderkey") % 5 == 0, "False").otherwise(F.concat(F.lit("-"), (10 + F.col("o_orderkey") % 90).cast("string")))
    end = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.concat(F.lit("END="), (day("o_orderdate") + 11 + F.col("o_orderkey") % 90).cast("string"), F.lit(";")))
    info = F.concat(F.lit("IMPRECISE;SVTYPE="), kind, F.lit(";"), end, F.lit("SVLEN="), size, F.lit(";ZU"))
    contig = F.concat(F.when(F.col("o_custkey") % 2 == 0, "chr").otherwise(""), (1 + F.col("o_custkey") % 24).cast("string"))
    line = F.concat_ws("\t", contig, pos, F.col("o_orderkey").cast("string"), F.lit("ACG"), F.concat(F.lit("<"), kind, F.lit(">")), F.lit("."), F.lit("PASS"), info, F.lit("GT"), F.lit("0/1"))
    return o.select(line.alias("value"), F.col("o_orderkey").alias("ord"))


VCF_SQL = """SELECT o_orderkey AS ord, concat_ws(chr(9), CASE WHEN o_custkey % 2 = 0 THEN 'chr' ELSE '' END || (1 + o_custkey % 24), (1 + date_diff('day', TIMESTAMP '1992-01-01', o_orderdate))::VARCHAR, o_orderkey::VARCHAR, 'ACG',
  '<' || CASE WHEN o_orderkey % 2 = 0 THEN 'DEL' ELSE 'DUP' END || '>', '.', 'PASS',
  'IMPRECISE;SVTYPE=' || CASE WHEN o_orderkey % 2 = 0 THEN 'DEL' ELSE 'DUP' END || ';' || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'END=' || (date_diff('day', TIMESTAMP '1992-01-01', o_orderdate) + 11 + o_orderkey % 90) || ';' END
  || 'SVLEN=' || CASE WHEN o_orderkey % 5 = 0 THEN 'False' ELSE '-' || (10 + o_orderkey % 90) END || ';ZU', 'GT', '0/1') AS value FROM orders"""


LETTERS, BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"


def bases(text: Column) -> Column:
    """All ASCII letters of a text as bases."""
    return F.translate(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z]", "")), LETTERS, BASES)


def bases_sql(text: str) -> str:
    return f"translate(lower(regexp_replace(coalesce({text}, ''), '[^A-Za-z]', '', 'g')), '{LETTERS}', '{BASES}')"


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_id, seq): documents' letters as bases."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("read_id"), bases(F.col("text")).alias("seq"))


SEQUENCES_SQL = f"SELECT doc_id AS read_id, {bases_sql('text')} AS seq FROM documents"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, weight) of 40 vertices."""
    x = table(spark, sf_dir, "lineitem")
    return x.select((F.col("l_partkey") % 40).cast("string").alias("src"), (F.col("l_suppkey") % 40).cast("string").alias("dst")).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


EDGES_SQL = "SELECT (l_partkey % 40)::VARCHAR AS src, (l_suppkey % 40)::VARCHAR AS dst, count(*) AS weight FROM lineitem GROUP BY 1, 2"


def forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, weight): each customer's vertex is linked to a later one, every seventh to its nation's; no cycles, one way on."""
    o = table(spark, sf_dir, "customer")
    later = F.concat(F.lit("v"), (F.col("c_custkey") + 1 + F.col("c_custkey") % 3).cast("string"))
    dst = F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))).otherwise(later)
    return o.select(F.concat(F.lit("v"), F.col("c_custkey").cast("string")).alias("src"), dst.alias("dst"), (1 + F.col("c_nationkey").cast("long") % 9).alias("weight"))


FOREST_SQL = "SELECT 'v' || c_custkey AS src, CASE WHEN c_custkey % 7 = 0 THEN 'n' || c_nationkey ELSE 'v' || (c_custkey + 1 + c_custkey % 3) END AS dst, (1 + c_nationkey::BIGINT % 9) AS weight FROM customer"
