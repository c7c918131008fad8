"""A training corpus from the documents table: five stages, each on all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.bpe import encode_decode
from tidemark.llm.common import cut, table
from tidemark.llm.linededup import drop_lines
from tidemark.llm.minhash import near_duplicates
from tidemark.llm.mixing import sample_documents
from tidemark.llm.outliers import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie far from their language and source go.

    Null and empty texts go, null languages and sources are groups of their own, repeated rows and rows of one id go each by
    their own verdict. Columns of any name and type stay; an empty table stays empty. So do the next stages, unless said.
    """
    return keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines that are equal, or within one edit from 20 code points on, the earliest stays; documents without a line left go.

    Null and empty texts stay as they are. Repeated rows of one id and text count as one document. n_chars is counted anew.
    """
    return drop_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the least id: five-word shingles, similarity 0.8 or more.

    Rows without an id, and texts without words, stay. All rows of an id go together.
    """
    gone = near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that sources, languages and topics come nearer to their target weights.

    An id is drawn once, so its rows stay or go together, where their cells have the same probability; rows without an id
    share one draw. Null sources and languages are values of their own.
    """
    return sample_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's number of tokens, digest of its ids, and digest of the bytes that they decode to; a null text has no tokens."""
    return encode_decode(docs)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("minhash_near_dedup", near_copies), ("source_mixing", mixing), ("byte_bpe", encoding)]

#: SQL can't express near-copy components or the merges of byte pairs.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs, name)
    return docs
