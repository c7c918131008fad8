"""Multi-party perspective rotation of dialogues, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

#: Turns of one block: running sums go within blocks first, then over the blocks' totals, so no task holds a whole long dialogue.
BLOCK = 64
SELF, OTHER_OPEN, CLOSE, END = "<|assistant|>\n", "<|user name=", "|>\n", "\n"


def rotate(turns: DataFrame) -> DataFrame:
    """For every participant of every dialogue, the dialogue with that speaker as assistant, the others as named users.

    One row for each perspective and turn: ``seq`` counts a dialogue's turns from 0 (by turn, role, text; null turns
    first), ``rendered`` is the turn's piece of the rendering, ``text_start`` and ``text_end`` are the code points of the
    turn's text within the whole rendering, ``is_target`` is the loss mask: true on the speaker's own texts.
    Concatenating ``rendered`` by ``seq`` gives the training text.

    Rows without conv_id belong to no dialogue and are left out. A null role is the speaker "unknown", a null text is
    empty. Repeated rows are turns of their own. Other columns are ignored.
    """
    base = turns.where(F.col("conv_id").isNotNull()).select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("unknown")).alias("speaker"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.expr(f"turn div {BLOCK}"), F.lit(-(1 << 60))).alias("block"),
    )
    speakers = base.select("conv_id", F.col("speaker").alias("perspective")).distinct()
    own = F.col("speaker") == F.col("perspective")
    head = F.when(own, F.lit(SELF)).otherwise(F.concat(F.lit(OTHER_OPEN), "speaker", F.lit(CLOSE)))
    rows = (
        base.join(speakers, "conv_id")
        .withColumn("is_target", own)
        .withColumn("rendered", F.concat(head, "text", F.lit(END)))
        .withColumn("head_len", F.length(head))
        .withColumn("len", F.length("rendered").cast("long"))
    )
    block = W.partitionBy("conv_id", "perspective", "block")
    inside = block.orderBy(F.col("turn").asc_nulls_first(), "speaker", "text").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("len").over(inside), F.lit(0))).withColumn("nth", F.count(F.lit(1)).over(inside))
    blocks = rows.groupBy("conv_id", "perspective", "block").agg(F.sum("len").alias("block_len"), F.count(F.lit(1)).alias("block_n"))
    earlier = W.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(
        "conv_id",
        "perspective",
        "block",
        F.coalesce(F.sum("block_len").over(earlier), F.lit(0)).alias("block_before"),
        F.coalesce(F.sum("block_n").over(earlier), F.lit(0)).alias("block_nth"),
    )
    start = F.col("block_before") + F.col("before") + F.col("head_len")
    return rows.join(blocks, ["conv_id", "perspective", "block"]).select(
        "conv_id",
        "perspective",
        (F.col("block_nth") + F.col("nth")).alias("seq"),
        "turn",
        "speaker",
        "rendered",
        start.alias("text_start"),
        (start + F.length("text")).alias("text_end"),
        "is_target",
    )


def op2_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"))


OP2_SQL = """
WITH base AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), speakers AS (SELECT DISTINCT conv_id, speaker AS perspective FROM base),
rendered AS (
  SELECT b.*, perspective, speaker = perspective AS is_target,
    CASE WHEN speaker = perspective THEN '<|assistant|>' || chr(10) ELSE '<|user name=' || speaker || '|>' || chr(10) END AS head
  FROM base b JOIN speakers USING (conv_id)
), placed AS (
  SELECT *, head || text || chr(10) AS rendered,
    row_number() OVER w - 1 AS seq,
    coalesce(sum(length(head || text || chr(10))) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM rendered WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text)
)
SELECT conv_id, perspective, seq::BIGINT AS seq, turn, speaker, rendered,
  (before + length(head))::BIGINT AS text_start, (before + length(head) + length(text))::BIGINT AS text_end, is_target
FROM placed
"""
