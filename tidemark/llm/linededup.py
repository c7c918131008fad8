"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

Equal lines meet by their hashes. Lines within one edit of each other meet by variants with one character deleted.
Emitting all variants of all lines would cost the square of a line's length, so the place of the edit is narrowed first:

* Of the shorter line's halves, the one without the edit agrees as it stands. Lines that share no half with another
  line can't match and emit nothing more.
* The other half, of m characters, is cut into about sqrt(m) windows. What lies before and behind the window with the
  edit agrees. Windows whose surroundings no other line shares emit nothing more.
* The windows that are left emit all their variants with one character deleted, as hashed keys. Kind S (substitution):
  the variant and the deleted place; all lines of one key are within one edit of each other, so each is compared with
  the key's earliest only. Kind D (one character more): a longer line's variants meet the shorter line's window as it
  is; all longer lines of one key are within one edit of its one shorter line.

Either way a key's members are compared with one member, never all with all, and no link is lost. Edit distances are
verified with the texts: all around the window must be equal, and the windows within one edit. The earliest line stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, join_groups, small_side, table

#: Lines of fewer code points are left alone (1: none), and the edit bound is 0 under NEAR_CHARS (a single letter is within
#: one edit of any other) and 1 from there on.
MIN_CHARS, NEAR_CHARS = 1, 2


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, text_key, line_no and line of every line that takes part, with its two hashes (together its identity)."""
    split = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return split.where((F.char_length("line") >= min_chars) & F.col("line").rlike(r"[^ \t-\r]")).select("doc_id", "text_key", "line_no", "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("tidemark"), "line").alias("h2"))


#: The shared-half keys of a line, in their order: t is its length (it is the shorter line, or as long) or one less (the longer).
BACK, SIDE = (0, 0, 1, 1), ("L", "R", "L", "R")


def _half_keys(near_chars: int) -> Column:
    """The column line's four keys: hashes of t and the left or right half of t; null for a t that is too short."""
    made = []
    for back, side in zip(BACK, SIDE):
        half = F.expr(f"(char_length(line) - {back}) div 2")
        key = F.xxhash64(F.char_length("line") - back, F.lit(side), (F.left if side == "L" else F.right)("line", half))
        made.append(F.when(F.char_length("line") - back >= near_chars, key))
    return F.array(*made)


def _shared(keyed: DataFrame, name: str) -> DataFrame:
    """The rows of ``keyed`` whose key is shared with another line, one of them being as short as the key says."""
    keys = cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("back").alias("least")).where("n > 1 AND least = 0").select("key"), f"{name}-keys")
    return cut(keyed.join(small_side(keys, 16, keys.count()), "key", "left_semi"), name)


def _windows(near: DataFrame) -> DataFrame:
    """h1, h2, first, back, key, at and window: each row's other half cut into windows, keyed by all that surrounds them; ``at`` is a window's place in the line."""
    length, half = F.char_length("line"), F.expr("(char_length(line) - back) div 2")
    rest = F.when(F.col("side") == "L", F.expr("substring(line, (char_length(line) - back) div 2 + 1)")).otherwise(F.left("line", length - half))
    sized = near.withColumn("rest", rest).withColumn("m", F.char_length("rest") - F.col("back")).withColumn("wide", F.ceil(F.sqrt("m")).cast("int"))

    def window(start: Column) -> Column:
        upto = F.least(start + F.col("wide"), F.col("m")) + F.col("back")
        around = (F.xxhash64(F.substring("rest", F.lit(1), start)), F.xxhash64(F.substring("rest", upto + 1, F.char_length("rest"))))
        place = start + F.when(F.col("side") == "L", F.expr("(char_length(line) - back) div 2")).otherwise(F.lit(0))
        return F.struct(F.xxhash64("key", start, *around).alias("key"), place.cast("int").alias("at"), F.substring("rest", start + 1, upto - start).alias("window"))

    cuts = F.explode(F.transform(F.sequence(F.lit(0), F.col("m") - 1, F.col("wide")), window)).alias("x")
    return sized.select("h1", "h2", "first", "back", cuts).select("h1", "h2", "first", "back", "x.key", "x.at", "x.window")


def _variants(windows: DataFrame) -> DataFrame:
    """h1, h2, first, at, size, v and longer: each window's variants with one character deleted, and a shorter line's window itself."""
    size = F.char_length("window")

    def without(i: Column) -> Column:
        return F.concat(F.left("window", i - 1), F.substring("window", i + 1, size))

    places = F.sequence(F.lit(1), size)
    swapped = F.transform(places, lambda i: F.struct(F.xxhash64("key", F.lit("S"), i, without(i)).alias("v"), F.lit(0).alias("longer")))
    longer = F.array_distinct(F.transform(places, lambda i: F.struct(F.xxhash64("key", F.lit("D"), without(i)).alias("v"), F.lit(1).alias("longer"))))
    itself = F.array(F.struct(F.xxhash64("key", F.lit("D"), F.col("window")).alias("v"), F.lit(0).alias("longer")))
    return windows.select("h1", "h2", "first", "at", size.alias("size"), F.explode(F.when(F.col("back") == 0, F.concat(swapped, itself)).otherwise(longer)).alias("x")).select("h1", "h2", "first", "at", "size", "x.v", "x.longer")


def _one_edit(line: Column, other: Column, at: Column, size: Column) -> Column:
    """Whether the lines agree but for ``size`` characters of ``line`` at ``at``, and these are within one edit: linear in the lines' length."""
    theirs = size + F.char_length(other) - F.char_length(line)
    around = (F.left(line, at) == F.left(other, at)) & (F.substring(line, at + size + 1, F.char_length(line)) == F.substring(other, at + theirs + 1, F.char_length(other)))
    return around & F.levenshtein(F.substring(line, at + 1, size), F.substring(other, at + 1, theirs), 1).between(0, 1)


def near_lines(docs: DataFrame, min_chars: int = MIN_CHARS, near_chars: int = NEAR_CHARS) -> DataFrame:
    """doc_id, text_key, line_no, kept, of_doc, of_line of every line that isn't blank and has ``min_chars`` code points.

    kept is true if no earlier line is equal, or within one edit where both have ``near_chars`` code points at least;
    else of_doc and of_line name the earliest line found that is. Earlier means a smaller (doc_id, line number); a null
    id comes first. Lines are the pieces between line feeds, compared as they are, at any length; blank ones hold
    nothing but spaces and U+0009 to U+000D. Null and empty texts have no lines. Repeated rows of one id and text count
    as one document: all their first lines stay. An empty table gives no rows; other columns are ignored.
    """
    lines = _lines(docs, min_chars)
    place = F.struct("doc_id", "line_no")
    distinct = cut(
        lines.select("h1", "h2", place.alias("place"), _half_keys(near_chars).alias("keys"))
        .groupBy("h1", "h2")
        .agg(F.min("place").alias("first"), F.any_value("keys").alias("keys"), F.count(F.lit(1)).alias("n")),
        "lines",
    )
    keyed = distinct.select("h1", "h2", "first", F.posexplode("keys").alias("i", "key")).where("key IS NOT NULL")
    keyed = keyed.select("h1", "h2", "first", "key", F.get(F.array(*map(F.lit, BACK)), F.col("i")).alias("back"), F.get(F.array(*map(F.lit, SIDE)), F.col("i")).alias("side"))
    near = _shared(keyed, "halves")
    wanted = near.select("h1", "h2").distinct()
    texts = cut(lines.join(small_side(wanted, 24, near.count()), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.min("line").alias("line")), "texts")
    # Variants carry hashes only; texts are joined to the pairs that are left.
    variants = _variants(_shared(_windows(near.join(texts, ["h1", "h2"])), "windows"))
    who = F.struct("first", "h1", "h2")
    heads = variants.groupBy("v").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(F.col("longer") == 0, who)).alias("short"),
        F.min(F.when(F.col("longer") == 1, who)).alias("long"),
    ).where("n > 1 AND short IS NOT NULL").select("v", "short", "long")
    met = variants.join(heads, "v")
    # Equal lengths meet the key's earliest; a longer line its one shorter line; that line the earliest longer one.
    others = F.when(F.col("longer") == 1, F.array("short")).otherwise(F.array("short", "long"))
    pairs = met.select("h1", "h2", "first", "at", "size", F.explode(others).alias("o")).where("o IS NOT NULL AND o.first < first").select("h1", "h2", "at", "size", F.col("o.h1").alias("o1"), F.col("o.h2").alias("o2"), F.col("o.first").alias("of")).distinct()
    other = texts.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("line").alias("other"))
    found = pairs.join(texts, ["h1", "h2"]).join(other, ["o1", "o2"]).where(_one_edit(F.col("line"), F.col("other"), F.col("at"), F.col("size"))).groupBy("h1", "h2").agg(F.min("of").alias("earlier"))
    total = distinct.agg(F.sum("n")).first()[0] or 0
    verdict = distinct.select("h1", "h2", "first", F.col("n").alias("size")).join(cut(found, "found"), ["h1", "h2"], "left")
    judged = join_groups(lines.select("doc_id", "text_key", "line_no", "h1", "h2"), verdict, ["h1", "h2"], total, ["doc_id", "line_no"])
    mine = F.struct("doc_id", "line_no").eqNullSafe(F.col("first"))
    of = F.when(F.col("earlier").isNotNull(), F.col("earlier")).when(~mine, F.col("first"))
    return judged.select("doc_id", "text_key", "line_no", (mine & F.col("earlier").isNull()).alias("kept"), of["doc_id"].alias("of_doc"), of["line_no"].alias("of_line"))


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, near_chars: int = NEAR_CHARS) -> DataFrame:
    """``docs`` without the lines that ``near_lines`` drops; rows that lose lines and have only blank ones left go.

    All columns stay; n_chars, where there is one, is counted anew. Rows of which no line goes stay as they are.
    """
    gone = near_lines(docs, min_chars, near_chars).where("NOT kept").groupBy("doc_id", "text_key").agg(F.collect_set("line_no").alias("__gone"))
    gone = gone.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "__gone")
    keyed = docs.withColumn("__text_key", F.xxhash64("text"))
    joined = keyed.join(gone, keyed["doc_id"].eqNullSafe(gone["__id"]) & (F.col("__text_key") == F.col("__key")), "left")

    def left(pieces: Column) -> Column:
        # Set difference of line numbers: the work is in proportion to a document's lines.
        stay = F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), F.col("__gone"))
        return F.array_join(F.transform(stay, lambda i: F.get(pieces, i)), "\n")

    text = F.get(F.transform(F.array(F.split("text", "\n")), left), F.lit(0))
    out = joined.withColumn("__left", F.when(F.col("__gone").isNotNull(), text)).where(F.col("__left").isNull() | F.col("__left").rlike(r"[^ \t-\r]"))
    text = F.coalesce("__left", "text")
    columns = [text.alias("text") if c == "text" else F.when(F.col("__left").isNotNull(), F.char_length("__left").cast("long")).otherwise(F.col("n_chars")).alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns]
    return out.select(*columns)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_lines(table(spark, sf_dir, "documents")).drop("text_key")


# DuckDB's levenshtein counts bytes, so lines with longer characters are compared by their common beginnings and ends too.
_ONE_EDIT = """(levenshtein(a.line, b.line) <= 1 OR ((strlen(a.line) <> length(a.line) OR strlen(b.line) <> length(b.line)) AND len(list_filter(range(0, least(length(a.line), length(b.line)) + 1),
    lambda i: left(a.line, i) = left(b.line, i) AND substr(a.line, i + 1 + (length(a.line) >= length(b.line))::INTEGER) = substr(b.line, i + 1 + (length(b.line) >= length(a.line))::INTEGER))) > 0))"""

OP10_SQL = f"""
WITH raw AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
  FROM documents
), lines AS (SELECT doc_id, line_no, line FROM raw WHERE length(line) >= {MIN_CHARS} AND regexp_matches(line, '[^ \\t-\\r]')),
firsts AS (SELECT line, min({{'d': doc_id, 'l': line_no}}) AS first FROM lines GROUP BY line),
halves AS (
  SELECT line, first, length(line) - back AS t, back, 'L' AS side, left(line, (length(line) - back) // 2) AS part FROM firsts, (VALUES (0), (1)) b(back) WHERE length(line) - back >= {NEAR_CHARS}
  UNION ALL
  SELECT line, first, length(line) - back, back, 'R', right(line, (length(line) - back) // 2) FROM firsts, (VALUES (0), (1)) b(back) WHERE length(line) - back >= {NEAR_CHARS}
), near AS (
  SELECT a.line, min(b.first) AS earlier
  FROM halves a JOIN halves b ON a.t = b.t AND a.side = b.side AND a.part = b.part AND a.line <> b.line AND b.first < a.first
  WHERE a.back + b.back < 2 AND {_ONE_EDIT}
  GROUP BY a.line
)
SELECT l.doc_id, l.line_no::INTEGER AS line_no,
  (l.doc_id = f.first.d AND l.line_no = f.first.l AND n.earlier IS NULL) AS kept,
  CASE WHEN n.earlier IS NOT NULL THEN n.earlier.d WHEN l.doc_id <> f.first.d OR l.line_no <> f.first.l THEN f.first.d END AS of_doc,
  (CASE WHEN n.earlier IS NOT NULL THEN n.earlier.l WHEN l.doc_id <> f.first.d OR l.line_no <> f.first.l THEN f.first.l END)::INTEGER AS of_line
FROM lines l JOIN firsts f USING (line) LEFT JOIN near n USING (line)
"""
