"""Line dedup with DataFrame functions only.

Lines are exploded with their positions and normalised to a key. Keys are hashed
to 128 bits, distinct documents are counted for each hash, and the lines of keys
over the threshold are dropped by position. Up to there only hashes, ids and
positions are shuffled; a common line becomes one row for each task before its
shuffle, and the lines of hot keys are not dealt by key (``hot_join``). In the end
the positions to drop meet the texts in a join that shuffles both.

Edge cases: a null or empty text is one empty line; keys shorter than
``min_chars`` never count; several lines of a document with one key count once
but are all dropped; rows with equal doc_id are one document, and all of them
keep the line if theirs is the largest id; a null doc_id is an id below all
others; an empty table gives an empty table; other columns are not read, but for
those carried along in one struct.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_join, stored, texts

#: Characters stripped from both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, text_id, was_null, n_lines, n_dropped, kept, carried: every row of docs with the text that stays, and a struct of the columns named in carry.

    A line whose key has at least min_chars code points and is found in at least
    min_docs documents stays only in the largest doc_id that holds it. text_id is
    a hash of the text, which tells apart rows of equal doc_id.
    """
    carried = F.struct(*carry) if carry else F.lit(None)
    rows = texts(docs, F.col("text").isNull().alias("was_null"), carried.alias("carried")).withColumn("text_id", F.xxhash64("text"))
    lines = rows.select("doc_id", "text_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keyed = lines.withColumn("key", line_key(F.col("line"))).where(F.length("key") >= min_chars)
    hashed = keyed.select("doc_id", "text_id", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(29), F.col("key")).alias("h2"))
    # Null ids sort below all others and count as one document.
    held = hashed.select("h1", "h2", F.col("doc_id").isNull().alias("no_id"), "doc_id").distinct()
    common = stored(held.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper")).where(F.col("n_docs") >= min_docs), "lines")
    drops = (
        hot_join(hashed, common, ["h1", "h2"], "n_docs", ["doc_id", "text_id", "pos"])
        .where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy("doc_id", "text_id")
        .agg(F.collect_set("pos").alias("drops"))
        .select(F.col("doc_id").alias("d_id"), F.col("text_id").alias("d_text"), "drops")
    )
    joined = rows.join(drops, F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.col("text_id") == F.col("d_text")), "left")
    parts = joined.withColumn("lines", F.split("text", "\n", -1)).withColumn("n_lines", F.size("lines").cast("bigint"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drops"))
    kept = F.when(F.col("drops").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    return parts.select("doc_id", "text_id", "was_null", "n_lines", F.when(F.col("drops").isNull(), 0).otherwise(F.size("drops")).cast("bigint").alias("n_dropped"), kept.alias("kept"), "carried")
