"""SRT files as cue tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.timecode import make_cue_id, parse_ts

#: Fixed value: a time line of the SRT format.
STAMP = r"^(\d{2,}:\d{2}:\d{2}[,.]\d{3})\s+-->\s+(\d{2,}:\d{2}:\d{2}[,.]\d{3})(?:\s+.*)?$"


def parse_srt(files: DataFrame, source_language: str = "und", bilingual: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """cues, cue_docs and failures of SRT texts (doc_id, text).

    A document with a bad block, or whose cues overlap or go back, is a failure as a whole.
    """
    plain = F.regexp_replace(F.regexp_replace("text", "^﻿", ""), "\r\n?", "\n")
    blocks = F.filter(F.split(plain, r"\n{2,}", -1), lambda b: ~T.is_blank(b))
    rows = files.select("doc_id", F.posexplode(blocks).alias("_i", "_block")).withColumn("_lines", F.split("_block", "\n", -1))
    numbered = T.strip(F.get("_lines", F.lit(0))).rlike(r"(?U)^\d+$")
    at = F.when(numbered, F.lit(1)).otherwise(F.lit(0))
    rows = rows.withColumns({"_at": at, "_stamp": T.strip(F.get("_lines", at))})
    body = T.strip(F.array_join(F.slice("_lines", F.col("_at") + 2, F.greatest(F.size("_lines") - F.col("_at") - 1, F.lit(0))), "\n"))
    start, end = (parse_ts(F.regexp_extract(F.coalesce("_stamp", F.lit("")), STAMP, k)) for k in (1, 2))
    rows = rows.select("doc_id", (F.col("_i") + 1).alias("seq"), start.alias("start_ms"), end.alias("end_ms"), body.alias("_body"))
    w = Window.partitionBy("doc_id").orderBy("seq")
    rows = rows.withColumn("_before", F.lag("end_ms").over(w)).withColumn("_start_before", F.lag("start_ms").over(w))
    bad = (
        F.when(F.col("start_ms").isNull() | F.col("end_ms").isNull(), F.lit("invalid timestamp"))
        .when(F.length("_body") == 0, F.lit("empty text"))
        .when((F.col("start_ms") >= F.col("end_ms")) | (F.col("start_ms") < F.col("_before")) | (F.col("start_ms") < F.col("_start_before")), F.lit("bad timing"))
    )
    split = F.lit(bilingual) & F.contains("_body", F.lit("\n"))
    second = F.regexp_replace("_body", r"(?s)^[^\n]*\n", "")
    rows = rows.withColumns({"_bad": bad, "_second": F.when(split, second)})
    if bilingual:
        rows = rows.withColumn("_bad", F.coalesce("_bad", F.when(T.is_blank(F.col("_second")), F.lit("blank translation"))))
    state = files.select("doc_id").join(rows.groupBy("doc_id").agg(F.count("*").alias("_n"), F.min("_bad").alias("_bad")), "doc_id", "left")
    failures = state.where("_n IS NULL OR _bad IS NOT NULL").select("doc_id", F.lit("SubtitleValidationError").alias("error_type"), F.coalesce("_bad", F.lit("no cues")).alias("message"))
    good = rows.join(failures.select("doc_id"), "doc_id", "left_anti")
    cues = good.select(
        "doc_id", "seq", make_cue_id(F.col("seq")).alias("cue_id"), "start_ms", "end_ms",
        F.when(split, F.substring_index("_body", "\n", 1)).otherwise(F.col("_body")).alias("source_text"),
        F.lit(None).cast("string").alias("corrected_text"), F.col("_second").alias("translated_text"),
        F.array().cast("array<string>").alias("source_word_ids"), F.array().cast("array<string>").alias("warnings"),
    )
    docs = files.select("doc_id").join(failures.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.lit(source_language).alias("source_language"), F.lit(None).cast("string").alias("target_language"))
    return cues, docs, failures


def read_srt(spark: SparkSession, path: str, source_language: str = "und", bilingual: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    raw = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return parse_srt(raw.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text")), source_language, bilingual)
