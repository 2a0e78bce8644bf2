"""Raw and canonical transcripts as tables.

Each normaliser takes a table with a doc_id and nested raw results, and returns
Transcripts and a table of failures (doc_id, error_type, message). Timing is never made
up: a document without the times it needs is a failure.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.timecode import make_id, seconds_to_ms
from ..operators.segmentation import apart, in_order

WORD = "struct<id: string, text: string, start_ms: bigint, end_ms: bigint, confidence: double>"
SEGMENT = "struct<id: string, text: string, start_ms: bigint, end_ms: bigint, word_ids: array<string>>"
TRANSCRIPT = f"schema_version string, language string, text string, timing_origin string, words array<{WORD}>, segments array<{SEGMENT}>, provider string, model_name string"
CUE = "struct<id: string, start_ms: bigint, end_ms: bigint, source_text: string, corrected_text: string, translated_text: string, source_word_ids: array<string>, warnings: array<string>>"
SUBTITLE = f"schema_version string, source_language string, target_language string, cues array<{CUE}>"
RAW_SEGMENTS = "language string, model_name string, text string, segments array<struct<id: string, text: string, start_ms: bigint, end_ms: bigint, words: array<struct<id: string, text: string, start_ms: bigint, end_ms: bigint, confidence: double>>>>"
RAW_WHISPER = "language string, segments array<struct<text: string, start: double, `end`: double, words: array<struct<word: string, start: double, `end`: double, probability: double>>>>"
RAW_HYPOTHESES = "hypotheses array<struct<text: string, language: string, lang: string, timestamp: struct<word: array<struct<word: string, char: string, text: string, start: double, `end`: double>>, segment: array<struct<segment: string, text: string, start: double, `end`: double>>>>>"
RAW_ALIGNED = "results array<struct<language: string, text: string, time_stamps: array<struct<text: string, start_time: double, end_time: double>>, segments: array<struct<text: string, start_time: double, end_time: double, start: double, `end`: double>>, start_time: double, end_time: double>>"


@dataclass
class Transcripts:
    """docs (doc_id, language, text, timing_origin, provider, model_name), words and segments."""

    docs: DataFrame
    words: DataFrame
    segments: DataFrame

    def without(self, failures: DataFrame) -> Transcripts:
        bad = failures.select("doc_id")
        return Transcripts(*(t.join(bad, "doc_id", "left_anti") for t in (self.docs, self.words, self.segments)))


def read_json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a file, with doc_id, its path."""
    return spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").json(path).withColumn("doc_id", F.col("_metadata.file_path"))


def read_transcripts(spark: SparkSession, path: str) -> Transcripts:
    raw = read_json_documents(spark, path, TRANSCRIPT)
    docs = raw.select("doc_id", "language", "text", "timing_origin", "provider", "model_name")
    words = raw.select("doc_id", F.posexplode("words").alias("_i", "w")).select("doc_id", (F.col("_i") + 1).alias("seq"), F.col("w.id").alias("word_id"), "w.text", "w.start_ms", "w.end_ms", "w.confidence")
    segments = raw.select("doc_id", F.posexplode("segments").alias("_i", "s")).select("doc_id", (F.col("_i") + 1).alias("seq"), F.col("s.id").alias("segment_id"), "s.text", "s.start_ms", "s.end_ms", "s.word_ids")
    return Transcripts(docs, words, segments)


def read_subtitle_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """cues and cue_docs of canonical subtitle files."""
    raw = read_json_documents(spark, path, SUBTITLE)
    cues = raw.select("doc_id", F.posexplode("cues").alias("_i", "c")).select(
        "doc_id", (F.col("_i") + 1).alias("seq"), F.col("c.id").alias("cue_id"), "c.start_ms", "c.end_ms", "c.source_text", "c.corrected_text", "c.translated_text", "c.source_word_ids", "c.warnings"
    )
    return cues, raw.select("doc_id", "source_language", "target_language")


def _failures(flags: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row for each document of which some rule holds; flags has one row a document."""
    found = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules.items())))
    rows = flags.select("doc_id", found.alias("_f")).where(F.size("_f") > 0)
    return rows.select("doc_id", F.lit("TranscriptionError").alias("error_type"), F.array_join("_f", "; ").alias("message"))


def _flatten_words(raw: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """doc_id, segment, seq (running over the document) and fields of the struct w, from raw rows with arrays words in segments."""
    per_segment = raw.select("doc_id", F.posexplode("segments").alias("_s", "s"))
    rows = per_segment.select("doc_id", (F.col("_s") + 1).alias("segment"), F.posexplode("s.words").alias("_w", "w"))
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy("doc_id").orderBy("segment", "_w"))).select("doc_id", "segment", "seq", *(c.alias(n) for n, c in fields.items()))


def _with_word_ids(segments: DataFrame, words: DataFrame) -> DataFrame:
    ids = words.groupBy("doc_id", F.col("segment").alias("seq")).agg(F.sort_array(F.collect_list(F.struct("seq", "word_id"))).alias("_ids"))
    return segments.join(ids, ["doc_id", "seq"], "left").withColumn("word_ids", F.coalesce(F.col("_ids.word_id"), F.array().cast("array<string>"))).drop("_ids")


def normalize_segments_json(raw: DataFrame, provider: str = "generic") -> Transcripts:
    """Segments with optional words; missing ids are numbered, words over the whole document."""
    w, s = F.col("w"), F.col("s")
    words = _flatten_words(raw, {"word_id": w["id"], "text": w["text"], "start_ms": w["start_ms"], "end_ms": w["end_ms"], "confidence": w["confidence"]})
    words = words.withColumn("word_id", F.coalesce("word_id", make_id("w", F.col("seq"))))
    rows = raw.select("doc_id", F.posexplode("segments").alias("_i", "s")).select("doc_id", (F.col("_i") + 1).alias("seq"), s["id"].alias("segment_id"), s["text"].alias("text"), s["start_ms"].alias("start_ms"), s["end_ms"].alias("end_ms"))
    rows = rows.withColumn("segment_id", F.coalesce("segment_id", make_id("seg", F.col("seq"))))
    timed = F.exists("segments", lambda x: F.coalesce(F.size(x["words"]) > 0, F.lit(False)))
    docs = raw.select(
        "doc_id", "language", F.coalesce("text", F.array_join(F.col("segments.text"), "")).alias("text"),
        F.when(timed, F.lit("asr_native")).otherwise(F.lit("segment_native")).alias("timing_origin"),
        F.lit(provider).alias("provider"), F.coalesce("model_name", F.lit("unknown")).alias("model_name"),
    )
    return Transcripts(docs, words.drop("segment"), _with_word_ids(rows, words).select("doc_id", "seq", "segment_id", "text", "start_ms", "end_ms", "word_ids"))


def normalize_whisper(raw: DataFrame, provider: str = "whisper", model_name: str = "unknown") -> tuple[Transcripts, DataFrame]:
    """Times in seconds, words in every segment; documents with missing words or bad ranges fail."""
    w, s = F.col("w"), F.col("s")
    words = _flatten_words(raw, {"text": w["word"], "start_ms": seconds_to_ms(w["start"]), "end_ms": seconds_to_ms(w["end"]), "confidence": w["probability"]})
    words = words.select("doc_id", "segment", "seq", make_id("w", F.col("seq")).alias("word_id"), "text", "start_ms", "end_ms", "confidence")
    rows = raw.select("doc_id", F.posexplode("segments").alias("_i", "s")).select("doc_id", (F.col("_i") + 1).alias("seq"), s["text"].alias("text"), seconds_to_ms(s["start"]).alias("start_ms"), seconds_to_ms(s["end"]).alias("end_ms"))
    rows = rows.withColumn("segment_id", make_id("seg", F.col("seq")))
    bad = lambda x: F.coalesce(seconds_to_ms(x["start"]) >= seconds_to_ms(x["end"]), F.lit(True))
    failures = _failures(
        raw,
        {
            "no segments": F.coalesce(F.size("segments") == 0, F.lit(True)),
            "missing words": F.exists("segments", lambda x: F.coalesce(F.size(x["words"]) == 0, F.lit(True)) | x["words"].isNull()),
            "bad segment range": F.exists("segments", bad),
            "bad word range": F.exists("segments", lambda x: F.coalesce(F.exists(x["words"], bad), F.lit(False))),
            "missing text": F.exists("segments", lambda x: x["text"].isNull() | F.coalesce(F.exists(x["words"], lambda y: y["word"].isNull() | y["probability"].isNull()), F.lit(False))),
        },
    )
    docs = raw.select("doc_id", "language", F.array_join(F.col("segments.text"), "").alias("text"), F.lit("asr_native").alias("timing_origin"), F.lit(provider).alias("provider"), F.lit(model_name).alias("model_name"))
    found = Transcripts(docs, words.drop("segment"), _with_word_ids(rows, words).select("doc_id", "seq", "segment_id", "text", "start_ms", "end_ms", "word_ids"))
    return found.without(failures), failures


def assign_words_to_segments(words: DataFrame, segments: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, seq, segment_id, text, start_ms, end_ms, word_ids.

    A word goes to the first segment whose range holds its middle, and the segment's
    range is widened to its words. Where a segment is empty, reversed or begins before
    the widened end of the one before it, or a word is left, the document gets one
    segment over all its words. segments: doc_id, seq, text, start_ms, end_ms.
    """
    # Segments that overlap, or go back, give the document one segment whatever they claim. All others are apart in order of
    # their starts but for shared ends, so a sweep over starts and middles that carries the last segment finds the first that claims.
    kept = segments.withColumns({"_before_seq": F.lag("seq").over(in_order()), "_before_end": F.lag("end_ms").over(in_order())})
    claim = F.struct("seq", "start_ms", "end_ms", "_before_seq", "_before_end")
    events = apart(kept).select("doc_id", F.col("start_ms").alias("_at"), F.lit(0).alias("_kind"), claim.alias("_claim")).unionByName(
        words.select("doc_id", F.floor((F.col("start_ms") + F.col("end_ms")) / 2).alias("_at"), F.lit(1).alias("_kind"), "seq", "word_id", "start_ms", "end_ms"), allowMissingColumns=True
    )
    sweep = Window.partitionBy("doc_id").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = events.withColumn("_claim", F.last("_claim", ignorenulls=True).over(sweep)).where("_kind = 1")
    shared = (F.col("_claim.start_ms") == F.col("_at")) & (F.col("_claim._before_end") == F.col("_at"))
    segment = F.when(shared, F.col("_claim._before_seq")).when(F.col("_at") <= F.col("_claim.end_ms"), F.col("_claim.seq"))
    first = swept.select("doc_id", "seq", segment.alias("segment"), "word_id", "start_ms", "end_ms")
    claimed = first.where("segment IS NOT NULL").groupBy("doc_id", "segment").agg(
        F.min_by("start_ms", "seq").alias("_from"), F.max_by("end_ms", "seq").alias("_to"), F.sort_array(F.collect_list(F.struct("seq", "word_id"))).alias("_ids")
    )
    wide = segments.join(claimed.withColumnRenamed("segment", "seq"), ["doc_id", "seq"], "left").select(
        "doc_id", "seq", "text", F.col("start_ms").alias("_start"), F.col("end_ms").alias("_end"),
        F.least("start_ms", "_from").alias("start_ms"), F.greatest("end_ms", "_to").alias("end_ms"), F.col("_ids.word_id").alias("word_ids"),
    )
    checked = wide.withColumn("_before", F.lag("end_ms").over(in_order()))
    bad = (F.col("_start") >= F.col("_end")) | (F.col("_start") < F.col("_before")) | F.col("word_ids").isNull()
    verdict = checked.groupBy("doc_id").agg(F.bool_or(F.coalesce(bad, F.lit(False))).alias("_bad"))
    left = first.where("segment IS NULL").select("doc_id").distinct().withColumn("_left", F.lit(True))
    state = words.select("doc_id").distinct().join(verdict, "doc_id", "left").join(left, "doc_id", "left")
    whole = state.where(F.coalesce("_bad", F.lit(True)) | F.col("_left").isNotNull()).select("doc_id")
    native = wide.join(whole, "doc_id", "left_anti").withColumn("segment_id", make_id("seg", F.row_number().over(in_order())))
    one = words.join(whole, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("start_ms", "seq").alias("start_ms"), F.max_by("end_ms", "seq").alias("end_ms"), F.sort_array(F.collect_list(F.struct("seq", "word_id"))).alias("_ids"))
    one = one.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", F.lit(1).alias("seq"), F.lit("seg000001").alias("segment_id"), "text", "start_ms", "end_ms", F.col("_ids.word_id").alias("word_ids"))
    return native.select("doc_id", F.col("seq").cast("int").alias("seq"), "segment_id", "text", "start_ms", "end_ms", "word_ids").unionByName(one)


def normalize_hypotheses(raw: DataFrame, language_hint: str | None = None, provider: str = "hypotheses", model_name: str = "unknown") -> tuple[Transcripts, DataFrame]:
    """Exactly one hypothesis with native words; segments by assign_words_to_segments."""
    h = raw.select("doc_id", F.size("hypotheses").alias("_n"), F.get("hypotheses", F.lit(0)).alias("h"))
    solid = lambda c: F.when(~T.is_blank(c), c)
    w = F.col("w")
    words = h.select("doc_id", F.posexplode("h.timestamp.word").alias("_i", "w")).select(
        "doc_id", (F.col("_i") + 1).alias("seq"), make_id("w", F.col("_i") + 1).alias("word_id"), F.coalesce(solid(w["word"]), solid(w["char"]), solid(w["text"])).alias("text"),
        seconds_to_ms(w["start"]).alias("start_ms"), seconds_to_ms(w["end"]).alias("end_ms"), F.lit(None).cast("double").alias("confidence"),
    )
    s = F.col("s")
    segments = h.select("doc_id", F.posexplode("h.timestamp.segment").alias("_i", "s")).select(
        "doc_id", (F.col("_i") + 1).alias("seq"), F.coalesce(solid(s["segment"]), solid(s["text"])).alias("text"), seconds_to_ms(s["start"]).alias("start_ms"), seconds_to_ms(s["end"]).alias("end_ms")
    )
    language = F.coalesce(solid(F.col("h.language")), solid(F.col("h.lang")), F.lit(language_hint), F.lit("und"))
    docs = h.select("doc_id", T.strip(language).alias("language"), F.col("h.text").alias("text"), F.lit("asr_native").alias("timing_origin"), F.lit(provider).alias("provider"), F.lit(model_name).alias("model_name"))
    bad_words = words.groupBy("doc_id").agg(F.bool_or(F.coalesce(F.col("start_ms") >= F.col("end_ms"), F.lit(True))).alias("_range"), F.bool_or(F.col("text").isNull()).alias("_text"))
    bad_segments = segments.groupBy("doc_id").agg(F.bool_or(F.col("text").isNull() | F.col("start_ms").isNull() | F.col("end_ms").isNull()).alias("_segments"))
    flags = h.join(bad_words, "doc_id", "left").join(bad_segments, "doc_id", "left")
    failures = _failures(
        flags,
        {
            "not exactly one hypothesis": F.coalesce(F.col("_n") != 1, F.lit(True)),
            "missing text": F.col("h.text").isNull(),
            "missing words": F.col("_range").isNull(),
            "bad word range": F.coalesce("_range", F.lit(False)),
            "word without text": F.coalesce("_text", F.lit(False)),
            "bad segment": F.coalesce("_segments", F.lit(False)),
        },
    )
    found = Transcripts(docs, words, assign_words_to_segments(words, segments, docs)).without(failures)
    return found, failures


def merge_zero_span_items(items: DataFrame) -> DataFrame:
    """doc_id, seq, text, start_time, end_time: items without time of their own joined to a timed neighbour.

    Their text goes before the next timed item's; after the last timed item, to that
    item's end. Parts with CJK characters are joined directly, others by a space.
    items: doc_id, seq, text, start_time, end_time.
    """
    timed = F.col("start_time") < F.col("end_time")
    w = Window.partitionBy("doc_id").orderBy("seq")
    before = F.coalesce(F.sum(timed.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    count = F.sum(timed.cast("int")).over(Window.partitionBy("doc_id"))
    rows = items.withColumns({"_timed": timed, "_g": before, "_n": count}).where("_n > 0")
    rows = rows.withColumns({"_tail": F.col("_g") >= F.col("_n"), "_g": F.least("_g", F.col("_n") - 1)})

    def joined(parts: Column) -> Column:
        return F.when(F.exists(parts, lambda x: x.rlike(f"[{T.CJK}]")), F.array_join(parts, "")).otherwise(F.array_join(parts, " "))

    grouped = rows.groupBy("doc_id", "_g").agg(
        F.sort_array(F.collect_list(F.when(~F.col("_tail"), F.struct("seq", "text")))).alias("_head"),
        F.sort_array(F.collect_list(F.when(F.col("_tail"), F.struct("seq", "text")))).alias("_rest"),
        F.max(F.when(F.col("_timed"), F.col("start_time"))).alias("start_time"),
        F.max(F.when(F.col("_timed"), F.col("end_time"))).alias("end_time"),
    )
    head = joined(F.col("_head.text"))
    whole = F.when(F.size("_rest") == 0, head).otherwise(joined(F.concat(F.array(head), F.col("_rest.text"))))
    return grouped.select("doc_id", (F.col("_g") + 1).cast("int").alias("seq"), whole.alias("text"), "start_time", "end_time")


def normalize_aligned(raw: DataFrame, language_hint: str | None = None, provider: str = "aligned", model_name: str = "unknown") -> tuple[Transcripts, DataFrame]:
    """Results with aligner items or native segments, not both kinds in a document; the last non-blank language counts."""
    r = raw.select("doc_id", F.posexplode("results").alias("_i", "r")).withColumn("_i", F.col("_i") + 1)
    key = F.struct("doc_id", "_i")
    items = r.where("r.time_stamps IS NOT NULL").select(key.alias("doc_id"), F.posexplode("r.time_stamps").alias("_w", "w")).select("doc_id", (F.col("_w") + 1).alias("seq"), "w.text", "w.start_time", "w.end_time")
    merged = merge_zero_span_items(items).select(F.col("doc_id.doc_id").alias("doc_id"), F.col("doc_id._i").alias("segment"), "seq", "text", seconds_to_ms(F.col("start_time")).alias("start_ms"), seconds_to_ms(F.col("end_time")).alias("end_ms"))
    running = F.row_number().over(Window.partitionBy("doc_id").orderBy("segment", "seq"))
    words = merged.withColumn("seq", running).select("doc_id", "segment", "seq", make_id("w", F.col("seq")).alias("word_id"), "text", "start_ms", "end_ms", F.lit(None).cast("double").alias("confidence"))
    ids = words.groupBy("doc_id", "segment").agg(F.sort_array(F.collect_list(F.struct("seq", "word_id"))).alias("_ids"), F.min_by("start_ms", "seq").alias("start_ms"), F.max_by("end_ms", "seq").alias("end_ms"))
    timed = ids.join(r.select("doc_id", F.col("_i").alias("segment"), F.col("r.text").alias("text")), ["doc_id", "segment"]).select("doc_id", F.col("segment").alias("_a"), F.lit(0).alias("_b"), make_id("seg", F.col("segment")).alias("segment_id"), "text", "start_ms", "end_ms", F.col("_ids.word_id").alias("word_ids"))
    own = F.when(F.col("r.segments").isNotNull(), F.col("r.segments")).when(
        F.col("r.start_time").isNotNull() & F.col("r.end_time").isNotNull(),
        F.array(F.struct(F.col("r.text").alias("text"), F.col("r.start_time").alias("start_time"), F.col("r.end_time").alias("end_time"), F.lit(None).cast("double").alias("start"), F.lit(None).cast("double").alias("end"))),
    )
    bare = r.where("r.time_stamps IS NULL").select("doc_id", "_i", F.col("r.text").alias("_text"), F.posexplode(own).alias("_k", "s"))
    native = bare.select(
        "doc_id", F.col("_i").alias("_a"), (F.col("_k") + 1).alias("_b"), F.format_string("seg%06d-%03d", "_i", F.col("_k") + 1).alias("segment_id"),
        F.coalesce("s.text", F.when(F.col("_k") == 0, F.col("_text"))).alias("text"),
        seconds_to_ms(F.coalesce("s.start_time", "s.start")).alias("start_ms"), seconds_to_ms(F.coalesce("s.end_time", "s.end")).alias("end_ms"), F.array().cast("array<string>").alias("word_ids"),
    )
    segments = timed.unionByName(native).withColumn("seq", F.row_number().over(Window.partitionBy("doc_id").orderBy("_a", "_b"))).select("doc_id", "seq", "segment_id", "text", "start_ms", "end_ms", "word_ids")
    bad_item = lambda x: F.coalesce((x["start_time"] < 0) | (x["end_time"] < 0) | (x["start_time"] > x["end_time"]), F.lit(True)) | x["text"].isNull()
    short = lambda x: (x["start_time"] < x["end_time"]) & F.coalesce(seconds_to_ms(x["start_time"]) >= seconds_to_ms(x["end_time"]), F.lit(True))
    nothing = lambda x: F.coalesce(F.size(F.filter(x["time_stamps"], lambda y: y["start_time"] < y["end_time"])) == 0, F.lit(False)) & x["time_stamps"].isNotNull()
    untimed = lambda x: x["time_stamps"].isNull() & x["segments"].isNull() & (x["start_time"].isNull() | x["end_time"].isNull())
    no = F.lit(False)
    native_flags = native.groupBy("doc_id").agg(F.bool_or(F.coalesce(F.col("start_ms") >= F.col("end_ms"), F.lit(True)) | F.col("text").isNull()).alias("_native_bad"))
    languages = r.where(~T.is_blank(F.coalesce(F.col("r.language"), F.lit("")))).groupBy("doc_id").agg(T.strip(F.max_by("r.language", "_i")).alias("_language"))
    flags = raw.join(native_flags, "doc_id", "left").join(languages, "doc_id", "left").withColumn("_language", F.coalesce("_language", F.lit(language_hint)))
    failures = _failures(
        flags,
        {
            "no results": F.coalesce(F.size("results") == 0, F.lit(True)),
            "no timing": F.coalesce(F.exists("results", untimed), no),
            "bad aligned item": F.coalesce(F.exists("results", lambda x: F.coalesce(F.exists(x["time_stamps"], lambda y: bad_item(y) | short(y)), no)), no),
            "no timed items": F.coalesce(F.exists("results", nothing), no),
            "mixed timing": F.coalesce(F.exists("results", lambda x: x["time_stamps"].isNotNull()) & F.exists("results", lambda x: x["time_stamps"].isNull() & ~untimed(x)), no),
            "bad native segment": F.coalesce("_native_bad", no),
            "no native segment": F.coalesce(F.exists("results", lambda x: x["time_stamps"].isNull() & F.coalesce(F.size(x["segments"]) == 0, no) & x["segments"].isNotNull()), no),
            "missing text": F.coalesce(F.exists("results", lambda x: x["text"].isNull()), no),
            "no language": F.col("_language").isNull(),
        },
    )
    origin = F.when(F.exists("results", lambda x: x["time_stamps"].isNotNull()), F.lit("forced_alignment")).otherwise(F.lit("segment_native"))
    docs = flags.select("doc_id", F.col("_language").alias("language"), F.array_join(F.col("results.text"), "").alias("text"), origin.alias("timing_origin"), F.lit(provider).alias("provider"), F.lit(model_name).alias("model_name"))
    return Transcripts(docs, words.drop("segment"), segments).without(failures), failures


def glossary_table(spark: SparkSession, rows: Iterable[tuple[str, str | None, str | None]]) -> DataFrame:
    """ord, source, target, note in the given order; sources must be unique and not blank."""
    made = [(k, *r) for k, r in enumerate(rows, 1)]
    sources = [r[1] for r in made]
    if len(set(sources)) < len(sources) or any(not s or not s.strip() for s in sources):
        raise ValueError("glossary sources must be unique and not blank")
    return spark.createDataFrame(made, "ord int, source string, target string, note string")


def parse_model_responses(replies: DataFrame, kind: str = "updates") -> tuple[DataFrame, DataFrame]:
    """Strictly parsed replies (doc_id, batch_id, reply): rows, and failures (doc_id, batch_id, error_type).

    updates: {"items": [{"id", "text"}]} gives doc_id, batch_id, id, text; boundaries:
    {"break_after": [id]} gives doc_id, batch_id, piece_id. Other or missing keys, blank
    or repeated ids and empty contents spoil a reply.
    """
    if kind not in ("updates", "boundaries"):
        raise ValueError("kind must be updates or boundaries")
    field = "items" if kind == "updates" else "break_after"
    keys = F.json_object_keys("reply")
    parts = F.from_json("reply", f"{field} array<string>")[field]
    rows = replies.withColumns({"_keys": keys, "_parts": parts})
    good = F.coalesce((F.size("_keys") == 1) & (F.get("_keys", F.lit(0)) == field) & F.col("_parts").isNotNull() & ~F.exists("_parts", lambda x: x.isNull()), F.lit(False))
    if kind == "updates":
        rows = rows.withColumn("_items", F.transform("_parts", lambda x: F.from_json(x, "id string, text string")))
        strict = F.forall("_parts", lambda x: F.coalesce(F.array_sort(F.json_object_keys(x)) == F.array(F.lit("id"), F.lit("text")), F.lit(False)))
        solid = F.forall("_items", lambda x: F.coalesce(~T.is_blank(x["id"]) & ~T.is_blank(x["text"]), F.lit(False)))
        unique = F.size(F.array_distinct(F.col("_items.id"))) == F.size("_items")
        good &= F.coalesce(strict & solid & unique & (F.size("_items") > 0), F.lit(False))
        out = rows.where(good).select("doc_id", "batch_id", F.explode("_items").alias("_x")).select("doc_id", "batch_id", "_x.id", "_x.text")
    else:
        solid = F.forall("_parts", lambda x: ~T.is_blank(x)) & (F.size(F.array_distinct("_parts")) == F.size("_parts")) & (F.size("_parts") > 0)
        good &= F.coalesce(solid, F.lit(False))
        out = rows.where(good).select("doc_id", "batch_id", F.explode("_parts").alias("piece_id"))
    return out, rows.where(~good).select("doc_id", "batch_id", F.lit("StructuredOutputError").alias("error_type"))
