"""Summaries and audits of runs over stored stage tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def transcript_summary(docs: DataFrame, words: DataFrame, segments: DataFrame) -> DataFrame:
    """doc_id, language, timing_origin, provider, model_name, n_segments, n_words."""
    n_words = words.groupBy("doc_id").agg(F.count("*").alias("n_words"))
    n_segments = segments.groupBy("doc_id").agg(F.count("*").alias("n_segments"))
    joined = docs.join(n_segments, "doc_id", "left").join(n_words, "doc_id", "left")
    zero = F.lit(0)
    return joined.select("doc_id", "language", "timing_origin", "provider", "model_name", F.coalesce("n_segments", zero).alias("n_segments"), F.coalesce("n_words", zero).alias("n_words"))


def file_audit(cues: DataFrame, issues: DataFrame, summary: DataFrame, cue_docs: DataFrame, expected_origin: str = "asr_native") -> DataFrame:
    """Counts, warnings and violations of each document."""
    fell_back = F.exists("warnings", lambda w: w.startswith("segmentation_fallback") | w.startswith("correction_failed") | w.startswith("translation_failed"))
    per_doc = cues.groupBy("doc_id").agg(
        F.count("*").alias("cue_count"),
        F.count("corrected_text").alias("corrected_count"),
        F.count("translated_text").alias("translated_count"),
        F.bool_or(fell_back).alias("_fell"),
        F.sort_array(F.collect_list(F.struct("seq", "warnings"))).alias("_w"),
    )
    counts = issues.groupBy("doc_id").agg(F.count("*").alias("quality_issue_count"))
    joined = summary.join(per_doc, "doc_id", "left").join(counts, "doc_id", "left").join(cue_docs.select("doc_id", "target_language"), "doc_id", "left")
    zero, no = F.lit(0), F.lit(False)
    n = {c: F.coalesce(c, zero) for c in ("cue_count", "corrected_count", "translated_count", "quality_issue_count")}
    violations = F.array_compact(
        F.array(
            F.when(F.coalesce(F.col("timing_origin") != expected_origin, F.lit(True)), F.lit("unexpected timing origin")),
            F.when(F.col("n_words") == 0, F.lit("transcript contains no words")),
            F.when(n["corrected_count"] < n["cue_count"], F.lit("missing corrected text")),
            F.when(n["translated_count"] < n["cue_count"], F.lit("missing translated text")),
            F.when(F.coalesce("_fell", no), F.lit("a stage fell back")),
        )
    )
    warnings = F.coalesce(F.flatten(F.col("_w.warnings")), F.array().cast("array<string>"))
    return joined.select("doc_id", "target_language", *(v.alias(c) for c, v in n.items()), warnings.alias("warnings"), violations.alias("violations"))


def run_summary(runs: DataFrame) -> DataFrame:
    """run_id, n_inputs, n_results, n_failures, n_violations, ok, and all_ok over every run.

    runs: run_id, doc_id, succeeded, n_violations; one row for each input.
    """
    done = runs.groupBy("run_id").agg(
        F.count("*").alias("n_inputs"),
        F.count_if("succeeded").alias("n_results"),
        F.count_if(~F.col("succeeded")).alias("n_failures"),
        F.sum("n_violations").alias("n_violations"),
    )
    done = done.withColumn("ok", (F.col("n_failures") == 0) & (F.col("n_violations") == 0) & (F.col("n_results") == F.col("n_inputs")))
    every = done.agg(F.bool_and("ok").alias("all_ok"))
    return done.crossJoin(F.broadcast(every))  # a single row


def acceptance_gate(candidates: DataFrame, baselines: DataFrame) -> DataFrame:
    """model, accepted: error rate up by a point and a tenth at most, time by a twentieth; without a baseline never."""
    b = baselines.select("model", F.col("wer").alias("_wer"), F.col("seconds").alias("_seconds"))
    joined = candidates.join(b, "model", "left")
    fine = (F.col("wer") - F.col("_wer") <= 1.0) & (F.col("wer") <= F.col("_wer") * 1.1) & (F.col("seconds") <= F.col("_seconds") * 1.05)
    return joined.select("model", F.coalesce(fine, F.lit(False)).alias("accepted"))


def upsert_runs(old: DataFrame, new: DataFrame, key: str = "provider") -> DataFrame:
    """Rows of new, and those of old whose key new doesn't have."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def stage_order_check(events: DataFrame, stages: list[str]) -> DataFrame:
    """doc_id, stage, next_stage: where an event of a stage comes after the first event of the next one."""
    ordinal = F.array_position(F.array(*map(F.lit, stages)), F.col("stage"))
    spans = events.withColumn("_n", ordinal).where("_n > 0").groupBy("doc_id", "stage", "_n").agg(F.min("ts").alias("_first"), F.max("ts").alias("_last"))
    after = spans.select("doc_id", F.col("stage").alias("next_stage"), (F.col("_n") - 1).alias("_n"), F.col("_first").alias("_next"))
    met = spans.join(after, ["doc_id", "_n"])
    return met.where(F.col("_last") > F.col("_next")).select("doc_id", "stage", "next_stage")
