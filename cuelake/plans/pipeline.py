"""The whole way from transcripts, or from existing cues, to checked subtitles."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import check_quality
from ..operators.segmentation import segment, sentence_boundaries
from ..operators.stages import NativeFns, cleanup, content_context, correct, cue_texts, repair, translate
from ..operators.validation import quarantine, require_complete_translation, validate_cues, validate_origin, validate_segments, validate_words
from ..sources.sinks import render_formats, shared_folder, write_documents, write_run_tables, write_stage_tables
from ..sources.transcripts import Transcripts
from .options import Options


@dataclass
class PipelineResult:
    cues: DataFrame
    cue_docs: DataFrame
    issues: DataFrame
    contexts: DataFrame
    failures: DataFrame


class _Stages:
    """Stores stage tables, in workdir or else in the shared folder; each is a barrier and cuts the lineage."""

    def __init__(self, spark: SparkSession, workdir: str | None):
        self.workdir = workdir or f"{shared_folder(spark)}/stages-{uuid.uuid4().hex}"
        self.events: list[tuple[str, str, datetime]] = []

    def __call__(self, stage: str, table: DataFrame) -> DataFrame:
        self.events.append((stage, "started", datetime.now(UTC)))
        done = False
        try:
            out = write_stage_tables(stage, table, self.workdir)
            done = True
        finally:
            self.events.append((stage, "completed" if done else "failed", datetime.now(UTC)))
        return out


def _text_stages(cues: DataFrame, cue_docs: DataFrame, options: Options, fns: Any, glossary: DataFrame | None, keep: _Stages, contexts: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    if options.correction.enabled:
        c = options.correction
        cues = keep("corrected", correct(cues, fns, c.batch_size, options.max_change_ratio, how=c, contexts=contexts, glossary=glossary))
    if options.cleanup.enabled:
        cues = keep("cleaned", cleanup(cues, options.cleanup.fillers, options.cleanup.markers, options.cleanup.collapse))
    if options.translation.enabled:
        cues, cue_docs = translate(cues, cue_docs, options.target_language, fns, options.translation.batch_size, glossary, how=options.translation, contexts=contexts)
        cues = keep("translated", cues)
    issues = keep("quality", check_quality(cues, cue_docs, options.quality, glossary))
    if options.translation.enabled and options.repair.enabled:
        cues = keep("repaired", repair(cues, cue_docs, issues, options.target_language, fns, options.repair.batch_size, glossary, how=options.repair, contexts=contexts))
        issues = keep("quality_after_repair", check_quality(cues, cue_docs, options.quality, glossary))
    return cues, cue_docs, issues


def _finish(cues: DataFrame, cue_docs: DataFrame, issues: DataFrame, contexts: DataFrame, failures: DataFrame, options: Options) -> PipelineResult:
    if options.translation.enabled and not options.allow_partial:
        cues, partial = quarantine(cues, require_complete_translation(cues), "SubtitleValidationError", options.continue_on_error)
        gone = partial.select("doc_id")
        cue_docs, issues, contexts = (t.join(gone, "doc_id", "left_anti") for t in (cue_docs, issues, contexts))
        failures = failures.unionByName(partial)
    return PipelineResult(cues, cue_docs, issues, contexts, failures)


def run_pipeline(t: Transcripts, options: Options = Options(), fns: Any = None, chooser=sentence_boundaries, glossary: DataFrame | None = None, workdir: str | None = None, secrets: Sequence[str] = ()) -> PipelineResult:
    """Segments, corrects, cleans, translates, checks and repairs; bad documents become failures and the others go on.

    Stage tables, the run's options (secrets masked) and its stage events are stored in workdir, or else in the shared folder.
    """
    spark = t.docs.sparkSession
    fns, keep = fns or NativeFns(), _Stages(spark, workdir)
    try:
        # Read by the checks and by several steps after them.
        words, segments = keep("words", t.words), keep("segments", t.segments)
        violations = validate_words(words).unionByName(validate_segments(segments, words)).unionByName(validate_origin(t.docs, words))
        docs, failures = quarantine(t.docs, keep("violations", violations), "TranscriptionError", options.continue_on_error)
        docs = keep("docs", docs)
        good = docs.select("doc_id")
        words, segments = (x.join(good, "doc_id", "left_semi") for x in (words, segments))
        contexts = None
        if options.context_enabled:
            contexts = keep("contexts", content_context(docs.select("doc_id", "text"), fns, options.context_chars))
        s = options.segmentation
        limits = replace(options.limits, silence_ms=s.silence_ms)
        cues = keep("segmented", segment(words, segments, chooser, s.batch_tokens, s.overlap_tokens, limits, silence_ms=s.silence_ms, keep=keep))
        cue_docs = docs.select("doc_id", F.col("language").alias("source_language"), F.lit(None).cast("string").alias("target_language"))
        return _finish(*_text_stages(cues, cue_docs, options, fns, glossary, keep, contexts), _contexts_of(docs, contexts), failures, options)
    finally:
        write_run_tables(spark, keep.workdir, options, keep.events, secrets)


def refine(cues: DataFrame, cue_docs: DataFrame, options: Options = Options(), fns: Any = None, glossary: DataFrame | None = None, workdir: str | None = None, secrets: Sequence[str] = ()) -> PipelineResult:
    """The same from existing cues; no segmentation, times stay. A failing context leaves no warning here."""
    spark = cues.sparkSession
    fns, keep = fns or NativeFns(), _Stages(spark, workdir)
    try:
        cues = keep("cues", cues)
        good, failures = quarantine(cues, keep("violations", validate_cues(cues)), "SubtitleValidationError", options.continue_on_error)
        docs = cue_docs.join(failures.select("doc_id"), "doc_id", "left_anti")
        contexts = None
        if options.context_enabled:
            contexts = keep("contexts", content_context(cue_texts(good), fns, options.context_chars).withColumn("warnings", F.array().cast("array<string>")))
        return _finish(*_text_stages(good, docs, options, fns, glossary, keep, contexts), _contexts_of(docs, contexts), failures, options)
    finally:
        write_run_tables(spark, keep.workdir, options, keep.events, secrets)


def _contexts_of(docs: DataFrame, contexts: DataFrame | None) -> DataFrame:
    """The contexts; a table without rows if none were asked for."""
    if contexts is not None:
        return contexts
    none = F.lit("")
    return docs.where("false").select("doc_id", none.alias("summary"), none.alias("domain"), none.alias("tone"), F.array().cast("array<string>").alias("warnings"))


def write_outputs(result: PipelineResult, stems: DataFrame, out: str, options: Options = Options()) -> None:
    """One file for each document and format of options.output. stems: doc_id, stem."""
    o = options.output
    write_documents(render_formats(result.cues, result.cue_docs, stems, o.formats, o.bilingual), out, o.overwrite)


def refined_stem(stem: str) -> Any:
    """The output stem of a refined document, from the column named."""
    return F.concat(stem, F.lit(".refined"))
