"""Rendering of subtitles and writing of one file for each document."""

from __future__ import annotations

import contextlib
import json
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import asdict
from datetime import datetime
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.timecode import fmt_srt_ts, fmt_vtt_ts

SUFFIXES = {"srt": ".srt", "vtt": ".vtt", "json": ".subtitle.json", "bilingual_srt": ".bilingual.srt"}


def _lines(text: Column, limit: int | None, max_lines: int) -> Column:
    return T.split_lines(text) if limit is None else T.wrap_text(text, limit, max_lines)


def _blocks(cues: DataFrame, stamp, bilingual: bool, limit: int | None, max_lines: int) -> DataFrame:
    lines = _lines(T.best_text(F.col("corrected_text"), F.col("source_text")), limit, max_lines)
    if bilingual:
        there = F.length(F.coalesce("translated_text", F.lit(""))) > 0
        lines = F.concat(lines, F.when(there, _lines(F.col("translated_text"), limit, max_lines)).otherwise(F.array().cast("array<string>")))
    times = F.concat(stamp(F.col("start_ms")), F.lit(" --> "), stamp(F.col("end_ms")))
    rows = cues.select("doc_id", "seq", F.concat_ws("\n", times, lines).alias("_block"))
    grouped = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "_block"))).alias("_b"))
    return grouped.select("doc_id", F.transform(F.col("_b._block"), lambda b, k: F.concat((k + 1).cast("string"), F.lit("\n"), b)).alias("_blocks"))


def _with_empty(rendered: DataFrame, docs: DataFrame | None, body: str) -> DataFrame:
    if docs is None:
        return rendered
    return docs.select("doc_id").join(rendered, "doc_id", "left").select("doc_id", F.coalesce("body", F.lit(body)).alias("body"))


def render_srt(cues: DataFrame, bilingual: bool = True, max_line_chars: int | None = None, max_lines: int = 2, docs: DataFrame | None = None) -> DataFrame:
    """doc_id, body. docs adds documents without cues, whose body is empty."""
    made = _blocks(cues, fmt_srt_ts, bilingual, max_line_chars, max_lines)
    return _with_empty(made.select("doc_id", F.concat(F.array_join("_blocks", "\n\n"), F.lit("\n")).alias("body")), docs, "")


def render_vtt(cues: DataFrame, bilingual: bool = True, max_line_chars: int | None = None, max_lines: int = 2, docs: DataFrame | None = None) -> DataFrame:
    made = _blocks(cues, fmt_vtt_ts, bilingual, max_line_chars, max_lines)
    return _with_empty(made.select("doc_id", F.concat(F.lit("WEBVTT\n\n"), F.array_join("_blocks", "\n\n"), F.lit("\n")).alias("body")), docs, "WEBVTT\n")


def render_subtitle_json(cues: DataFrame, cue_docs: DataFrame) -> DataFrame:
    """doc_id, body: canonical JSON with nulls kept."""
    cue = F.struct("seq", F.col("cue_id").alias("id"), "start_ms", "end_ms", "source_text", "corrected_text", "translated_text", "source_word_ids", "warnings")
    grouped = cues.groupBy("doc_id").agg(F.sort_array(F.collect_list(cue)).alias("_c"))
    joined = cue_docs.join(grouped, "doc_id", "left")
    fields = ("id", "start_ms", "end_ms", "source_text", "corrected_text", "translated_text", "source_word_ids", "warnings")
    plain = F.transform("_c", lambda c: F.struct(*(c[f].alias(f) for f in fields)))
    body = F.struct(F.lit("subtitle.v1").alias("schema_version"), "source_language", "target_language", F.coalesce(plain, F.array_except(plain, plain), F.from_json(F.lit("[]"), "array<struct<id: string, start_ms: bigint, end_ms: bigint, source_text: string, corrected_text: string, translated_text: string, source_word_ids: array<string>, warnings: array<string>>>")).alias("cues"))
    return joined.select("doc_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("body"))


def render_transcript_json(docs: DataFrame, words: DataFrame, segments: DataFrame) -> DataFrame:
    """doc_id, body: canonical transcript JSON."""
    w = words.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", F.col("word_id").alias("id"), "text", "start_ms", "end_ms", "confidence"))).alias("_w"))
    s = segments.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", F.col("segment_id").alias("id"), "text", "start_ms", "end_ms", "word_ids"))).alias("_s"))
    pick = lambda name, fields: F.transform(name, lambda x: F.struct(*(x[f].alias(f) for f in fields)))
    some_words = pick("_w", ("id", "text", "start_ms", "end_ms", "confidence"))
    some_segments = pick("_s", ("id", "text", "start_ms", "end_ms", "word_ids"))
    empty_words = F.from_json(F.lit("[]"), "array<struct<id: string, text: string, start_ms: bigint, end_ms: bigint, confidence: double>>")
    empty_segments = F.from_json(F.lit("[]"), "array<struct<id: string, text: string, start_ms: bigint, end_ms: bigint, word_ids: array<string>>>")
    body = F.struct(
        F.lit("transcript.v1").alias("schema_version"), "language", "text", "timing_origin",
        F.coalesce(some_words, empty_words).alias("words"), F.coalesce(some_segments, empty_segments).alias("segments"), "provider", "model_name",
    )
    return docs.join(w, "doc_id", "left").join(s, "doc_id", "left").select("doc_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("body"))


#: Where files stand until all of a write are done: a hidden folder of the output folder, one for each write.
STAGING = ".cuelake-staging"


def write_documents(rendered: DataFrame, out: str, overwrite: str = "error") -> None:
    """One file for each row of rendered (rel_path, body) under a mounted folder, all or none; overwrite: error or replace.

    First all paths are checked: paths that leave the folder, two documents with one path
    (however written), and files that are there already (for error) stop the whole. Then
    tasks write all bodies under temporary names in a hidden folder, and their names become a manifest, a table that
    is there whole or not at all; if that fails, the folder goes and no file has appeared. Only
    then do tasks give the files their names. If that is cut short, the manifest is still there, and the next
    write to the folder, or ``finish_documents``, ends it first.
    """
    if overwrite not in ("error", "replace"):
        raise ValueError("overwrite must be error or replace")
    spark, root = rendered.sparkSession, os.path.normpath(out)
    finish_documents(spark, out)
    rows = write_stage_tables(f"rendered-{uuid.uuid4().hex}", rendered.select("rel_path", "body"), shared_folder(spark))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths, bad = [], []
            for rel_path in b.column("rel_path").to_pylist():
                final = os.path.normpath(os.path.join(root, rel_path or ""))
                inside = final.startswith(root + os.sep) and not final.startswith(os.path.join(root, STAGING))
                paths.append(final)
                bad.append(f"path leaves the output folder: {rel_path}" if not inside else f"output exists: {final}" if overwrite == "error" and os.path.exists(final) else None)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(bad, pa.string())], ["path", "message"])

    checked = rows.select("rel_path").mapInArrow(check, "path string, message string")
    checked = write_stage_tables(f"checked-{uuid.uuid4().hex}", checked, shared_folder(spark))
    twice = checked.groupBy("path").count().where("count > 1").select(F.concat(F.lit("two documents have one output path: "), "path").alias("message"))
    first = checked.where("message IS NOT NULL").select("message").union(twice).orderBy("message").first()
    if first is not None:
        raise (FileExistsError if first.message.startswith("output exists") else ValueError)(first.message)

    staging = os.path.join(root, STAGING, uuid.uuid4().hex)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # An attempt has a folder of its own; what a failed one leaves is in no manifest.
        own = os.path.join(staging, "files", uuid.uuid4().hex)
        os.makedirs(own)
        n = 0
        for b in batches:
            temporary, final = [], []
            # Bodies go from the batch to their files as they are, UTF-8 already.
            for rel_path, body in zip(b.column("rel_path").to_pylist(), b.column("body"), strict=True):
                temporary.append(os.path.join(own, str(n)))
                final.append(os.path.normpath(rel_path))
                n += 1
                with open(temporary[-1], "wb") as f:
                    f.write(body.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array(temporary, pa.string()), pa.array(final, pa.string())], ["temporary", "rel_path"])

    try:
        with bodies_in_a_batch(spark):
            rows.mapInArrow(write, "temporary string, rel_path string").write.parquet(os.path.join(staging, MANIFEST))
    except BaseException:
        remove_staging(root, staging)
        raise
    finish_documents(spark, out)


#: So many bodies are in a Python worker at once, whatever the session's batches are.
BODIES, BATCH_ROWS = 64, "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextlib.contextmanager
def bodies_in_a_batch(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, str(min(BODIES, int(before)) if int(before) > 0 else BODIES))
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


#: A manifest counts once Spark has marked it complete.
MANIFEST, COMPLETE = "manifest", "_SUCCESS"


def finish_documents(spark: SparkSession, out: str) -> int:
    """Gives the files of complete manifests under out their names; the number of manifests. May be run again, also by several at once."""
    root = os.path.normpath(out)
    folder = os.path.join(root, STAGING)
    staged = [os.path.join(folder, x) for x in sorted(os.listdir(folder))] if os.path.isdir(folder) else []
    staged = [x for x in staged if os.path.exists(os.path.join(x, MANIFEST, COMPLETE))]

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for temporary, rel_path in zip(b.column("temporary").to_pylist(), b.column("rel_path").to_pylist(), strict=True):
                final = os.path.join(root, rel_path)
                os.makedirs(os.path.dirname(final), exist_ok=True)
                try:
                    os.replace(temporary, final)
                except FileNotFoundError:
                    # Named by an earlier attempt.
                    if not os.path.exists(final):
                        raise
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    for staging in staged:
        names = spark.read.schema("temporary string, rel_path string").parquet(os.path.join(staging, MANIFEST))
        names.mapInArrow(rename, "n bigint").agg(F.sum("n")).first()
        remove_staging(root, staging)
    return len(staged)


def remove_staging(root: str, staging: str) -> None:
    shutil.rmtree(staging, ignore_errors=True)
    for empty in (os.path.dirname(staging), root):
        with contextlib.suppress(OSError):  # others write there, or files are in it
            os.rmdir(empty)


def render_formats(cues: DataFrame, cue_docs: DataFrame, stems: DataFrame, formats: Sequence[str] = ("srt", "json"), bilingual: bool = True, max_line_chars: int | None = None, max_lines: int = 2) -> DataFrame:
    """rel_path, body of each document and format. stems: doc_id, stem (relative path without suffix)."""
    if not formats or len(set(formats)) < len(formats) or not set(formats) <= set(SUFFIXES):
        raise ValueError("formats must be different ones of " + ", ".join(SUFFIXES))
    made = {
        "srt": lambda: render_srt(cues, bilingual, max_line_chars, max_lines, cue_docs),
        "vtt": lambda: render_vtt(cues, bilingual, max_line_chars, max_lines, cue_docs),
        "json": lambda: render_subtitle_json(cues, cue_docs),
        "bilingual_srt": lambda: render_srt(cues, True, max_line_chars, max_lines, cue_docs),
    }
    out = None
    for f in formats:
        part = made[f]().join(stems, "doc_id").select(F.concat("stem", F.lit(SUFFIXES[f])).alias("rel_path"), "body")
        out = part if out is None else out.unionByName(part)
    return out


def write_transcripts(docs: DataFrame, words: DataFrame, segments: DataFrame, stems: DataFrame, out: str, overwrite: str = "error") -> None:
    body = render_transcript_json(docs, words, segments).join(stems, "doc_id")
    write_documents(body.select(F.concat("stem", F.lit(".transcript.json")).alias("rel_path"), "body"), out, overwrite)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; only a local session may do without (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


#: With this setting Spark deletes a query's shuffle files once the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_stage_tables(stage: str, table: DataFrame, workdir: str) -> DataFrame:
    """Stores a stage's table and reads it back, which also cuts its lineage; its shuffle files go at once."""
    path, conf = f"{workdir}/{stage}", table.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        table.write.mode("overwrite").option("compression", "zstd").parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def write_run_tables(spark: SparkSession, workdir: str, options: Any, events: Sequence[tuple[str, str, datetime]], secrets: Sequence[str] = ()) -> None:
    """Stores the tables run (options as JSON, secrets masked) and events (stage, status, ts) beside the stage tables."""
    body = json.dumps(asdict(options), ensure_ascii=False, sort_keys=True)
    run = spark.createDataFrame([(body,)], "options string").select(T.redact(F.col("options"), secrets).alias("options"))
    run.write.mode("overwrite").parquet(f"{workdir}/run")
    spark.createDataFrame(list(events), "stage string, status string, ts timestamp").coalesce(1).write.mode("overwrite").parquet(f"{workdir}/events")
