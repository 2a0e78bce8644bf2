"""Batched text stages: correct, clean, translate, repair, with native or user functions."""

from __future__ import annotations

import random
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.sinks import shared_folder, write_stage_tables
from .quality import glossary_rows, select_repair_cues
from .replies import Replies

#: The style rules that each request carries.
STYLE_RULES = ("faithful", "concise", "subtitle-readable")
ITEM = "struct<id: string, text: string>"


class TransientError(Exception):
    """Raised by a user function when a retry may help."""


def split_batches(items: DataFrame, size: int) -> DataFrame:
    """Adds batch_id and pos: consecutive batches of `size` rows of each document, by seq."""
    if size < 1:
        raise ValueError("size must be positive")
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq")) - 1
    return items.withColumn("_n", n).withColumns({"batch_id": F.floor(F.col("_n") / size).cast("int"), "pos": (F.col("_n") % size).cast("int")}).drop("_n")


#: What a request says of its document, and one glossary entry in it.
CONTENT, ENTRY = "struct<summary: string, domain: string, tone: string>", "struct<source: string, target: string, note: string>"


def neighbour_context(batched: DataFrame, reach: int = 2, contexts: DataFrame | None = None, glossary: DataFrame | None = None) -> DataFrame:
    """doc_id, batch_id, items, before, after, style_rules, content, glossary: one row a batch with the items next to it.

    batched: doc_id, seq, batch_id, pos, id, text. content: the document's row of contexts, empty without one.
    """
    w = Window.partitionBy("doc_id").orderBy("seq")
    item = F.struct("id", "text")
    rows = batched.withColumns({"_before": F.collect_list(item).over(w.rowsBetween(-reach, -1)), "_after": F.collect_list(item).over(w.rowsBetween(1, reach))})
    grouped = rows.groupBy("doc_id", "batch_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "id", "text"))).alias("_items"),
        F.min_by("_before", "pos").alias("before"),
        F.max_by("_after", "pos").alias("after"),
    )
    fields = ("summary", "domain", "tone")
    none = F.struct(*(F.lit("").alias(c) for c in fields))
    if contexts is None:
        grouped = grouped.withColumn("content", none)
    else:
        content = contexts.select("doc_id", F.struct(*(F.coalesce(c, F.lit("")).alias(c) for c in fields)).alias("content"))
        grouped = grouped.join(content, "doc_id", "left").withColumn("content", F.coalesce("content", none))
    text = lambda x: F.lit(x).cast("string")
    entries = [F.struct(*(text(v).alias(c) for c, v in zip(("source", "target", "note"), e, strict=True))) for e in glossary_entries(glossary)]
    return grouped.select(
        "doc_id", "batch_id", F.transform("_items", lambda x: F.struct(x["id"].alias("id"), x["text"].alias("text"))).alias("items"), "before", "after",
        F.array(*map(F.lit, STYLE_RULES)).alias("style_rules"), "content", F.array(*entries).cast(f"array<{ENTRY}>").alias("glossary"),
    )


def with_retries(call: Callable[[], Any], retries: int, base_delay: float, max_delay: float) -> tuple[str | None, Any]:
    """The error's name, if it failed, and the result; TransientError is tried again."""
    for attempt in range(retries):
        try:
            return None, call()
        except TransientError as e:
            if attempt == retries - 1:
                return type(e).__name__, None
            time.sleep(min(max_delay, base_delay * 2**attempt) * random.uniform(0.5, 1.5))
        except Exception as e:  # noqa: BLE001  errors are data
            return type(e).__name__, None
    raise AssertionError


def transform_text(batches: DataFrame, make_fn: Callable[[], Callable[[list[dict], dict], dict[str, str]]], parallelism: int = 8, retries: int = 3, base_delay: float = 0.5, max_delay: float = 8.0, replies: str | None = None, kind: str = "") -> tuple[DataFrame, DataFrame]:
    """Calls a user function on each batch: updates (doc_id, batch_id, id, text) and outcomes (doc_id, batch_id, error_type).

    make_fn builds the function once for each partition, for example with a client.
    The function gets a batch's items and its context (before, after, style_rules, content,
    glossary) and returns texts by id. TransientError is tried again, with doubling
    delays; any exception becomes the batch's error and leaves the other batches alone.
    Each reply is stored as it comes, by its request and kind, in the folder replies, or else in a new one in the shared
    folder (``Replies``): a task that is lost is not paid for twice, and a later run with the same
    folder only calls for what is missing. So a function that has changed needs another kind or folder.
    At most parallelism calls run at once.
    """
    if not 1 <= parallelism <= 100 or not 1 <= retries <= 10:
        raise ValueError("parallelism must be from 1 to 100 and retries from 1 to 10")
    schema = f"{batches.schema['doc_id'].dataType.simpleString()}"
    folder = replies or replies_folder(batches.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn, known = make_fn(), Replies(folder, kind)
        for frame in frames:
            out: list[dict[str, Any]] = []
            for r in frame.to_dict("records"):
                items = [dict(x) for x in r["items"]]
                context = {c: [dict(x) for x in r[c]] for c in ("before", "after", "glossary")} | {"style_rules": list(r["style_rules"]), "content": dict(r["content"])}
                error, found = with_retries(lambda: known.get([items, context], lambda: {str(k): str(v) for k, v in dict(fn(items, context)).items()}), retries, base_delay, max_delay)
                texts = found or {}
                out.append({"doc_id": r["doc_id"], "batch_id": r["batch_id"], "error_type": error, "ids": list(texts), "texts": list(texts.values())})
            yield pd.DataFrame(out, columns=["doc_id", "batch_id", "error_type", "ids", "texts"])

    called = batches.repartition(parallelism, "doc_id", "batch_id").mapInPandas(run, f"doc_id {schema}, batch_id int, error_type string, ids array<string>, texts array<string>")
    called = write_stage_tables(f"replies-{uuid.uuid4().hex}", called, shared_folder(batches.sparkSession))
    updates = called.select("doc_id", "batch_id", F.explode(F.arrays_zip("ids", "texts")).alias("_u")).select("doc_id", "batch_id", F.col("_u.ids").alias("id"), F.col("_u.texts").alias("text"))
    return updates, called.select("doc_id", "batch_id", "error_type")


def replies_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/calls-{uuid.uuid4().hex}"


def guard_correction(source: Column, corrected: Column, max_change_ratio: float = 0.5) -> Column:
    """True where a correction keeps protected spans and scripts and changes little enough."""
    kept = F.forall(T.protected_spans(source), lambda x: F.contains(corrected, x))
    cjk = ~T.has_cjk_strict(source) | T.has_cjk_strict(corrected)
    latin = ~source.rlike("[A-Za-z]") | corrected.rlike("[A-Za-z]")
    return kept & cjk & latin & T.changed_at_most(source, corrected, max_change_ratio)


def validate_updates(requests: DataFrame, updates: DataFrame, outcomes: DataFrame | None = None, max_change_ratio: float | None = None) -> DataFrame:
    """doc_id, batch_id, valid, error_type of every requested batch; one bad item spoils its batch.

    requests: doc_id, batch_id, id, text. updates: doc_id, batch_id, id, text.
    """
    keys = ["doc_id", "batch_id", "id"]
    asked = requests.select(*keys, F.col("text").alias("_old"), F.lit(1).alias("_asked"))
    got = updates.groupBy(*keys).agg(F.min("text").alias("_new"), F.count("*").alias("_n"))
    met = asked.join(got, keys, "full_outer")
    good = F.col("_asked").isNotNull() & (F.col("_n") == 1) & ~T.is_blank(F.col("_new"))
    if max_change_ratio is not None:
        good &= guard_correction(F.col("_old"), F.col("_new"), max_change_ratio)
    state = met.groupBy("doc_id", "batch_id").agg(F.bool_and(F.coalesce(good, F.lit(False))).alias("_good"), F.max("_asked").alias("_asked"))
    state = state.where("_asked = 1").select("doc_id", "batch_id", "_good")
    if outcomes is not None:
        state = state.join(outcomes.select("doc_id", "batch_id", F.col("error_type").alias("_error")), ["doc_id", "batch_id"], "left")
    else:
        state = state.withColumn("_error", F.lit(None).cast("string"))
    error = F.coalesce("_error", F.when(~F.col("_good"), F.lit("ValidationError")))
    return state.select("doc_id", "batch_id", error.isNull().alias("valid"), error.alias("error_type"))


def collect_outcomes(requests: DataFrame, updates: DataFrame, stage: str, outcomes: DataFrame | None = None, max_change_ratio: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Updates of good batches (doc_id, id, text), and a warning for each id of the bad ones (doc_id, id, warning)."""
    state = validate_updates(requests, updates, outcomes, max_change_ratio)
    values = updates.join(state.where("valid").select("doc_id", "batch_id"), ["doc_id", "batch_id"], "left_semi").select("doc_id", "id", "text")
    bad = requests.join(state.where("NOT valid"), ["doc_id", "batch_id"])
    return values, bad.select("doc_id", "id", F.concat(F.lit(f"{stage}_failed:"), "error_type").alias("warning"))


def apply_text_stage(cues: DataFrame, values: DataFrame, warnings: DataFrame, column: str) -> DataFrame:
    """Merges new texts into a column of cues and appends warnings; times and other cues stay."""
    new = values.select("doc_id", F.col("id").alias("cue_id"), F.col("text").alias("_new"))
    more = warnings.select("doc_id", F.col("id").alias("cue_id"), F.col("warning").alias("_warning"))
    joined = cues.join(new, ["doc_id", "cue_id"], "left").join(more, ["doc_id", "cue_id"], "left")
    out = joined.withColumns({column: F.coalesce("_new", column), "warnings": F.when(F.col("_warning").isNotNull(), F.concat("warnings", F.array("_warning"))).otherwise(F.col("warnings"))})
    return out.select(*cues.columns)


class NativeFns:
    """Deterministic stage functions as column expressions, so that a pipeline without user functions stays in the JVM.

    fail_stage names a stage all of whose batches fail.
    """

    #: The one word that the default correction replaces.
    WRONG, RIGHT = "错误", "正确"

    def __init__(self, fail_stage: str | None = None):
        self.fail_stage = fail_stage

    def correction(self, text: Column, target: str | None) -> Column:
        return F.replace(T.strip(text), F.lit(self.WRONG), F.lit(self.RIGHT))

    def translation(self, text: Column, target: str | None) -> Column:
        return F.concat(F.lit(f"[{target}] "), T.strip(text))

    repair = translation

    def contexts(self, texts: DataFrame) -> DataFrame:
        """doc_id, summary, domain, tone, error_type."""
        failed = F.lit("PermanentError" if self.fail_stage == "context" else None).cast("string")
        values = (F.substring(T.strip(F.col("text")), 1, 120).alias("summary"), F.lit("test").alias("domain"), F.lit("neutral").alias("tone"))
        return texts.select("doc_id", *values, failed.alias("error_type"))

    def outcomes(self, requests: DataFrame, stage: str, target: str | None, how: Any = None, contexts: DataFrame | None = None, glossary: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        failed = F.lit("PermanentError" if self.fail_stage == stage else None).cast("string")
        done = requests.select("doc_id", "batch_id").distinct().withColumn("error_type", failed)
        return requests.select("doc_id", "batch_id", "id", getattr(self, stage)(F.col("text"), target).alias("text")), done


def default_text_fns(fail_stage: str | None = None) -> NativeFns:
    return NativeFns(fail_stage)


class UserFns:
    """Stage functions by user code.

    make: correction, translation, repair to a factory of (items, context) functions, as
    transform_text takes it; context, if there is one, to a factory of a function from a
    text to a summary, a domain and a tone by name. Stages' own options go before
    parallelism and retries. replies: a folder of stored replies to go on from (transform_text).
    """

    def __init__(self, make: dict[str, Callable[[], Callable]], parallelism: int = 8, retries: int = 3, replies: str | None = None):
        self.make, self.parallelism, self.retries, self.replies = make, parallelism, retries, replies

    def contexts(self, texts: DataFrame) -> DataFrame:
        """doc_id, summary, domain, tone, error_type; each text is given to the function once, and the replies are stored."""
        kind, make, retries = texts.schema["doc_id"].dataType.simpleString(), self.make.get("context"), self.retries
        if make is None:
            none = F.lit("")
            return texts.select("doc_id", none.alias("summary"), none.alias("domain"), none.alias("tone"), F.lit(None).cast("string").alias("error_type"))
        names, folder = ["summary", "domain", "tone"], self.replies or replies_folder(texts.sparkSession)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            fn, known = make(), Replies(folder, "context")
            for frame in frames:
                out = []
                for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                    error, found = with_retries(lambda text=text: known.get(text, lambda: {c: str(dict(x).get(c) or "") for x in [fn(text)] for c in names}), retries, 0.5, 8.0)
                    out.append((doc_id, *((found or {}).get(c, "") for c in names), error))
                yield pd.DataFrame(out, columns=["doc_id", *names, "error_type"])

        called = texts.select("doc_id", "text").repartition(self.parallelism, "doc_id").mapInPandas(run, f"doc_id {kind}, summary string, domain string, tone string, error_type string")
        return write_stage_tables(f"contexts-{uuid.uuid4().hex}", called, shared_folder(texts.sparkSession))

    def outcomes(self, requests: DataFrame, stage: str, target: str | None, how: Any = None, contexts: DataFrame | None = None, glossary: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        if stage not in self.make:
            raise ValueError(f"no user function for the stage {stage}")
        batches = neighbour_context(requests, contexts=contexts, glossary=glossary)
        stored = {"replies": self.replies, "kind": f"{stage} {target}"}
        if how is None:
            return transform_text(batches, self.make[stage], self.parallelism, self.retries, **stored)
        return transform_text(batches, self.make[stage], how.parallelism, how.retries, how.base_delay, how.max_delay, **stored)


def user_chooser(make: Callable[[], Callable], parallelism: int = 4, retries: int = 3, replies: str | None = None) -> Callable[[DataFrame], tuple[DataFrame, DataFrame]]:
    """A chooser for segment() by user code: the function gets a window's tokens (id, text, gap_after_ms) and returns the ids after which to cut.

    A window whose call fails has an error in the outcomes and gets the rules' boundaries.
    """

    def choose(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
        kind, window = windows.schema["doc_id"].dataType.simpleString(), windows.schema["window_id"].dataType.simpleString()
        tokens = F.sort_array(F.collect_list(F.struct("seq", F.col("piece_id").alias("id"), "text", "gap_after_ms")))
        rows = windows.groupBy("doc_id", "window_id").agg(tokens.alias("tokens"))
        folder = replies or replies_folder(windows.sparkSession)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            fn, known = make(), Replies(folder, "choice")
            for frame in frames:
                out = []
                for r in frame.to_dict("records"):
                    own = [{c: x[c] for c in ("id", "text", "gap_after_ms")} for x in r["tokens"]]
                    error, found = with_retries(lambda own=own: known.get(own, lambda: [str(x) for x in fn(own)]), retries, 0.5, 8.0)
                    out.append((r["doc_id"], r["window_id"], error, found or []))
                yield pd.DataFrame(out, columns=["doc_id", "window_id", "error_type", "ids"])

        called = rows.repartition(parallelism, "doc_id", "window_id").mapInPandas(run, f"doc_id {kind}, window_id {window}, error_type string, ids array<string>")
        called = write_stage_tables(f"choices-{uuid.uuid4().hex}", called, shared_folder(windows.sparkSession))
        return called.select("doc_id", "window_id", F.explode("ids").alias("piece_id")), called.select("doc_id", "window_id", "error_type")

    return choose


def requests_of(cues: DataFrame, text: Column, size: int) -> DataFrame:
    """doc_id, seq, batch_id, pos, id, text."""
    return split_batches(cues.select("doc_id", "seq", F.col("cue_id").alias("id"), text.alias("text")), size)


def _best() -> Column:
    return T.best_text(F.col("corrected_text"), F.col("source_text"))


def correct(cues: DataFrame, fns: Any = None, batch_size: int = 30, max_change_ratio: float = 0.5, **request: Any) -> DataFrame:
    """Fills corrected_text of the batches whose corrections are sound. request: how, contexts and glossary for user functions."""
    requests = requests_of(cues, F.col("source_text"), batch_size)
    updates, outcomes = (fns or NativeFns()).outcomes(requests, "correction", None, **request)
    return apply_text_stage(cues, *collect_outcomes(requests, updates, "correction", outcomes, max_change_ratio), "corrected_text")


def cleanup(cues: DataFrame, fillers: Sequence[str] = (), markers: Sequence[str] = (), collapse: bool = False) -> DataFrame:
    """Removes fillers and markers, optionally repeated words; a blank result keeps the cue and adds a warning."""
    text = _best()
    for item in (*fillers, *markers):
        if item.strip():
            text = F.replace(text, F.lit(item), F.lit(""))
    if collapse:
        text = F.regexp_replace(text, r"(?U)\b(\w+)(?:\s+\1){1,}\b", "$1")
    cleaned = cues.withColumn("_clean", T.squeeze(text))
    blank = F.length("_clean") == 0
    return cleaned.withColumns(
        {"corrected_text": F.when(blank, F.col("corrected_text")).otherwise(F.col("_clean")), "warnings": F.when(blank, F.concat("warnings", F.array(F.lit("cleanup_skipped:blank")))).otherwise(F.col("warnings"))}
    ).select(*cues.columns)


def glossary_entries(glossary: DataFrame | None) -> list[tuple[str, str | None, str | None]]:
    return [(r.source, r.target, r.note) for r in glossary_rows(glossary)]


def apply_glossary(text: Column, glossary: DataFrame | None) -> Column:
    return T.replace_all(text, [(r.source, r.target) for r in glossary_rows(glossary)])


def _translated(values: DataFrame, glossary: DataFrame | None) -> DataFrame:
    return values.withColumn("text", apply_glossary(F.col("text"), glossary))


def translate(cues: DataFrame, cue_docs: DataFrame, target: str, fns: Any = None, batch_size: int = 30, glossary: DataFrame | None = None, allow_partial: bool = True, **request: Any) -> tuple[DataFrame, DataFrame]:
    """Fills translated_text from the best text and sets each document's target language."""
    requests = requests_of(cues, _best(), batch_size)
    updates, outcomes = (fns or NativeFns()).outcomes(requests, "translation", target, glossary=glossary, **request)
    values, warnings = collect_outcomes(requests, updates, "translation", outcomes)
    if not allow_partial and not warnings.isEmpty():
        raise ValueError("a translation failed and partial output is off")
    return apply_text_stage(cues, _translated(values, glossary), warnings, "translated_text"), cue_docs.withColumn("target_language", F.lit(target))


def repair(cues: DataFrame, cue_docs: DataFrame, issues: DataFrame | None, target: str, fns: Any = None, batch_size: int = 20, glossary: DataFrame | None = None, **request: Any) -> DataFrame:
    """Translates cues with repairable issues once more, from the best text; failures keep the old text and add a warning."""
    requests = requests_of(select_repair_cues(cues, cue_docs, issues), _best(), batch_size)
    updates, outcomes = (fns or NativeFns()).outcomes(requests, "repair", target, glossary=glossary, **request)
    values, warnings = collect_outcomes(requests, updates, "repair", outcomes)
    return apply_text_stage(cues, _translated(values, glossary), warnings, "translated_text")


def truncate_text(text: Column, limit: int) -> Column:
    return F.substring(text, 1, limit)


def content_context(texts: DataFrame, fns: Any = None, limit: int = 50_000) -> DataFrame:
    """doc_id, summary, domain, tone, warnings of each document's text (doc_id, text), cut at limit characters.

    A failing context function gives an empty context and a warning.
    """
    cut = texts.select("doc_id", truncate_text(F.col("text"), limit).alias("text"))
    long = texts.select("doc_id", (F.length("text") > limit).alias("_long"))
    found = (fns or NativeFns()).contexts(cut).join(long, "doc_id")
    failed = F.col("error_type").isNotNull()
    fields = [F.when(failed, F.lit("")).otherwise(F.coalesce(c, F.lit(""))).alias(c) for c in ("summary", "domain", "tone")]
    warnings = F.array(F.when(F.col("_long"), F.lit("context_analysis_truncated")), F.when(failed, F.concat(F.lit("context_analysis_fallback:"), "error_type")))
    return found.select("doc_id", *fields, F.array_compact(warnings).alias("warnings"))


def cue_texts(cues: DataFrame) -> DataFrame:
    """doc_id, text: each document's texts in order, the corrected ones where there are any, joined by spaces."""
    grouped = cues.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", _best().alias("text")))).alias("_t"))
    return grouped.select("doc_id", F.array_join(F.col("_t.text"), " ").alias("text"))


def restore_order(results: DataFrame) -> DataFrame:
    """doc_id, texts: the texts of finished batches in request order, whatever order they came in."""
    grouped = results.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("batch_id", "pos", "text"))).alias("_t"))
    return grouped.select("doc_id", F.col("_t.text").alias("texts"))


def missing_items(source: Column, translated: Column) -> Column:
    """Number tokens of the source that the translation lacks, sorted."""
    return F.array_sort(F.array_except(T.number_tokens(source), T.number_tokens(translated)))
