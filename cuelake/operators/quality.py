"""Readability and completeness checks of cues, one row for each issue."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Codes that a repair can mend.
REPAIRABLE = (
    "empty_translation",
    "translation_missing",
    "translation_unchanged",
    "number_missing",
    "protected_content_missing",
    "glossary_missing",
    "translation_too_long",
    "target_language_unexpected",
)


@dataclass(frozen=True)
class QualityOptions:
    min_duration_ms: int = 700
    max_duration_ms: int = 7_000
    max_cps: float = 17.0
    max_line_chars: int = 42
    max_lines: int = 2
    max_chars_cjk: int = 24
    max_words_latin: int = 14

    def __post_init__(self):
        if self.max_duration_ms < self.min_duration_ms or self.min_duration_ms < 0:
            raise ValueError("durations must be from 0 and in order")
        if min(self.max_cps, self.max_line_chars, self.max_lines, self.max_chars_cjk, self.max_words_latin) <= 0:
            raise ValueError("limits must be positive")


def glossary_rows(glossary: DataFrame | None) -> list[Row]:
    """The ordered glossary; it is configuration, refused above 10,000 entries."""
    if glossary is None:
        return []
    rows = glossary.orderBy("ord").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("a glossary has 10,000 entries at most")
    return rows


def first_term(glossary: DataFrame | None) -> Column:
    """The first glossary entry's source, by ord, that is in the best text and whose target isn't in the translation."""
    rows = [(r.source, r.target) for r in glossary_rows(glossary) if r.target is not None]
    best = T.best_text(F.col("corrected_text"), F.col("source_text"))
    if len(rows) > T.FOLDED:
        return first_of_many(rows)(best, F.col("translated_text"))
    terms = [F.struct(F.lit(a).alias("source"), F.lit(b).alias("target")) for a, b in rows]
    if not terms:
        return F.lit(None).cast("string")
    missed = F.filter(F.array(*terms), lambda x: F.contains(best, x["source"]) & ~F.contains(F.col("translated_text"), x["target"]))
    return F.get(missed, F.lit(0))["source"]


def first_of_many(rows: list[tuple[str, str]]) -> Callable[[Column, Column], Column]:
    """first_term() by an automaton over all sources, which only asks for the targets of those that occur."""

    @F.pandas_udf("string")
    def first(best: pd.Series, translated: pd.Series) -> pd.Series:
        find = T.occurring([a for a, _ in rows])

        def one(text: str | None, other: str | None) -> str | None:
            if text is None or other is None:
                return None
            return next((rows[n][0] for n in sorted(find(text)) if rows[n][1] not in other), None)

        return pd.Series([one(a, b) for a, b in zip(best, translated, strict=True)], dtype=object)

    return first


def glossary_match(cues: DataFrame, glossary: DataFrame) -> DataFrame:
    """doc_id, seq, source: cues with the glossary entry that first_term() finds; the entries are one literal, no join."""
    return cues.select("doc_id", "seq", first_term(glossary).alias("source")).where("source IS NOT NULL")


def _issue(order: int, code: str, severity: str, when: Column, message: Column | str, measured: Column | None = None, label: Column | None = None, place: Column | None = None) -> Column:
    zero = F.lit(0)
    return F.when(
        when,
        F.struct(
            F.struct(F.lit(order).alias("rule"), (zero if place is None else place).cast("int").alias("place")).alias("ord"),
            F.lit(code).alias("code"),
            F.lit(severity).alias("severity"),
            (F.lit(None) if label is None else label).cast("string").alias("label"),
            (F.lit(None) if measured is None else measured).cast("double").alias("measured"),
            (F.lit(message) if isinstance(message, str) else message).alias("message"),
        ),
    )


def check_quality(cues: DataFrame, cue_docs: DataFrame, options: QualityOptions = QualityOptions(), glossary: DataFrame | None = None) -> DataFrame:
    """doc_id, seq, cue_id, issue_ord, code, severity, label, measured, message.

    Works on unvalidated rows, so that blank texts and overlaps are found too.
    """
    o = options
    rows = cues.select("doc_id", "seq", "cue_id", "start_ms", "end_ms", "source_text", "corrected_text", "translated_text")
    w = Window.partitionBy("doc_id").orderBy("seq")
    rows = rows.withColumns({"_before": F.lag("end_ms").over(w), "_before_id": F.lag("cue_id").over(w)})
    rows = rows.join(cue_docs.select("doc_id", "target_language"), "doc_id", "left")
    rows = rows.withColumn("_term", first_term(glossary))
    src, cor, tra, target = (F.col(c) for c in ("source_text", "corrected_text", "translated_text", "target_language"))
    has_target = F.coalesce(F.length(target) > 0, F.lit(False))
    checked = has_target & F.coalesce(F.length(tra) > 0, F.lit(False))
    best, duration = T.best_text(cor, src), F.col("end_ms") - F.col("start_ms")
    numbers_gone = F.size(F.array_except(T.number_tokens(best), T.number_tokens(tra))) > 0
    lost = F.exists(T.protected_spans(best, corrections=False), lambda x: ~F.contains(F.col("translated_text"), x))
    folded = F.lower(target)
    letters = F.regexp_count(tra, F.lit("[A-Za-z]"))
    foreign_en = folded.startswith("en") & (T.cjk_ratio(tra) > 0.5) & (letters == 0)
    foreign_cjk = (folded.startswith("zh") | folded.startswith("ja")) & (letters > 0) & (letters / F.greatest(F.length(tra), F.lit(1)) > 0.8)
    # Codes, severities and messages of a report, here and in layout().
    simple = [
        _issue(1, "empty_source", "error", T.is_blank(src), "source text is empty"),
        _issue(2, "empty_correction", "error", T.is_blank(cor), "corrected text is empty"),
        _issue(3, "empty_translation", "error", T.is_blank(tra), "translated text is empty"),
        _issue(4, "translation_missing", "warning", has_target & tra.isNull(), "translation is missing"),
        _issue(5, "translation_unchanged", "warning", checked & (T.comparable_text(best) == T.comparable_text(tra)), "translation is unchanged from source"),
        _issue(6, "number_missing", "warning", checked & numbers_gone, "translation lost a number"),
        _issue(7, "protected_content_missing", "warning", checked & lost, "translation lost a URL, email, or code span"),
        _issue(8, "glossary_missing", "warning", checked & F.col("_term").isNotNull(), F.concat(F.lit("translation does not use glossary target for "), F.col("_term"))),
        _issue(9, "translation_too_long", "warning", checked & (F.length(tra) > F.greatest(F.lit(80), F.length(best) * 4)), "translation is unexpectedly long", F.length(tra)),
        _issue(10, "target_language_unexpected", "warning", checked & foreign_en, "translation does not appear to be English"),
        _issue(11, "target_language_unexpected", "warning", checked & foreign_cjk, "translation does not appear to use the target script"),
        _issue(12, "invalid_duration", "error", duration <= 0, "cue duration must be positive", duration),
        _issue(13, "duration_too_short", "warning", (duration > 0) & (duration < o.min_duration_ms), f"duration is below {o.min_duration_ms} ms", duration),
        _issue(14, "duration_too_long", "warning", (duration > 0) & (duration > o.max_duration_ms), f"duration exceeds {o.max_duration_ms} ms", duration),
        _issue(15, "overlap", "error", F.col("start_ms") < F.col("_before"), F.concat(F.lit("cue overlaps previous cue "), F.col("_before_id"))),
    ]

    # Lines and their measures are columns of their own, so that the rules don't wrap a text again and again.
    variants = {"source": src, "corrected": cor, "translated": tra}
    rows = rows.withColumns({f"_{k}_lines": T.display_lines(v, o.max_line_chars, o.max_lines) for k, v in variants.items()})
    measures = lambda x: F.struct(F.length(x).alias("chars"), T.cjk_count(x).alias("cjk"), T.latin_words(x).alias("words"))
    rows = rows.withColumns({f"_{k}_lines": F.transform(f"_{k}_lines", measures) for k in variants})

    def layout(text: Column, label: str, base: int) -> list[Column]:
        """Issues of one text variant: line count, longest line, two rules line by line, reading speed."""
        lines = F.col(f"_{label}_lines")
        longest = F.array_max(F.transform(lines, lambda x: x["chars"]))
        speed = F.aggregate(lines, F.lit(0), lambda n, x: n + x["chars"]) / (duration / 1000.0)
        tag, there = F.lit(label), text.isNotNull()
        per_line = F.flatten(
            F.transform(
                lines,
                lambda line, k: F.array(
                    _issue(base + 2, "cjk_line_too_long", "warning", line["cjk"] > o.max_chars_cjk, F.concat(F.lit(f"{label} line has "), line["cjk"].cast("string"), F.lit(f" CJK characters; maximum is {o.max_chars_cjk}")), line["cjk"], tag, k * 2),
                    _issue(base + 2, "latin_words_exceeded", "warning", line["words"] > o.max_words_latin, F.concat(F.lit(f"{label} line has "), line["words"].cast("string"), F.lit(f" Latin words; maximum is {o.max_words_latin}")), line["words"], tag, k * 2 + 1),
                ),
            )
        )
        head = F.array(
            _issue(base, "line_count_exceeded", "warning", there & (F.size(lines) > o.max_lines), F.concat(F.lit(f"{label} has "), F.size(lines).cast("string"), F.lit(f" lines; maximum is {o.max_lines}")), F.size(lines), tag),
            _issue(base + 1, "line_too_long", "warning", there & (longest > o.max_line_chars), F.concat(F.lit(f"{label} line has "), longest.cast("string"), F.lit(f" characters; maximum is {o.max_line_chars}")), longest, tag),
            _issue(base + 3, "cps_exceeded", "warning", there & (duration > 0) & (speed > o.max_cps), F.concat(F.lit(f"{label} CPS is "), F.format_string("%.2f", speed), F.lit(f"; maximum is {o.max_cps:.2f}")), speed, tag),
        )
        return [head, F.coalesce(per_line, F.array_except(head, head))]

    parts = [F.array(*simple)]
    for k, (label, text) in enumerate(variants.items()):
        parts += layout(text, label, 20 + 10 * k)
    found = rows.withColumn("_issue", F.explode(F.sort_array(F.array_compact(F.concat(*parts)))))
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq", "_issue.ord"))
    return found.select("doc_id", "seq", "cue_id", order.alias("issue_ord"), "_issue.code", "_issue.severity", "_issue.label", "_issue.measured", "_issue.message")


def report_flags(issues: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, has_errors, has_repairable, repairable_cue_ids (in issue order, repeats kept) for every document."""
    mends = F.col("code").isin(*REPAIRABLE)
    grouped = issues.groupBy("doc_id").agg(
        F.bool_or(F.col("severity") == "error").alias("has_errors"),
        F.bool_or(mends).alias("has_repairable"),
        F.sort_array(F.collect_list(F.when(mends, F.struct("issue_ord", "cue_id")))).alias("_ids"),
    )
    joined = docs.select("doc_id").distinct().join(grouped, "doc_id", "left")
    none = F.array().cast("array<string>")
    return joined.select("doc_id", F.coalesce("has_errors", F.lit(False)).alias("has_errors"), F.coalesce("has_repairable", F.lit(False)).alias("has_repairable"), F.coalesce(F.col("_ids.cue_id"), none).alias("repairable_cue_ids"))


def select_repair_cues(cues: DataFrame, cue_docs: DataFrame, issues: DataFrame | None = None) -> DataFrame:
    """Cues with a repairable issue, or without translation when there is no report; only of documents with a target."""
    with_target = cues.join(cue_docs.where("target_language IS NOT NULL").select("doc_id"), "doc_id", "left_semi")
    if issues is None:
        return with_target.where("translated_text IS NULL")
    return with_target.join(issues.where(F.col("code").isin(*REPAIRABLE)).select("doc_id", "cue_id").distinct(), ["doc_id", "cue_id"], "left_semi")
