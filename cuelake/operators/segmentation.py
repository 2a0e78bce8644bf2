"""From timed words to cues: pieces, windows, boundaries, readability cuts.

Windows partition by doc_id, and boundaries meet their pieces by (doc_id, seq), or by
(doc_id, window_id) in windows; the greedy cutter streams documents. Where
boundaries come from the rows of the pieces themselves they are a column, not a join.

Where a document may be too long for one task, `stretch` cuts it: rows are then dealt by
(doc_id, seq // stretch), and what a row needs from other stretches (the first row of the
next one, the last of the one before, sums over all before) comes from a table of one row for each
stretch (`carried`), so that no task holds or reads a whole document. The rows are the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.timecode import make_cue_id
from .cutter import SILENCE_MS, Cutter, Limits, cuts_in_stretches, values


#: With false, tables dealt alike by some of a join's keys meet as they are.
JOIN_AS_DEALT = "spark.sql.requireAllClusterKeysForCoPartition"
#: With true, rows that are sorted by a group's keys are gathered as they come, one group at a time.
GROUP_AS_SORTED = "spark.sql.execution.replaceHashWithSortAgg"
#: Bytes of text whose words one task gets, about; sorted, they take some twenty times as many.
TEXT_BYTES = 4 << 20


def in_order(*more: str) -> Window:
    return Window.partitionBy("doc_id", *more).orderBy("seq")


def by_document(rows: DataFrame, text: str | None = None) -> DataFrame:
    """The rows dealt by document, each to one of as many tasks as shuffles have.

    With the name of a column of texts there are as many tasks more as it takes for TEXT_BYTES each, which one pass over the
    texts counts: their words are sorted by the steps that follow, and then need neither much memory nor disk, however large the table.

    Tables dealt in this way, and what windows, groups and explodes make of them, meet by doc_id and any other keys
    without another shuffle. Texts dealt before their words are told apart cost a
    shuffle of the texts alone, however many steps read the words. For joins by more keys than doc_id that takes a
    setting, which is made here and stays: by default Spark deals both sides of such a join anew.
    """
    conf = rows.sparkSession.conf
    conf.set(JOIN_AS_DEALT, "false")
    conf.set(GROUP_AS_SORTED, "true")
    tasks = int(conf.get("spark.sql.shuffle.partitions"))
    if text is not None:
        size = rows.agg(F.sum(F.octet_length(text))).first()[0] or 0
        tasks = max(tasks, -(-size // TEXT_BYTES))
    return rows.repartition(tasks, "doc_id")


def apart(rows: DataFrame) -> DataFrame:
    """The rows dealt otherwise than by document, for a union with rows that are.

    Spark 4.1 takes the union of two tables dealt alike as dealt, and in some plans of this library then gives
    wrong rows; here the union is dealt anew.
    """
    return rows.repartition("doc_id", "seq")


def word_pieces(words: DataFrame) -> DataFrame:
    """doc_id, seq, piece_id, text, start_ms, end_ms, source_word_ids of words."""
    return words.select("doc_id", "seq", F.col("word_id").alias("piece_id"), "text", "start_ms", "end_ms", F.array("word_id").alias("source_word_ids"))


def segment_pieces(words: DataFrame, segments: DataFrame) -> DataFrame:
    """The same columns of the segments of documents without words."""
    bare = segments.join(words.select("doc_id").distinct(), "doc_id", "left_anti")
    return bare.select("doc_id", "seq", F.col("segment_id").alias("piece_id"), "text", "start_ms", "end_ms", F.array().cast("array<string>").alias("source_word_ids"))


def make_pieces(words: DataFrame, segments: DataFrame) -> DataFrame:
    """Pieces of words, or of segments of documents without any.

    What follows deals the union anew each time. No document has pieces of both kinds, so steps by document may also take
    word_pieces and segment_pieces each by itself, as they are dealt, and unite what they make of them.
    """
    return word_pieces(words).unionByName(apart(segment_pieces(words, segments)))


def carried(rows: DataFrame, stretch: int, first: dict[str, str] | None = None, last: dict[str, str] | None = None, sums: dict[str, str] | None = None, totals: dict[str, str] | None = None) -> DataFrame:
    """Adds _part and, from the other stretches of a document, columns by name.

    first: a column's value in the next stretch's first row; last: in the last row of the one before; sums: its sum over all
    stretches before; totals: over the whole document.
    """
    placed = rows.withColumn("_part", F.floor(F.col("seq") / stretch))
    aggs = [F.min_by(c, "seq").alias(n) for n, c in (first or {}).items()] + [F.max_by(c, "seq").alias(n) for n, c in (last or {}).items()]
    aggs += [F.sum(c).alias(n) for n, c in ((sums or {}) | (totals or {})).items()]
    edges = placed.groupBy("doc_id", "_part").agg(*aggs)
    by_part = Window.partitionBy("doc_id").orderBy("_part")
    before = by_part.rowsBetween(Window.unboundedPreceding, -1)
    columns = [F.lead(n).over(by_part).alias(n) for n in first or {}] + [F.lag(n).over(by_part).alias(n) for n in last or {}]
    columns += [F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in sums or {}] + [F.sum(n).over(Window.partitionBy("doc_id")).alias(n) for n in totals or {}]
    return placed.join(edges.select("doc_id", "_part", *columns), ["doc_id", "_part"])


def gap_after(pieces: DataFrame, stretch: int | None = None) -> DataFrame:
    """Adds gap_after_ms: the silence before the next piece, 0 for the last."""
    if stretch is None:
        after = F.lead("start_ms").over(in_order())
    else:
        pieces = carried(pieces, stretch, first={"_next": "start_ms"})
        after = F.coalesce(F.lead("start_ms").over(in_order("_part")), F.col("_next"))
    return pieces.withColumn("gap_after_ms", F.coalesce(F.greatest(after - F.col("end_ms"), F.lit(0)), F.lit(0))).drop("_part", "_next")


def is_last(*more: str) -> Column:
    return F.lead("seq").over(in_order(*more)).isNull()


def with_last(pieces: DataFrame, stretch: int | None = None) -> DataFrame:
    """Adds _last: whether a piece is its document's last."""
    if stretch is None:
        return pieces.withColumn("_last", is_last())
    return carried(pieces, stretch, first={"_next": "seq"}).withColumn("_last", is_last("_part") & F.col("_next").isNull()).drop("_part", "_next")


def token_windows(pieces: DataFrame, size: int = 800, overlap: int = 0, stretch: int | None = None) -> DataFrame:
    """doc_id, window_id, seq, is_owner and the columns of pieces: owner ranges of `size` pieces with context on both sides."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be from 0 to below size")
    if stretch is None:
        placed = pieces.withColumns({"_i": F.row_number().over(in_order()) - 1, "_n": F.count("*").over(in_order().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    else:
        placed = carried(pieces.withColumn("_1", F.lit(1)), stretch, sums={"_i": "_1"}, totals={"_n": "_1"})
        placed = placed.withColumn("_i", (F.col("_i") + F.row_number().over(in_order("_part")) - 1).cast("int")).drop("_1", "_part")
    last = F.ceil(F.col("_n") / size) - 1
    first = F.greatest(F.lit(0), F.floor((F.col("_i") - overlap) / size)).cast("int")
    to = F.least(last, F.floor((F.col("_i") + overlap) / size)).cast("int")
    out = placed.withColumn("window_id", F.explode(F.sequence(first, to)))
    return out.withColumn("is_owner", F.floor(F.col("_i") / size) == F.col("window_id")).drop("_i", "_n")


def ends_by_rule(last: Column, silence_ms: int) -> Column:
    return T.ends_sentence(F.col("text")) | (F.col("gap_after_ms") >= silence_ms) | last


def rule_boundaries(pieces: DataFrame, silence_ms: int = SILENCE_MS, stretch: int | None = None) -> DataFrame:
    """doc_id, seq: pieces that end a sentence, precede a silence or come last. Needs gap_after_ms."""
    marked = with_last(pieces, stretch)
    return marked.where(ends_by_rule(F.col("_last"), silence_ms)).select("doc_id", "seq")


def rule_cues(pieces: DataFrame, silence_ms: int = SILENCE_MS, stretch: int | None = None) -> DataFrame:
    """The cues that build_cues makes of rule_boundaries, without a join of the pieces with themselves."""
    return _cues_of(with_last(pieces, stretch).withColumn("_cut", ends_by_rule(F.col("_last"), silence_ms).cast("int")), stretch)


def whole_documents(pieces: DataFrame, stretch: int | None = None) -> DataFrame:
    """One cue for each document, as build_cues makes of its last piece, without a join of the pieces with themselves."""
    return _cues_of(with_last(pieces, stretch).withColumn("_cut", F.col("_last").cast("int")), stretch)


def sentence_boundaries(windows: DataFrame) -> DataFrame:
    """doc_id, window_id, seq, piece_id: the default chooser, sentence ends and each window's last token."""
    marked = windows.withColumn("_last", is_last("window_id"))
    return marked.where(T.ends_sentence(F.col("text"), T.CHOOSER_MARKS) | F.col("_last")).select("doc_id", "window_id", "seq", "piece_id")


def _with_choices(windows: DataFrame, choices: DataFrame) -> DataFrame:
    """The rows of windows with _chosen 0, and below them the choices with _chosen 1 and no further columns."""
    return windows.withColumn("_chosen", F.lit(0)).unionByName(choices.select("doc_id", "window_id", "piece_id", F.lit(1).alias("_chosen")), allowMissingColumns=True)


def _bad_choice(times: Column, known: Column) -> Column:
    """Whether a piece that is chosen so many times spoils its window."""
    return (times > 1) | ((times > 0) & (~known | F.coalesce(T.is_blank(F.col("piece_id")), F.lit(True))))


def validate_boundaries(windows: DataFrame, choices: DataFrame) -> DataFrame:
    """doc_id, window_id, valid: whether a window's choices are a non-empty set of its own tokens' ids."""
    rows = _with_choices(windows.select("doc_id", "window_id", "piece_id"), choices)
    pieces = rows.repartition("doc_id", "window_id").groupBy("doc_id", "window_id", "piece_id").agg(F.sum("_chosen").alias("_times"), (F.min("_chosen") == 0).alias("_known"))
    judged = pieces.groupBy("doc_id", "window_id").agg(F.bool_or("_known").alias("_there"), F.sum("_times").alias("_n"), F.bool_or(_bad_choice(F.col("_times"), F.col("_known"))).alias("_bad"))
    return judged.where("_there").select("doc_id", "window_id", ((F.col("_n") > 0) & ~F.col("_bad")).alias("valid"))


def merge_window_boundaries(windows: DataFrame, choices: DataFrame, outcomes: DataFrame | None = None, silence_ms: int = SILENCE_MS) -> tuple[DataFrame, DataFrame]:
    """Boundaries (doc_id, seq) and the documents that fell back to the rules.

    Of a valid window the chosen owners count, or its last owner if none was chosen; a
    failed or invalid window gets rule boundaries on its owners. outcomes: doc_id,
    window_id, error_type (null for success). Tokens, choices and failures of a window meet as rows
    of one table, not in joins.
    """
    # Marks are dealt, not texts.
    marked = windows.select("doc_id", "window_id", "piece_id", "seq", "is_owner", ends_by_rule(F.lit(False), silence_ms).alias("_ends"))
    rows = _with_choices(marked, choices).withColumn("_failed", F.lit(False))
    state = validate_boundaries(windows, choices)
    if outcomes is not None:
        failed = outcomes.where("error_type IS NOT NULL").select("doc_id", "window_id", F.lit(True).alias("_failed"))
        rows = rows.unionByName(failed, allowMissingColumns=True)
        state = state.join(failed.distinct(), ["doc_id", "window_id"], "left").withColumn("valid", F.col("valid") & F.col("_failed").isNull())
    # Failures have no _chosen, choices no seq.
    token, of_window = F.col("_chosen") == 0, Window.partitionBy("doc_id", "window_id")
    of_piece = Window.partitionBy("doc_id", "window_id", "piece_id")
    met = rows.repartition("doc_id", "window_id").withColumns({"_times": F.coalesce(F.sum("_chosen").over(of_piece), F.lit(0)), "_known": F.coalesce(F.min("_chosen").over(of_piece) == 0, F.lit(False))})
    met = met.withColumns({"_picked": F.col("piece_id").isNotNull() & (F.col("_times") > 0), "_spoilt": F.col("_chosen").isNotNull() & _bad_choice(F.col("_times"), F.col("_known"))})
    owner = token & F.col("is_owner")
    near = met.withColumns({
        "_valid": (F.max("_chosen").over(of_window) == 1) & ~F.bool_or(F.col("_spoilt") | F.col("_failed")).over(of_window),
        "_any": F.bool_or(owner & F.col("_picked")).over(of_window),
        "_last": F.col("seq") == F.max(F.when(owner, F.col("seq"))).over(of_window),
    })
    chosen = F.col("_picked") | (F.col("_last") & ~F.col("_any"))
    boundaries = near.where(owner & F.when(F.col("_valid"), chosen).otherwise(F.col("_ends") | F.col("_last"))).select("doc_id", "seq").distinct()
    return boundaries, state.where("NOT valid").select("doc_id").distinct()


def sentence_cuts(windows: DataFrame, silence_ms: int = SILENCE_MS) -> DataFrame:
    """The rows of windows with _valid, of their window, and _cut: what merge_window_boundaries makes of sentence_boundaries.

    The default chooser looks at the windows' own rows only, so its choices are a column, and no row meets another table or leaves its task.
    """
    of_window, of_piece = Window.partitionBy("doc_id", "window_id"), Window.partitionBy("doc_id", "window_id", "piece_id")
    chosen = windows.withColumn("_own", T.ends_sentence(F.col("text"), T.CHOOSER_MARKS) | is_last("window_id"))
    met = chosen.withColumn("_times", F.sum(F.col("_own").cast("int")).over(of_piece)).withColumn("_picked", F.col("piece_id").isNotNull() & (F.col("_times") > 0))
    owner = F.col("is_owner")
    near = met.withColumns({
        "_valid": ~F.bool_or(_bad_choice(F.col("_times"), F.lit(True))).over(of_window),
        "_any": F.bool_or(owner & F.col("_picked")).over(of_window),
        "_last": F.coalesce(F.col("seq") == F.max(F.when(owner, F.col("seq"))).over(of_window), F.lit(False)),
    })
    picked = F.col("_picked") | (F.col("_last") & ~F.col("_any"))
    cut = owner & F.when(F.col("_valid"), picked).otherwise(ends_by_rule(F.col("_last"), silence_ms))
    return near.withColumn("_cut", cut).drop("_own", "_times", "_picked", "_any", "_last")


def dedupe_boundaries(*boundaries: DataFrame) -> DataFrame:
    out = boundaries[0].select("doc_id", "seq")
    for more in boundaries[1:]:
        out = out.union(more.select("doc_id", "seq"))
    return out.repartition("doc_id", "seq").distinct()


def cutter_columns(pieces: DataFrame, limits: Limits, *more: Column) -> DataFrame:
    """Counters of each piece, which add up over pieces since joining only puts in spaces, and more columns."""
    text = F.col("text")
    return pieces.select(
        "doc_id", "seq", "start_ms", "end_ms", *more,
        T.cjk_count(text).alias("cjk"), T.latin_words(text).alias("words"), F.length(F.replace(text, F.lit(" "), F.lit(""))).alias("characters"),
        (T.ends_sentence(text) | (F.col("gap_after_ms") >= limits.silence_ms)).alias("pause"),
    )


def constrain_boundaries(pieces: DataFrame, proposed: DataFrame | Column, limits: Limits = Limits(), stretch: int | None = None) -> DataFrame:
    """doc_id, seq: proposed cuts and the readability cuts between them.

    proposed: a table of doc_id, seq, or a condition on the pieces' own columns, which takes no join.
    A document's pieces are streamed in order; at each proposed cut the state ends. With stretch, documents are cut in stretches
    whatever was proposed, and the maps of their stretches are composed (``cuts_in_stretches``).
    """
    if isinstance(proposed, Column):
        marked = cutter_columns(pieces, limits, F.coalesce(proposed, F.lit(False)).alias("proposed"))
    else:
        marked = cutter_columns(pieces, limits).join(proposed.select("doc_id", "seq").distinct().withColumn("proposed", F.lit(True)), ["doc_id", "seq"], "left")
        marked = marked.withColumn("proposed", F.coalesce("proposed", F.lit(False)))
    if stretch is not None:
        return cuts_in_stretches(marked, limits, stretch)
    # The window holds a document in one task already, in order.
    dealt = marked.withColumn("last", is_last()).sortWithinPartitions("doc_id", "seq")
    kind = marked.schema["doc_id"].dataType
    seq_kind = marked.schema["seq"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, add = None, Cutter(limits).add
        for b in batches:
            columns = [values(b.column(c)) for c in ("doc_id", "seq", "start_ms", "end_ms", "cjk", "words", "characters", "pause", "proposed", "last")]
            docs, cuts = [], []
            for doc, seq, start, end, cjk, n_words, characters, pause, ends, last in zip(*columns, strict=True):
                if doc != here:
                    here, add = doc, Cutter(limits).add
                at = add(seq, start, end, cjk, n_words, characters, pause, ends)
                if at is not None:
                    docs.append(doc)
                    cuts.append(at)
                if last and at != seq:
                    docs.append(doc)
                    cuts.append(seq)
            yield pa.RecordBatch.from_arrays([pa.array(docs, b.schema.field("doc_id").type), pa.array(cuts, b.schema.field("seq").type)], ["doc_id", "seq"])

    return dealt.mapInArrow(run, f"doc_id {kind.simpleString()}, seq {seq_kind.simpleString()}")


def build_cues(pieces: DataFrame, boundaries: DataFrame, stretch: int | None = None) -> DataFrame:
    """doc_id, seq, cue_id, start_ms, end_ms, source_text, corrected_text, translated_text, source_word_ids, warnings."""
    cut = boundaries.select("doc_id", "seq")
    cut = (by_document(cut) if stretch is None else cut).distinct().withColumn("_cut", F.lit(1))
    return _cues_of(pieces.join(cut, ["doc_id", "seq"], "left"), stretch)


def _cues_of(marked: DataFrame, stretch: int | None = None) -> DataFrame:
    """Cues of pieces with _cut: 1 for the last piece of a cue, 0 or null for others."""
    marked = marked.withColumn("_cut", F.coalesce("_cut", F.lit(0)))
    if stretch is None:
        marked = marked.withColumns({"_done": F.lit(0), "_text": F.lit(None).cast("string"), "_closed": F.lit(1)})
        keys: tuple[str, ...] = ()
    else:
        marked = carried(marked, stretch, last={"_text": "text", "_closed": "_cut"}, sums={"_done": "_cut"}).withColumn("_closed", F.coalesce("_closed", F.lit(1)))
        keys = ("_part",)
    w = in_order(*keys)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    spaced = marked.withColumns(
        {"_cue": F.col("_done") + F.coalesce(F.sum("_cut").over(before), F.lit(0)) + 1, "_before": F.coalesce(F.lag("text").over(w), "_text"), "_opens": F.coalesce(F.lag("_cut").over(w), "_closed") == 1}
    )
    # Only the first piece of a cue has no separator; cue texts are then plain concatenations.
    glue = F.when(F.col("_opens") | ~T.needs_space(F.col("_before"), F.col("text")), F.lit("")).otherwise(F.lit(" "))
    rows = spaced.withColumn("_part_text", F.concat(glue, F.col("text")))
    grouped = rows.sortWithinPartitions("doc_id", "_cue", "seq").groupBy("doc_id", "_cue").agg(
        F.min_by("start_ms", "seq").alias("start_ms"),
        F.max_by("end_ms", "seq").alias("end_ms"),
        F.sort_array(F.collect_list(F.struct("seq", "_part_text", "source_word_ids"))).alias("_parts"),
    )
    none = F.lit(None).cast("string")
    return grouped.select(
        "doc_id", F.col("_cue").cast("int").alias("seq"), make_cue_id(F.col("_cue")).alias("cue_id"), "start_ms", "end_ms",
        F.array_join(F.col("_parts._part_text"), "").alias("source_text"), none.alias("corrected_text"), none.alias("translated_text"),
        F.flatten(F.col("_parts.source_word_ids")).alias("source_word_ids"), F.array().cast("array<string>").alias("warnings"),
    )


def add_warning(cues: DataFrame, docs: DataFrame, warning: str) -> DataFrame:
    """Adds a warning to all cues of the documents named."""
    marked = docs.select("doc_id").distinct().withColumn("_hit", F.lit(True))
    joined = cues.join(marked, "doc_id", "left")
    return joined.withColumn("warnings", F.when(F.col("_hit"), F.concat("warnings", F.array(F.lit(warning)))).otherwise(F.col("warnings"))).drop("_hit")


def segment_warnings(cues: DataFrame, pieces: DataFrame, fallback_docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """segmentation_fallback and atomic_segment_too_long, each on all cues of a document."""
    out = add_warning(cues, fallback_docs, "segmentation_fallback")
    long = pieces.groupBy("doc_id").agg(F.max(F.size("source_word_ids")).alias("n"), F.max(F.col("end_ms") - F.col("start_ms")).alias("longest"))
    return add_warning(out, long.where((F.col("n") == 0) & (F.col("longest") > limits.max_duration_ms)), "atomic_segment_too_long")


def segment(
    words: DataFrame, segments: DataFrame, chooser=sentence_boundaries, size: int = 800, overlap: int = 0, limits: Limits = Limits(), outcomes: DataFrame | None = None,
    silence_ms: int = SILENCE_MS, keep: Callable[[str, DataFrame], DataFrame] = lambda name, table: table, stretch: int | None = None,
) -> DataFrame:
    """The whole stage.

    chooser: window tokens to (doc_id, window_id, piece_id) rows, or to a pair of these and outcomes
    (doc_id, window_id, error_type). keep stores a table that several steps read.
    """
    pieces = keep("pieces", gap_after(make_pieces(words, segments), stretch))
    windows = token_windows(pieces, size, overlap, stretch)
    if chooser is sentence_boundaries and outcomes is None:
        chosen = sentence_cuts(windows, silence_ms)
        cuts, fallback = constrain_boundaries(chosen.where("is_owner"), F.col("_cut"), limits, stretch), chosen.where("NOT _valid").select("doc_id").distinct()
    else:
        choices = chooser(windows)
        if isinstance(choices, tuple):
            choices, outcomes = choices
        boundaries, fallback = merge_window_boundaries(windows, choices, outcomes, silence_ms)
        cuts = constrain_boundaries(pieces, boundaries, limits, stretch)
    cues = build_cues(pieces, keep("cuts", cuts), stretch)
    return segment_warnings(cues, pieces, fallback, limits)


def segment_simple(words: DataFrame, segments: DataFrame, chooser=sentence_boundaries) -> DataFrame:
    """One choice over whole documents, the rules where it is invalid, and no readability limits."""
    pieces = gap_after(make_pieces(words, segments)).withColumns({"window_id": F.lit(0), "is_owner": F.lit(True)})
    # Every piece is an owner of its document's one window.
    if chooser is sentence_boundaries:
        return _cues_of(sentence_cuts(pieces).withColumn("_cut", F.col("_cut").cast("int")))
    boundaries, _ = merge_window_boundaries(pieces, chooser(pieces))
    return build_cues(pieces.drop("window_id", "is_owner"), boundaries)


def silence_sessions(words: DataFrame, gap_ms: int = SILENCE_MS) -> DataFrame:
    """doc_id, start_ts, end_ts, n_words: runs of live words (doc_id, ts, duration_ms) with silences below gap_ms.

    Works on batch and streaming tables; times count in microseconds and touching sessions merge, hence one less.
    """
    reach = F.concat(((F.col("duration_ms").cast("bigint") + gap_ms) * 1000 - 1).cast("string"), F.lit(" microseconds"))
    return (
        words.groupBy("doc_id", F.session_window("ts", reach))
        .agg(F.min("ts").alias("start_ts"), F.max(F.timestamp_millis(F.unix_millis("ts") + F.col("duration_ms"))).alias("end_ts"), F.count("*").alias("n_words"))
        .select("doc_id", "start_ts", "end_ts", "n_words")
    )
