import random

import pytest

from cuelake.fixtures import no_segments, timed_words
from cuelake.functions import text as T
from cuelake.operators import segmentation as S
from cuelake.queries import QUERIES
from pyspark.sql import functions as F

WORDS = "doc_id string, seq int, word_id string, text string, start_ms bigint, end_ms bigint, confidence double"
SEGMENTS = "doc_id string, seq int, segment_id string, text string, start_ms bigint, end_ms bigint, word_ids array<string>"


def words(spark, rows):
    return spark.createDataFrame([(d, k, f"w{k:06d}", t, a, b, None) for d, k, t, a, b in rows], WORDS)


def none(spark):
    return spark.createDataFrame([], SEGMENTS)


def slow_cuts(pieces, proposed, limits):
    """The greedy cutter by looking at whole texts again and again."""
    import re

    cuts, start, candidate = [], 0, None
    for i, (text, a, b) in enumerate(pieces):
        gap = max(0, pieces[i + 1][1] - b) if i + 1 < len(pieces) else 0
        if re.search(r"[。！？.!?;；]\s*$", text) or gap >= limits.silence_ms:
            candidate = i
        joined = " ".join(p[0] for p in pieces[start : i + 1])
        duration = b - pieces[start][1]
        cjk = len(re.findall("[　-ヿ㐀-鿿豈-﫿]", joined))
        latin = len(re.findall("[A-Za-z]+(?:'[A-Za-z]+)?", joined))
        speed = len(joined.replace(" ", "")) / max(duration / 1000, 0.001)
        over = duration > limits.max_duration_ms or cjk > limits.max_chars_cjk or latin > limits.max_words_latin or (duration >= limits.max_duration_ms // 2 and speed > limits.max_cps)
        cut = i if i in proposed else ((candidate if candidate is not None else max(start, i - 1)) if over else None)
        if cut is not None:
            cuts.append(cut)
            start, candidate = cut + 1, None
    if pieces and (not cuts or cuts[-1] != len(pieces) - 1):
        cuts.append(len(pieces) - 1)
    return sorted(set(cuts))


def random_pieces(rng, n):
    out, at = [], 0
    for _ in range(n):
        text = rng.choice(["one", "two.", "it's", "漢字", "カナ。", "a-b", "verylongword" * 2, "9"])
        length = rng.choice([50, 300, 900, 3000])
        out.append((text, at, at + length))
        at += length + rng.choice([0, 0, 100, 700, 900])
    return out


def test_constrain_against_slow_model(spark):
    rng = random.Random(3)
    docs = {f"d{k}": random_pieces(rng, rng.randrange(1, 60)) for k in range(40)}
    proposed = {d: {i for i in range(len(p)) if rng.random() < 0.05} for d, p in docs.items()}
    w = words(spark, [(d, i + 1, *p) for d, ps in docs.items() for i, p in enumerate(ps)])
    chosen = spark.createDataFrame([(d, i + 1) for d, s in proposed.items() for i in s], "doc_id string, seq int")
    limits = S.Limits()
    for parts in (1, 8):
        got = {}
        for r in S.constrain_boundaries(S.gap_after(S.make_pieces(w, none(spark))).repartition(parts), chosen, limits).collect():
            got.setdefault(r.doc_id, []).append(r.seq - 1)
        assert {d: sorted(x) for d, x in got.items()} == {d: slow_cuts(p, proposed[d], limits) for d, p in docs.items()}


def test_window_merge(spark):
    w = words(spark, [("d", k + 1, f"t{k}", 500 * k, 500 * k + 300) for k in range(6)])

    def last_of_window(windows):
        return windows.groupBy("doc_id", "window_id").agg(F.max_by("piece_id", "seq").alias("piece_id"))

    cues = S.segment(w, none(spark), last_of_window, size=2).orderBy("seq").collect()
    assert [(c.start_ms, c.source_text) for c in cues] == [(0, "t0 t1"), (1000, "t2 t3"), (2000, "t4 t5")]
    assert [c.cue_id for c in cues] == ["cue000001", "cue000002", "cue000003"]


def test_failed_window_falls_back(spark):
    w = words(spark, [("d", k + 1, "a." if k == 1 else "a", 500 * k, 500 * k + 300) for k in range(4)])
    failed = spark.createDataFrame([("d", 0, "PermanentError")], "doc_id string, window_id int, error_type string")
    cues = S.segment(w, none(spark), size=4, outcomes=failed).orderBy("seq").collect()
    assert [c.source_text for c in cues] == ["a a.", "a a"] and all(c.warnings == ["segmentation_fallback"] for c in cues)


def test_long_segment_warning(spark):
    s = spark.createDataFrame([("d", 1, "seg1", "long one", 0, 9000, [])], SEGMENTS)
    cue = S.segment(words(spark, []), s).first()
    assert cue.warnings == ["atomic_segment_too_long"] and cue.source_word_ids == []


def test_overlap_must_be_smaller(spark):
    with pytest.raises(ValueError):
        S.token_windows(words(spark, []), 5, 5)


def slow_wrap(text, limit, most):
    import re

    rest, lines = " ".join(text.split()), []
    while len(lines) < most - 1:
        cut = len(rest)
        if len(rest) > limit:
            found = [m.end() for m in re.finditer(r"[\s,.;:!?，。；：！？、]", rest[: limit + 1])]
            cut = found[-1] if found else limit
        if cut >= len(rest):
            break
        lines.append(rest[:cut].rstrip())
        rest = rest[cut:].lstrip()
    return [*lines, rest]


@pytest.mark.parametrize(("limit", "most"), [(8, 2), (5, 3), (1, 2), (42, 1)])
def test_wrap(spark, limit, most):
    rng = random.Random(limit)
    texts = ["", "one two three four", "a" * 30, *("".join(rng.choices("ab ,.。漢\n", k=rng.randrange(40))) for _ in range(200))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(T.wrap_text(F.col("t"), limit, most)).collect()] == [slow_wrap(t, limit, most) for t in texts]


def long_tables(spark, seed=11, n=1500):
    """Documents over many stretches, with gaps in seq, pauses rare in some, and one short."""
    rng = random.Random(seed)
    docs = {f"d{k}": random_pieces(rng, n) if k % 2 else [(rng.choice(["one", "two", "9", "三"]), 260 * i, 260 * i + rng.choice([100, 260])) for i in range(n)] for k in range(4)}
    docs["e"] = random_pieces(rng, 3)
    w = words(spark, [(d, 2 * i + i // 50 + 1, *p) for d, ps in docs.items() for i, p in enumerate(ps)])
    return w, w.where("seq % 701 = 5").select("doc_id", "seq")


def same(a, b):
    rows = lambda t: sorted(map(repr, t.select(*sorted(a.columns)).collect()))
    assert rows(a) == rows(b)


def test_stretches_give_the_same_rows(spark):
    w, proposed = long_tables(spark)
    p = S.gap_after(S.make_pieces(w, none(spark))).cache()
    same(p, S.gap_after(S.make_pieces(w, none(spark)), 100))
    same(S.token_windows(p, 90, 20), S.token_windows(p, 90, 20, stretch=100))
    same(S.rule_boundaries(p), S.rule_boundaries(p, stretch=64))
    same(S.rule_cues(p), S.rule_cues(p, stretch=64))
    for size in (1, 7, 150, 10**6):
        same(S.constrain_boundaries(p, proposed), S.constrain_boundaries(p, proposed, stretch=size))
    same(S.segment(w, none(spark), size=300, overlap=30), S.segment(w, none(spark), size=300, overlap=30, stretch=100))


def test_no_task_holds_a_long_document(spark):
    """One span of 300,000 pieces without a proposal, in 30 stretches, equal to the cutter."""
    n = 300_000
    pieces = spark.range(1, n + 1, numPartitions=8).selectExpr("7L AS doc_id", "CAST(id AS INT) AS seq", "CASE WHEN id % 977 = 0 THEN 'end.' ELSE 'word' END AS text", "id * 300 AS start_ms", "id * 300 + 250 AS end_ms", "0 AS gap_after_ms")
    got = S.constrain_boundaries(pieces, pieces.where("false").select("doc_id", "seq"), stretch=10_000)
    cutter, want = S.Cutter(S.Limits()), []
    for i in range(1, n + 1):
        ends = i % 977 == 0
        at = cutter.add(i, i * 300, i * 300 + 250, 0, 1, 4, ends, False)
        want += [] if at is None else [at]
    assert sorted(r.seq for r in got.collect()) == [*want, n]


def test_times_that_go_back_are_told():
    from cuelake.operators.cutter import Cutter, Limits, compose, stretch_map

    pieces = [(i, 10_000 - i, 10_001 - i, 0, 0, 1, False, False) for i in range(5000)]
    made = stretch_map([(0, 0, 7001, 0, 0, 1, False, False), *pieces[1:]], Limits())
    with pytest.raises(ValueError):
        compose([*Cutter(Limits()).state()[:0], -1, 10_000, 0, 0, 0, None, 0, 0, 0, None, 0, -1], made, Limits())


def test_words_of_dealt_texts_are_not_shuffled(spark):
    """Texts are dealt before their words are told apart; windows over the words need no shuffle, and documents without segments no second reading."""
    from cuelake import fixtures as X
    from cuelake.operators import segmentation as S

    texts = spark.createDataFrame([(1, "One two. Three"), (2, "four"), (3, None)], "doc_id bigint, text string")
    words = X.timed_words(texts)
    pieces = S.gap_after(S.make_pieces(words, X.no_segments(words)))
    plan = pieces._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")
    assert [(r.doc_id, r.seq, r.gap_after_ms) for r in pieces.orderBy("doc_id", "seq").collect()] == [(1, 1, 40), (1, 2, 900), (1, 3, 0), (2, 1, 0)]


def test_merged_windows_meet_once(spark):
    """Choices named twice, blank, strange or of other windows spoil a window; a failed one follows the rules."""
    from cuelake.operators import segmentation as S

    rows = [(1, w, f"w{w}{k}", 10 * w + k, k < 3, "end." if k == 1 else "a", 0) for w in range(6) for k in range(4)]
    windows = spark.createDataFrame(rows, "doc_id int, window_id int, piece_id string, seq int, is_owner boolean, text string, gap_after_ms int")
    choices = spark.createDataFrame([(1, 0, "w00"), (1, 1, "w10"), (1, 1, "w10"), (1, 2, "w30"), (1, 3, "w33"), (1, 5, "w50"), (1, 9, "w90")], "doc_id int, window_id int, piece_id string")
    outcomes = spark.createDataFrame([(1, 5, "Error"), (1, 0, None)], "doc_id int, window_id int, error_type string")
    found, fallback = S.merge_window_boundaries(windows, choices, outcomes)
    assert sorted(r.seq for r in found.collect()) == [0, 11, 12, 21, 22, 32, 41, 42, 51, 52]
    assert [r.doc_id for r in fallback.collect()] == [1]
    assert {r.window_id: r.valid for r in S.validate_boundaries(windows, choices).collect()} == {0: True, 1: False, 2: False, 3: True, 4: False, 5: True}


def test_words_dealt_by_document_meet_by_more_keys(spark):
    """Joins by document and word read the words as they are dealt, also where nothing is small enough to be sent to all tasks."""
    from cuelake import fixtures as X
    from cuelake.operators import validation as V

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        words = X.timed_words(spark.createDataFrame([(k, "one two three. four five") for k in range(5)], "doc_id bigint, text string"))
        segments = X.word_segments(words).withColumn("word_ids", F.when(F.col("doc_id") == 3, F.array(F.lit("w000001"), F.lit("x"))).otherwise(F.col("word_ids")))
        for made, times in ((V.word_reference_check(segments, words), 2), (V.validate_segments(segments, words), 3)):
            plan = made._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange") == plan.count("REPARTITION_BY_NUM") == times
        assert [tuple(r) for r in V.word_reference_check(segments, words).collect()] == [(3, "seg000001", "x")]
        assert [tuple(r) for r in V.validate_segments(segments, words).collect()] == [(3, "seg000001", "unknown_word")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_segments_are_told_apart_by_their_place(spark):
    """Equal segments, and some without words, keep their own violations."""
    from cuelake.operators import validation as V

    words = spark.createDataFrame([(1, "a", 0, 5), (1, "b", 5, 9)], "doc_id bigint, word_id string, start_ms bigint, end_ms bigint")
    rows = [(1, 1, "s1", "x", 0, 9, ["a", "b"]), (1, 2, "s1", "x", 0, 9, ["a", None]), (1, 3, "s3", "x", 0, 8, []), (1, 4, "s4", "x", 1, 8, ["a", "a", "b"]), (2, 1, "s1", "x", 0, 9, [])]
    segments = spark.createDataFrame(rows, "doc_id bigint, seq int, segment_id string, text string, start_ms bigint, end_ms bigint, word_ids array<string>")
    got = sorted((r.doc_id, r.id, r.rule) for r in V.validate_segments(segments, words).collect())
    assert got == [(1, "s1", "repeated_id"), (1, "s1", "repeated_id"), (1, "s1", "unknown_word"), (1, "s3", "end_goes_back"), (1, "s3", "no_words"), (1, "s4", "does_not_cover"), (1, "s4", "repeated_word")]


def test_first_stretches_need_no_map(spark, monkeypatch):
    """Documents of one stretch, of several, with seq below 0 and with none in stretch 0 are cut as by the cutter; maps are made of later stretches only."""
    from cuelake.operators import cutter as K

    documents = {1: range(1, 40), 2: range(1, 400), 3: range(-120, 130), 4: range(205, 330)}
    rows, want = [], set()
    for doc, seqs in documents.items():
        cutter = K.Cutter(K.Limits())
        for i in seqs:
            piece = (i, i * 300, i * 300 + 250, 0, 1, 4, i % 17 == 0, i % 61 == 0)
            rows.append((doc, *piece))
            at = cutter.add(*piece)
            want |= {(doc, at)} if at is not None else set()
        want |= {(doc, seqs[-1])} if cutter.first is not None else set()
    marked = spark.createDataFrame(rows, "doc_id bigint, seq int, start_ms bigint, end_ms bigint, cjk int, words int, characters int, pause boolean, proposed boolean").repartition(3)
    mapped = spark.sparkContext.accumulator(0)
    whole = K.stretch_map
    monkeypatch.setattr(K, "stretch_map", lambda pieces, limits: (mapped.add(1), whole(pieces, limits))[1])
    got = [tuple(r) for r in K.cuts_in_stretches(marked, K.Limits(), 100).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert mapped.value == 6
    assert K.first_stretch([r[1:] for r in rows if r[0] == 1], K.Limits())["cuts"] == sorted(s for d, s in want if d == 1 and s < 39)


def test_ids_and_columns_as_before(spark):
    """Ids at the edges of the padded range are those of the format; columns keep their values and nulls."""
    import pyarrow as pa

    from cuelake.functions.timecode import make_id
    from cuelake.operators.cutter import values

    rows = spark.createDataFrame([(n,) for n in (None, -1, 0, 1, 999_999, 1_000_000, 10**12)], "n bigint")
    bad = rows.select(make_id("w", F.col("n")).alias("a"), F.format_string("w%06d", "n").alias("b")).where("NOT a <=> b")
    assert bad.count() == 0
    for column in (pa.array([1, None, 2**62 + 1]), pa.array([2**62 + 1, -1], pa.int64()), pa.array([True, False]), pa.array([True, None]), pa.array(["a", None]), pa.array([], pa.int32())):
        assert values(column) == column.to_pylist()


def test_pieces_of_either_kind_stay_as_dealt(spark):
    """Words and bare segments by themselves need no shuffle but that of the texts, and are together the pieces of both."""
    from cuelake import fixtures as X

    texts = spark.createDataFrame([(d, "One two. Three four five six seven eight nine ten eleven" if d % 2 else "a b.") for d in range(20)], "doc_id bigint, text string")
    w = X.timed_words(texts)
    own, segments = w.where("doc_id % 5 <> 0"), X.word_segments(w)
    kinds = [S.gap_after(p) for p in (S.word_pieces(own), S.segment_pieces(own, segments))]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for p in kinds:
            plan = p._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM") > 0
        whole = S.gap_after(S.make_pieces(own, segments))
        assert sorted(map(str, whole.collect())) == sorted(str(r) for p in kinds for r in p.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_whole_documents_need_no_join(spark):
    w = timed_words(spark.createDataFrame([(1, "one two. three"), (2, "a"), (3, None), (4, "x ( y ) z")], "doc_id bigint, text string"))
    p = S.gap_after(S.make_pieces(w, no_segments(w)))
    whole = S.whole_documents(p)
    same(whole, S.build_cues(p, p.groupBy("doc_id").agg(F.max("seq").alias("seq"))))
    same(whole, S.whole_documents(p, stretch=2))
    assert {r.doc_id: r.source_text for r in whole.collect()} == {1: "one two. three", 2: "a", 4: "x (y) z"}
    assert "Join" not in plan_of(whole)
    assert "Join" not in plan_of(QUERIES["join_pieces"](spark, "/root/testdata/sf0.001"))


def test_token_windows_take_one_window(spark):
    p = spark.createDataFrame([(d, i, f"w{i}") for d in (1, 2) for i in range(1, 8)], "doc_id bigint, seq int, text string")
    windows = S.token_windows(p, 3, 1)
    same(windows, S.token_windows(p, 3, 1, stretch=2))
    assert plan_of(windows).count("Window [") == 1


@pytest.mark.parametrize(("size", "overlap"), [(5, 0), (7, 3), (1000, 0)])
def test_sentence_cuts_are_what_the_merge_makes(spark, size, overlap):
    """With ids that are blank, missing or repeated in a window, too."""
    rng = random.Random(size)
    ids = lambda i: rng.choices([f"w{i}", "w3", " ", None], [60, 2, 1, 1])[0]
    rows = [(f"d{d}", i + 1, ids(i), rng.choice(["a", "b.", "c;", "d!"]), 500 * i, 500 * i + rng.choice([100, 490, -400])) for d in range(12) for i in range(rng.randrange(1, 60))]
    windows = S.token_windows(S.gap_after(S.word_pieces(words(spark, []).unionByName(spark.createDataFrame([(*r, None) for r in rows], words(spark, []).schema)))), size, overlap)
    boundaries, fallback = S.merge_window_boundaries(windows, S.sentence_boundaries(windows))
    chosen = S.sentence_cuts(windows).cache()
    plain = lambda df: sorted(map(tuple, df.select("doc_id", "seq").distinct().collect()))
    assert plain(chosen.where("_cut")) == plain(boundaries)
    assert sorted(chosen.where("NOT _valid").select("doc_id").distinct().collect()) == sorted(fallback.collect()) != []
    assert chosen.where("is_owner").count() == len(rows)


def test_words_of_large_texts_get_more_tasks(spark, monkeypatch):
    texts = spark.createDataFrame([(d, "word " * 200) for d in range(40)] + [(40, None)], "doc_id bigint, text string")
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = lambda df: df.select(F.spark_partition_id()).distinct().count()
    assert tasks(S.by_document(texts, "text")) <= few
    monkeypatch.setattr(S, "TEXT_BYTES", 2_000)
    assert few < tasks(S.by_document(texts, "text")) <= 20
    w = timed_words(texts)
    assert w.select("doc_id", F.spark_partition_id()).distinct().count() == 40 and w.count() == 8_000
    # Steps after it meet as dealt, though shuffles have fewer tasks.
    p = S.gap_after(S.word_pieces(w))
    cues = S.build_cues(p, S.rule_boundaries(p))
    assert sorted(map(tuple, cues.select("doc_id", "seq", "source_text", "start_ms").collect())) == sorted(map(tuple, S.rule_cues(p).select("doc_id", "seq", "source_text", "start_ms").collect()))


def shuffles(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out.count("Exchange hashpartitioning")


def test_default_choices_are_not_shuffled(spark, capsys):
    w = timed_words(spark.createDataFrame([(1, "a b. c")], "doc_id bigint, text string"))
    assert shuffles(S.segment_simple(w, no_segments(w)), capsys) == 1
    p = S.gap_after(S.word_pieces(w))
    assert shuffles(S.constrain_boundaries(S.sentence_cuts(S.token_windows(p)).where("is_owner"), F.col("_cut")), capsys) == 1


@pytest.mark.parametrize("stretch", [None, 40])
def test_proposed_as_a_condition(spark, stretch):
    w, _ = long_tables(spark, n=200)
    p = S.gap_after(S.word_pieces(w))
    condition = T.ends_sentence(F.col("text")) & (F.col("seq") % 7 == 0)
    plain = lambda df: sorted(map(tuple, df.distinct().collect()))
    assert plain(S.constrain_boundaries(p, condition, stretch=stretch)) == plain(S.constrain_boundaries(p, p.where(condition), stretch=stretch))
