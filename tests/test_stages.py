import json

import pytest
from pyspark.sql import functions as F

from cuelake.fixtures import cue_documents
from cuelake.operators import quality as Q
from cuelake.operators import segmentation as S
from cuelake.operators import stages as G
from cuelake.operators import validation as V
from cuelake.plans.options import Options
from cuelake.plans.pipeline import refine, run_pipeline
from cuelake.sources import sinks, srt, transcripts
from cuelake.sources.files import discover_inputs, file_checksums, secret_scan

CUES = "doc_id string, seq int, cue_id string, start_ms bigint, end_ms bigint, source_text string, corrected_text string, translated_text string, source_word_ids array<string>, warnings array<string>"


def cues(spark, texts, doc="d", step=1000, **more):
    rows = [(doc, k, f"cue{k:06d}", (k - 1) * step, k * step, t, more.get("corrected"), more.get("translated"), [], []) for k, t in enumerate(texts, 1)]
    return spark.createDataFrame(rows, CUES)


def by_seq(df):
    return df.orderBy("doc_id", "seq").collect()


def failing_on_two():
    def fn(items, context):
        if any(x["text"] == "t3" for x in items):
            raise RuntimeError("broken")
        return {x["id"]: x["text"].upper() for x in items}

    return fn


def test_batch_isolation_and_repair(spark):
    c = cues(spark, [f"t{k}" for k in range(1, 7)])
    docs = cue_documents(c, None)
    fns = G.UserFns({"translation": failing_on_two})
    out, docs = G.translate(c, docs, "en", fns, batch_size=2)
    got = by_seq(out)
    assert [r.translated_text for r in got] == ["T1", "T2", None, None, "T5", "T6"]
    assert [r.warnings for r in got[2:4]] == [["translation_failed:RuntimeError"]] * 2
    issues = Q.check_quality(out, docs)
    mended = by_seq(G.repair(out, docs, issues, "en"))
    assert [r.translated_text for r in mended][2:4] == ["[en] t3", "[en] t4"]
    assert [(r.start_ms, r.end_ms) for r in mended] == [(r.start_ms, r.end_ms) for r in by_seq(c)]
    with pytest.raises(ValueError):
        G.translate(c, cue_documents(c, None), "en", fns, batch_size=2, allow_partial=False)


def test_retries_then_succeeds(spark, tmp_path):
    path = str(tmp_path / "calls")

    def make():
        def fn(items, context):
            with open(path, "a+") as f:
                f.write("x")
                f.seek(0)
                if len(f.read()) < 3:
                    raise G.TransientError
            return {x["id"]: "done" for x in items}

        return fn

    req = G.requests_of(cues(spark, ["a"]), F.col("source_text"), 30)
    updates, outcomes = G.transform_text(G.neighbour_context(req), make, parallelism=1, base_delay=0.01)
    assert outcomes.first().error_type is None and updates.first().text == "done"
    with pytest.raises(ValueError):
        G.transform_text(req, make, parallelism=101)


def test_protected_content(spark):
    # Golden input: the sentence is a fixed value.
    def make():
        return lambda items, context: {x["id"]: "rewritten" for x in items}

    got = by_seq(G.correct(cues(spark, ["visit https://example.test with 42"]), G.UserFns({"correction": make})))[0]
    assert got.corrected_text is None and got.warnings == ["correction_failed:ValidationError"]


def test_cleanup(spark):
    got = by_seq(G.cleanup(cues(spark, ["um hello hello [noise]", "[noise]", "été été là"]), ("um ",), ("[noise]",), True))
    assert [r.corrected_text for r in got] == ["hello", None, "été là"]
    assert got[1].warnings == ["cleanup_skipped:blank"]


def test_translation_checks(spark):
    # Golden input: the sentences are fixed values.
    c = cues(spark, ["API version 42 at https://example.test"], translated="API version")
    g = transcripts.glossary_table(spark, [("API", "Schnittstelle", None)])
    codes = {r.code for r in Q.check_quality(c, cue_documents(c, "de"), glossary=g).collect()}
    assert {"number_missing", "protected_content_missing", "glossary_missing"} <= codes
    c = cues(spark, ["hello there"], translated="漢字漢字")
    assert "target_language_unexpected" in {r.code for r in Q.check_quality(c, cue_documents(c, "en")).collect()}
    c = cues(spark, ["你好"], translated="hello there")
    assert "target_language_unexpected" in {r.code for r in Q.check_quality(c, cue_documents(c, "zh-CN")).collect()}


def test_quality_on_invalid_rows(spark):
    rows = [("d", 1, "a", 0, 100, "x" * 50, None, None, [], []), ("d", 2, "b", 50, 50, "", " ", None, [], []), ("d", 3, "c", 60, 9000, "漢" * 30 + "\n\n" + "w " * 20, None, None, [], [])]
    issues = Q.check_quality(spark.createDataFrame(rows, CUES), spark.createDataFrame([("d", "en", None)], "doc_id string, source_language string, target_language string")).orderBy("issue_ord").collect()
    assert [(r.cue_id, r.code) for r in issues] == [
        ("a", "duration_too_short"), ("a", "cps_exceeded"),
        ("b", "empty_source"), ("b", "empty_correction"), ("b", "invalid_duration"), ("b", "overlap"),
        ("c", "duration_too_long"), ("c", "line_count_exceeded"), ("c", "cjk_line_too_long"), ("c", "latin_words_exceeded"),
    ]


def test_ordered_glossary(spark):
    g = transcripts.glossary_table(spark, [("[fr]", "FR", None), ("model", "modèle", None)])
    df = spark.createDataFrame([("[fr] OpenAI model",)], "t string")
    assert df.select(G.apply_glossary(F.col("t"), g)).first()[0] == "FR OpenAI modèle"
    with pytest.raises(ValueError):
        transcripts.glossary_table(spark, [("a", "b", None), ("a", "c", None)])


def test_quarantine_stops_when_told(spark):
    bad = cues(spark, [""])
    good, failures = V.quarantine(bad, V.validate_cues(bad))
    assert good.count() == 0 and failures.first().message == "empty_source"
    with pytest.raises(ValueError):
        V.quarantine(bad, V.validate_cues(bad), continue_on_error=False)


def golden(spark):
    words = [("今", 0, 400), ("天", 400, 800), ("错误", 800, 1200), ("。", 1200, 1700), ("明", 2000, 2500), ("天", 2500, 3000), ("！", 3000, 3400), ("好", 3700, 4300), ("？", 4300, 5000)]
    segs = [{"id": None, "text": "x", "start_ms": a, "end_ms": b, "words": [{"id": None, "text": t, "start_ms": s, "end_ms": e, "confidence": None} for t, s, e in part]} for a, b, part in ((0, 1700, words[:4]), (2000, 3400, words[4:7]), (3700, 5000, words[7:]))]
    return spark.createDataFrame([("d", "zh", None, None, segs)], "doc_id string, " + transcripts.RAW_SEGMENTS)


def test_golden_pipeline(spark, tmp_path):
    t = transcripts.normalize_segments_json(golden(spark))
    out = run_pipeline(t, Options(), workdir=str(tmp_path / "stages"))
    got = by_seq(out.cues)
    assert [(r.cue_id, r.start_ms, r.end_ms, r.corrected_text, r.translated_text, r.warnings) for r in got] == [
        ("cue000001", 0, 1700, "今天正确。", "[en] 今天正确。", []), ("cue000002", 2000, 3400, "明天！", "[en] 明天！", []), ("cue000003", 3700, 5000, "好？", "[en] 好？", []),
    ]
    assert out.failures.count() == 0 and (tmp_path / "stages" / "translated").is_dir()
    body = sinks.render_srt(out.cues).first().body
    assert body.startswith("1\n00:00:00,000 --> 00:00:01,700\n今天正确。\n[en] 今天正确。\n\n2\n") and body.endswith("\n") and not body.endswith("\n\n")


def test_refine_writes_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.srt").write_text("﻿1\r\n00:00:00,000 --> 00:00:01,000\r\nHello\r\n\r\n00:00:02.000 --> 00:00:03,500\r\ntwo\r\nlines\r\n", encoding="utf-8")
    (tmp_path / "in" / "b.srt").write_text("1\nno time\ntext\n", encoding="utf-8")
    c, docs, failures = srt.read_srt(spark, str(tmp_path / "in"))
    assert [f.message for f in failures.collect()] == ["invalid timestamp"]
    out = refine(c, docs, Options(target_language="fr"), workdir=str(tmp_path / "stages"))
    stems = out.cue_docs.select("doc_id", F.lit("sub/a.refined").alias("stem"))
    rendered = sinks.render_formats(out.cues, out.cue_docs, stems, ("srt", "vtt", "json", "bilingual_srt"), bilingual=False)
    sinks.write_documents(rendered, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out" / "sub").iterdir()) == ["a.refined.bilingual.srt", "a.refined.srt", "a.refined.subtitle.json", "a.refined.vtt"]
    assert (tmp_path / "out/sub/a.refined.srt").read_text() == "1\n00:00:00,000 --> 00:00:01,000\nHello\n\n2\n00:00:02,000 --> 00:00:03,500\ntwo\nlines\n"
    assert json.loads((tmp_path / "out/sub/a.refined.subtitle.json").read_text())["cues"][1]["translated_text"] == "[fr] two\nlines"
    back, _ = transcripts.read_subtitle_json(spark, str(tmp_path / "out/sub/a.refined.subtitle.json"))
    assert back.count() == 2
    with pytest.raises(Exception, match="output exists"):
        sinks.write_documents(rendered, str(tmp_path / "out"))
    sinks.write_documents(rendered, str(tmp_path / "out"), "replace")
    assert not [p for p in (tmp_path / "out" / "sub").iterdir() if p.suffix == ".tmp"]
    with pytest.raises(ValueError):
        sinks.render_formats(out.cues, out.cue_docs, stems, ("srt", "srt"))


def test_transcripts_round_trip(spark, tmp_path):
    t = transcripts.normalize_segments_json(golden(spark))
    stems = t.docs.select("doc_id", F.lit("x").alias("stem"))
    sinks.write_transcripts(t.docs, t.words, t.segments, stems, str(tmp_path))
    back = transcripts.read_transcripts(spark, str(tmp_path))
    assert back.words.drop("doc_id").orderBy("seq").collect() == t.words.drop("doc_id").orderBy("seq").collect()
    assert back.docs.first().timing_origin == "asr_native"


def test_aligned(spark):
    kind = "doc_id string, " + transcripts.RAW_ALIGNED
    item = lambda t, a, b: {"text": t, "start_time": a, "end_time": b}
    result = lambda stamps, segs=None, lang="English", a=None, b=None: {"language": lang, "text": "text", "time_stamps": stamps, "segments": segs, "start_time": a, "end_time": b}
    rows = [
        ("times", [result([item("a", 0.125, 0.610), item("b", 0.720, 1.305)])]),
        ("zero", [result([item("one", 0.0, 0.2), item("two", 0.2, 0.2), item("three", 0.3, 0.6), item("end", 0.6, 0.6)])]),
        ("none", [result(None)]),
        ("native", [result(None, [{"text": None, "start_time": None, "end_time": None, "start": 0.0, "end": 1.2}])]),
        ("mixed", [result([item("a", 0.0, 1.0)]), result(None, None, "en", 1.0, 2.0)]),
    ]
    t, failures = transcripts.normalize_aligned(spark.createDataFrame(rows, kind))
    got = {}
    for r in t.words.orderBy("seq").collect():
        got.setdefault(r.doc_id, []).append((r.word_id, r.text, r.start_ms, r.end_ms))
    assert got == {"times": [("w000001", "a", 125, 610), ("w000002", "b", 720, 1305)], "zero": [("w000001", "one", 0, 200), ("w000002", "two three end", 300, 600)]}
    assert {f.doc_id for f in failures.collect()} == {"none", "mixed"}
    native = t.segments.where("doc_id = 'native'").first()
    assert (native.segment_id, native.text, native.end_ms) == ("seg000001-001", "text", 1200)
    assert {r.doc_id: r.timing_origin for r in t.docs.collect()}["native"] == "segment_native"


def test_hypotheses(spark):
    w = lambda t, a, b: {"word": t, "char": None, "text": None, "start": a, "end": b}
    words = [w("a", 1.234, 1.801), w("b", 2.111, 3.456), w("c", 3.5, 4.567), w("d", 4.6, 5.1)]
    h = lambda ws, segs: {"text": "t", "language": None, "lang": None, "timestamp": {"word": ws, "segment": segs}}
    rows = [("seg", [h(words, [{"segment": "s", "text": None, "start": 1.2, "end": 5.2}])]), ("bare", [h(words, None)]), ("two", [h(words, None)] * 2), ("wordless", [h([], None)])]
    t, failures = transcripts.normalize_hypotheses(spark.createDataFrame(rows, "doc_id string, " + transcripts.RAW_HYPOTHESES))
    got = {r.doc_id: (r.start_ms, r.end_ms, r.word_ids) for r in t.segments.collect()}
    ids = [f"w00000{k}" for k in range(1, 5)]
    assert got == {"seg": (1200, 5200, ids), "bare": (1234, 5100, ids)}
    assert {f.doc_id for f in failures.collect()} == {"two", "wordless"}
    assert {r.language for r in t.docs.collect()} == {"und"}


def test_model_responses(spark):
    replies = ['{"items":[{"id":"a","text":"x"}]}', '{"items":[{"id":"a","text":"x","note":1}]}', '{"items":[]}', '{"items":[{"id":"a","text":" "}]}', "no json", '{"items":[{"id":"a","text":"x"},{"id":"a","text":"y"}]}']
    df = spark.createDataFrame([("d", k, r) for k, r in enumerate(replies)], "doc_id string, batch_id int, reply string")
    good, bad = transcripts.parse_model_responses(df)
    assert [(r.batch_id, r.id, r.text) for r in good.collect()] == [(0, "a", "x")] and {r.batch_id for r in bad.collect()} == {1, 2, 3, 4, 5}
    df = spark.createDataFrame([("d", 0, '{"break_after":["a","b"]}'), ("d", 1, '{"break_after":[]}')], "doc_id string, batch_id int, reply string")
    good, bad = transcripts.parse_model_responses(df, "boundaries")
    assert sorted(r.piece_id for r in good.collect()) == ["a", "b"] and bad.count() == 1


def test_files(spark, tmp_path):
    for name in ("Season 2/A.mp4", "z.MP4", "notes.txt"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text("key-123" if name == "z.MP4" else "x")
    assert [r.rel_path for r in discover_inputs(spark, str(tmp_path)).collect()] == ["Season 2/A.mp4", "z.MP4"]
    assert file_checksums(spark, str(tmp_path), ["Season"]).count() == 2
    assert [r.path.rsplit("/", 1)[1] for r in secret_scan(spark, str(tmp_path), ["key-123", ""]).collect()] == ["z.MP4"]
    with pytest.raises(FileNotFoundError):
        discover_inputs(spark, str(tmp_path), [".wav"])


def test_options():
    o = Options.of({"segmentation": {"batch_tokens": 10}, "output": {"formats": ("vtt",)}})
    assert o.segmentation.batch_tokens == 10 and o.repair.batch_size == 20
    for bad in ({"nonsense": 1}, {"segmentation": {"overlap_tokens": 900}}, {"output": {"formats": ()}}, {"quality": {"min_duration_ms": 9000}}, {"correction": {"parallelism": 101}}):
        with pytest.raises(ValueError):
            Options.of(bad)


def test_text_stages_keep_times(spark):
    c = cues(spark, ["one", "two"])
    key = ["doc_id", "seq", "start_ms", "end_ms"]
    out = G.cleanup(G.correct(c))
    out, _ = G.translate(out, cue_documents(c, None), "en")
    assert sorted(out.select(*key).collect()) == sorted(c.select(*key).collect())


def shout():
    return lambda items, context: {x["id"]: f"{context['content']['tone']}:{context['content']['summary']}:{context['glossary'][0]['note']}:{x['text']}" for x in items}


def keep_texts():
    return lambda items, context: {x["id"]: x["text"] for x in items}


def describe():
    def fn(text):
        if "broken" in text:
            raise RuntimeError(text)
        return {"summary": text[:5], "domain": "d", "tone": "calm"}

    return fn


def test_user_functions_from_end_to_end(spark, tmp_path):
    """Context, glossary and options reach the user's functions, in both pipelines."""
    g = transcripts.glossary_table(spark, [("none", "none", "a note")])
    fns = G.UserFns({"correction": keep_texts, "translation": shout, "repair": keep_texts, "context": describe})
    t = transcripts.normalize_segments_json(golden(spark))
    options = Options.of({"correction": {"parallelism": 2, "retries": 1}, "repair": {"enabled": False}})
    out = run_pipeline(t, options, fns, glossary=g, workdir=str(tmp_path / "w"), secrets=["a note"])
    text = t.docs.first().text[:5]
    assert [r.translated_text for r in by_seq(out.cues)] == [f"calm:{text}:a note:{x}" for x in ("今天错误。", "明天！", "好？")]
    events = spark.read.parquet(str(tmp_path / "w" / "events"))
    assert {(r.stage, r.status) for r in events.collect()} >= {("segmented", "started"), ("segmented", "completed"), ("quality", "completed")}
    assert json.loads(spark.read.parquet(str(tmp_path / "w" / "run")).first().options)["correction"]["parallelism"] == 2
    c = cues(spark, ["broken one", "two"], "e").unionByName(cues(spark, ["fine", "two"], "f", corrected="better"))
    got = refine(c, cue_documents(c, None), options, fns, glossary=g)
    texts = {(r.doc_id, r.seq): r.translated_text for r in got.cues.collect()}
    assert texts["e", 1] == "::a note:broken one" and texts["f", 2] == "calm:bette:a note:two"
    assert {r.doc_id: r.warnings for r in got.contexts.collect()} == {"e": [], "f": []}
    off = refine(c, cue_documents(c, None), Options.of({"context_enabled": False, "repair": {"enabled": False}}), fns, glossary=g)
    assert off.contexts.count() == 0 and off.cues.where("translated_text LIKE '::a note:%'").count() == 4
    with pytest.raises(ValueError, match="no user function"):
        refine(c, cue_documents(c, None), options, G.UserFns({"correction": keep_texts}))


def test_context_failure_goes_on(spark):
    rows = spark.createDataFrame([("a", "broken"), ("b", "x" * 30)], "doc_id string, text string")
    got = {r.doc_id: (r.summary, r.warnings) for r in G.content_context(rows, G.UserFns({"context": describe}), limit=20).collect()}
    assert got == {"a": ("", ["context_analysis_fallback:RuntimeError"]), "b": ("xxxxx", ["context_analysis_truncated"])}
    got = G.content_context(rows, G.NativeFns("context")).first()
    assert got.summary == "" and got.warnings == ["context_analysis_fallback:PermanentError"]


def choose_ends():
    def fn(tokens):
        if any(x["text"] == "t5" for x in tokens):
            raise RuntimeError("no")
        return [tokens[-1]["id"]]

    return fn


def test_user_chooser(spark):
    words = spark.createDataFrame([("d", k + 1, f"w{k}", f"t{k}", 500 * k, 500 * k + 300, None) for k in range(6)], "doc_id string, seq int, word_id string, text string, start_ms bigint, end_ms bigint, confidence double")
    none = spark.createDataFrame([], "doc_id string, seq int, segment_id string, text string, start_ms bigint, end_ms bigint, word_ids array<string>")
    got = by_seq(S.segment(words, none, G.user_chooser(choose_ends), size=2))
    assert [c.source_text for c in got] == ["t0 t1", "t2 t3", "t4 t5"] and all(c.warnings == ["segmentation_fallback"] for c in got)


def test_silence_option(spark):
    """The rules' silence comes from the options."""
    words = spark.createDataFrame([("d", k + 1, f"w{k}", "a", 1000 * k, 1000 * k + 400, None) for k in range(4)], "doc_id string, seq int, word_id string, text string, start_ms bigint, end_ms bigint, confidence double")
    p = S.gap_after(S.make_pieces(words, spark.createDataFrame([], "doc_id string, seq int, segment_id string, text string, start_ms bigint, end_ms bigint, word_ids array<string>")))
    assert S.rule_boundaries(p, 600).count() == 4 and S.rule_boundaries(p, 601).count() == 1
    assert S.rule_cues(p, 600).count() == 4


def test_hidden_names_and_a_single_file(spark, tmp_path):
    for name in ("_take1.wav", "a/.b.mp3", "_c/d.mp4", "a/e.ogg", "_x.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    assert sorted(r.rel_path for r in discover_inputs(spark, str(tmp_path)).collect()) == ["_c/d.mp4", "_take1.wav", "a/.b.mp3", "a/e.ogg"]
    assert [r.rel_path for r in discover_inputs(spark, str(tmp_path / "a" / "e.ogg")).collect()] == ["e.ogg"]


def test_two_documents_with_one_path(spark, tmp_path):
    rows = spark.createDataFrame([("a.srt", "x"), ("b.srt", "y"), ("a.srt", "z")], "rel_path string, body string")
    with pytest.raises(ValueError, match="one output path"):
        sinks.write_documents(rows, str(tmp_path / "out"))
    with pytest.raises(ValueError, match="leaves"):
        sinks.write_documents(spark.createDataFrame([("../a.srt", "x")], "rel_path string, body string"), str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def test_segment_words_only_of_good_documents(spark):
    t = transcripts.normalize_segments_json(golden(spark))
    t.words = t.words.withColumn("text", F.when(F.col("seq") == 2, F.lit(" ")).otherwise(F.col("text")))
    out = run_pipeline(t)
    assert out.cues.count() == 0 and out.failures.first().message == "blank_text"
    assert S.build_cues(S.gap_after(S.make_pieces(t.words, t.segments)), S.rule_boundaries(S.gap_after(S.make_pieces(t.words, t.segments)))).count() == 3


def test_stage_tables_leave_no_shuffle_files(spark, tmp_path):
    held = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before = held()
    out = sinks.write_stage_tables("t", spark.range(1000).groupBy(F.col("id") % 7).count(), str(tmp_path))
    assert not held() - before
    assert out.count() == 7
