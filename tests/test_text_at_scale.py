"""Replies that are paid for once, large glossaries, banded distances, and words dealt to segments by a sweep."""

import os
import random

import pytest
from pyspark.sql import functions as F

from cuelake.functions import text as T
from cuelake.operators import quality as Q
from cuelake.operators import stages as G
from cuelake.sources import transcripts

from .test_segmentation import words


def batches(spark, n):
    rows = [(1, k + 1, k, 0, f"i{k}", f"text {k}") for k in range(n)]
    return G.neighbour_context(spark.createDataFrame(rows, "doc_id bigint, seq int, batch_id int, pos int, id string, text string"))


def paid(log, dies_at=None, fails=()):
    """A function that notes each call, and can take its task down."""

    def make():
        def call(items, context):
            if dies_at is not None and sum(1 for _ in open(log)) >= dies_at:
                raise KeyboardInterrupt  # not an error of the function: the task is lost
            with open(log, "a") as f:
                f.write(items[0]["id"] + "\n")
            if items[0]["id"] in fails:
                raise RuntimeError
            return {x["id"]: x["text"].upper() for x in items}

        return call

    return make


def test_a_lost_task_is_not_paid_for_twice(spark, tmp_path):
    log, folder = str(tmp_path / "log"), str(tmp_path / "replies")
    open(log, "w").close()
    with pytest.raises(Exception):
        G.transform_text(batches(spark, 20), paid(log, dies_at=10), parallelism=1, replies=folder)
    assert len(open(log).readlines()) == 10
    updates, outcomes = G.transform_text(batches(spark, 20), paid(log), parallelism=4, replies=folder)
    assert sorted(open(log).read().split()) == sorted(f"i{k}" for k in range(20))
    assert {r.id: r.text for r in updates.collect()} == {f"i{k}": f"TEXT {k}" for k in range(20)}
    assert outcomes.where("error_type IS NOT NULL").count() == 0
    G.transform_text(batches(spark, 20), paid(log), replies=folder)
    assert len(open(log).readlines()) == 20
    G.transform_text(batches(spark, 20), paid(log), replies=folder, kind="other")  # another function
    assert len(open(log).readlines()) == 40


def test_errors_are_asked_again(spark, tmp_path):
    log, folder = str(tmp_path / "log"), str(tmp_path / "replies")
    _, outcomes = G.transform_text(batches(spark, 4), paid(log, fails=("i2",)), replies=folder)
    assert [r.batch_id for r in outcomes.where("error_type IS NOT NULL").collect()] == [2]
    G.transform_text(batches(spark, 4), paid(log), replies=folder)
    assert sorted(open(log).read().split()) == ["i0", "i1", "i2", "i2", "i3"]
    assert not [f for _, _, fs in os.walk(folder) for f in fs if f.endswith(".tmp")]


def test_large_glossaries(spark, monkeypatch):
    rng = random.Random(8)
    pairs = [("a", "b"), ("b", "c"), ("c", None), ("", "x"), ("zz", "q"), ("b", "no"), ("q", "zz"), ("é", "EE")]
    pairs += [("".join(rng.choices("abcdefé", k=rng.randrange(1, 4))), "".join(rng.choices("abcdefé", k=rng.randrange(0, 4)))) for _ in range(150)]
    texts = ["".join(rng.choices("abcdefqzé ", k=rng.randrange(0, 30))) for _ in range(300)] + [None, ""]
    df = spark.createDataFrame([(t, rng.choice(texts)) for t in texts], "t string, o string").repartition(3)
    got = df.select("t", T.replace_all(F.col("t"), pairs).alias("x")).collect()
    cues = df.select(F.lit(1).alias("doc_id"), F.lit(1).alias("seq"), F.lit(None).cast("string").alias("corrected_text"), F.col("t").alias("source_text"), F.col("o").alias("translated_text"))
    glossary = transcripts.glossary_table(spark, [(a, b, None) for a, b in {a: b for a, b in pairs if a}.items()])
    many = cues.select("source_text", "translated_text", Q.first_term(glossary).alias("x")).collect()
    monkeypatch.setattr(T, "FOLDED", 1000)
    assert sorted(map(repr, got)) == sorted(map(repr, df.select("t", T.replace_all(F.col("t"), pairs).alias("x")).collect()))
    assert sorted(map(repr, many)) == sorted(map(repr, cues.select("source_text", "translated_text", Q.first_term(glossary).alias("x")).collect()))
    assert {r.x for r in many} > {None}


def test_banded_distance_at_its_edge(spark):
    rows = [("abcd", "abxy"), ("abcd", "axyz"), ("", ""), ("ab", ""), ("a b c d", "ABXY"), ("a" * 100, "a" * 71 + "b" * 29), ("a" * 100, "a" * 70 + "b" * 30), ("x" * 3000, "y" * 3000), ("abc", "abcdef")]
    df = spark.createDataFrame(rows, "a string, b string")
    for ratio in (0.0, 0.29, 0.3, 0.5, 1.0):
        both = df.select((T.change_ratio(F.col("a"), F.col("b")) <= ratio).alias("x"), T.changed_at_most(F.col("a"), F.col("b"), ratio).alias("y")).collect()
        assert [r.x for r in both] == [r.y for r in both]


def slow_claims(ws, segments):
    """The contract of assign_words_to_segments, one word after the other."""
    own = {s: [] for s, *_ in segments}
    for w, a, b in ws:
        hit = next((s for s, x, y in segments if x <= (a + b) // 2 <= y), None)
        if hit is None:
            return None
        own[hit].append((w, a, b))
    before, out = None, []
    for s, x, y in segments:
        if x >= y or not own[s] or (before is not None and x < before):
            return None
        before = max(y, own[s][-1][2])
        out.append((s, min(x, own[s][0][1]), before, tuple(w for w, *_ in own[s])))
    return out


def test_sweep_against_slow_model(spark):
    rng = random.Random(9)
    ws, segs, want = [], [], {}
    for d in range(120):
        at, own = 0, []
        for k in range(rng.randrange(1, 30)):
            n = rng.choice([100, 200])
            own.append((k + 1, at, at + n))
            at += n + rng.choice([0, 0, 100])
        segments, k = [], 0
        while k < len(own):
            m = rng.randrange(1, 6)
            part = own[k : k + m]
            middle = (part[0][1] + part[0][2]) // 2
            start = segments[-1][2] if segments and rng.random() < 0.5 else rng.choice([part[0][1], middle])
            segments.append((len(segments) + 1, start, rng.choice([part[-1][2], (part[-1][1] + part[-1][2]) // 2]) + (rng.choice([-60, 500]) if rng.random() < 0.04 else 0)))
            k += m
        ws += [(f"d{d}", k, "x", a, b) for k, a, b in own]
        segs += [(f"d{d}", s, "t", a, b) for s, a, b in segments]
        found = slow_claims(own, segments)
        for s, a, b, ids in found or [(1, own[0][1], own[-1][2], tuple(k for k, *_ in own))]:
            want[f"d{d}", s] = (a, b, [f"w{k:06d}" for k in ids], found is not None)
    w = words(spark, ws)
    s = spark.createDataFrame(segs, "doc_id string, seq int, text string, start_ms bigint, end_ms bigint")
    docs = w.select("doc_id").distinct().withColumn("text", F.lit("whole"))
    got = {(r.doc_id, r.seq): (r.start_ms, r.end_ms, r.word_ids, r.text == "t") for r in transcripts.assign_words_to_segments(w, s, docs).collect()}
    assert got == want
    assert 20 < len({d for (d, _), x in want.items() if x[3]}) < 120


def test_no_word_meets_all_segments(spark):
    """2,000 segments and 20,000 words of one document: no plan joins them on the document alone."""
    w = spark.range(1, 20_001).selectExpr("'d' AS doc_id", "CAST(id AS INT) AS seq", "format_string('w%06d', id) AS word_id", "'x' AS text", "id * 10 AS start_ms", "id * 10 + 9 AS end_ms", "CAST(NULL AS DOUBLE) AS confidence")
    s = spark.range(1, 2_001).selectExpr("'d' AS doc_id", "CAST(id AS INT) AS seq", "'t' AS text", "(id - 1) * 100 + 10 AS start_ms", "id * 100 + 9 AS end_ms")
    out = transcripts.assign_words_to_segments(w, s, w.select("doc_id").distinct().withColumn("text", F.lit("all")))
    assert out.count() == 2000 and out.agg(F.sum(F.size("word_ids"))).first()[0] == 20_000
    assert "_at#" not in "".join(x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x)


def test_wrapping_reads_a_text_once(spark):
    """Each further line adds two replacements to the expression; before, every line doubled and more what came before it."""
    rows = spark.createDataFrame([(None,), ("",), ("  a \t b  ",), ("one two, three four",), ("x" * 100,), ("ab " * 40,)], "t string")
    plan = rows.select(T.wrap_text(F.col("t"), 10, 6).alias("l"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 2 + 2 * 5
    got = [r.l for r in rows.select(T.wrap_text(F.col("t"), 10, 3).alias("l")).collect()]
    assert got == [[], [""], ["a b"], ["one two,", "three four"], ["x" * 10, "x" * 10, "x" * 80], ["ab ab ab", "ab ab ab", ("ab " * 34).strip()]]


def test_equal_long_texts_have_no_band(spark):
    """Texts that are equal but for white space need no edit distance, however long; the answers are those of the ratio."""
    import time

    long = "abcdefgh" * 25_000
    rows = spark.createDataFrame([(long, long + " "), (long[:8000], "x" + long[:8000]), (None, "a"), ("a", None), ("", ""), ("abcd", "abxy"), ("abcd", "axyz"), ("ab" * 40, "ba" * 40), ("q" * 40, "r" * 20 + "q" * 20)], "a string, b string")
    began = time.time()
    assert [r.x for r in rows.limit(2).select(T.changed_at_most(F.col("a"), F.col("b"), 0.5).alias("x")).collect()] == [True, True]
    assert time.time() - began < 30
    short = rows.where("coalesce(length(a), 0) < 1000")
    for ratio in (0.0, 0.25, 0.5, 1.0):
        wrong = short.where(~T.changed_at_most(F.col("a"), F.col("b"), ratio).eqNullSafe(T.change_ratio(F.col("a"), F.col("b")) <= ratio))
        assert wrong.count() == 0
