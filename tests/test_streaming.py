import json
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cuelake.operators import segmentation as S
from cuelake.streaming import streams

from .test_segmentation import none, random_pieces, words

START = datetime(2024, 1, 1)


def run(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_sessions_equal_batch(spark, tmp_path):
    rng = random.Random(4)
    rows, at = [], 0
    for k in range(200):
        at += rng.choice([100, 300, 700, 701, 699, 2000])
        rows.append(("d", START + timedelta(milliseconds=at), 0))
    kind = "doc_id string, ts timestamp, duration_ms int"
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / "w"))
    # A late word in another document moves the watermark past all others.
    spark.createDataFrame([("z", START + timedelta(days=1), 0)], kind).write.mode("append").parquet(str(tmp_path / "w"))
    live = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "w"))
    got = run(streams.stream_silence_sessions(live), "sessions").where("doc_id = 'd'")
    want = S.silence_sessions(spark.createDataFrame(rows, kind))
    assert sorted(got.collect()) == sorted(want.select(*got.columns).collect())


def test_a_late_word_is_dropped_and_counted(spark, tmp_path):
    kind = "doc_id string, ts timestamp, duration_ms int"
    for k, at in enumerate([0, 100, 90_000, 90_100, 50_000, 200_000]):  # the fifth comes 30 s after the watermark of the batch before
        spark.createDataFrame([("d", START + timedelta(milliseconds=at), 0)], kind).coalesce(1).write.parquet(str(tmp_path / f"w/{k}"))
        time.sleep(0.02)
    live = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "w"))
    listener = streams.LateRows()
    spark.streams.addListener(listener)
    q = streams.stream_silence_sessions(live).writeStream.outputMode("append").format("memory").queryName("late").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.n_words for r in spark.table("late").collect()) == [2, 2]
    assert streams.late_rows(q) == 1
    for _ in range(100):
        if listener.dropped[str(q.id)]:
            break
        time.sleep(0.1)
    spark.streams.removeListener(listener)
    assert listener.dropped[str(q.id)] == 1


def cutter_input(spark, path, marked):
    """Documents in files by time; where ends are not marked, later events of another document move the watermark."""
    rng = random.Random(5)
    docs = {f"d{k}": random_pieces(rng, 40) for k in range(4)}
    rows = [(d, i + 1, START + timedelta(milliseconds=a), t, a, b, False, i + 1 == len(ps)) for d, ps in docs.items() for i, (t, a, b) in enumerate(ps)]
    kind = "doc_id string, seq int, ts timestamp, text string, start_ms bigint, end_ms bigint, proposed boolean, last boolean"
    rows.sort(key=lambda r: r[2])
    parts = [rows[k : k + 40] for k in range(0, len(rows), 40)]
    if not marked:
        parts = [[(*r[:-1], None) for r in p] for p in parts] + [[("z", k, START + timedelta(days=k), "x", 2 * k, 2 * k + 1, False, None)] for k in (1, 2)]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, kind).coalesce(1).write.parquet(f"{path}/{k:04d}")
        time.sleep(0.02)
    w = words(spark, [(d, i + 1, *p) for d, ps in docs.items() for i, p in enumerate(ps)])
    want = S.constrain_boundaries(S.gap_after(S.make_pieces(w, none(spark))), spark.createDataFrame([], "doc_id string, seq int"))
    live = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(path))
    return live, sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Tokyo"])
@pytest.mark.parametrize("marked", [True, False])
def test_cutter_equals_batch_in_every_zone(spark, tmp_path, zone, marked):
    live, want = cutter_input(spark, tmp_path / "p", marked)
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = run(streams.stream_constrain(live if marked else live.drop("last")), f"cuts_{zone.replace('/', '_')}_{marked}").where("doc_id <> 'z'").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert sorted(map(tuple, got)) == want


def test_cutter_needs_timers(spark, tmp_path):
    live, _ = cutter_input(spark, tmp_path / "p", True)
    before = spark.conf.get(streams.PROVIDER)
    spark.conf.set(streams.PROVIDER, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        with pytest.raises(ValueError, match="RocksDB"):
            streams.stream_constrain(live)
    finally:
        spark.conf.set(streams.PROVIDER, before)


def test_transcript_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps({"schema_version": "transcript.v1", "language": "en" if k else None, "text": f"t{k}", "timing_origin": "segment_native", "words": [], "segments": [], "provider": "p", "model_name": "m"}))

    def handle(batch):
        return batch.where("language IS NOT NULL").select("text"), batch.where("language IS NULL").select("text")

    for _ in range(2):  # a second start finds nothing new
        streams.stream_transcripts(spark, str(tmp_path / "in"), handle, str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "check"), max_files=2).awaitTermination(120)
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "good")).select("text").collect()) == ["t1", "t2"]
    assert [r.text for r in spark.read.parquet(str(tmp_path / "bad")).select(F.col("text")).collect()] == ["t0"]


def test_silence_sessions_query_over_many_files(spark, tmp_path):
    """Arrivals in more files than a trigger took, and silences within a millisecond of the gap."""
    from datetime import datetime, timedelta

    from cuelake import queries

    start = datetime(2024, 1, 1)
    rows = [(u * 100 + k, start + timedelta(days=4 * k, microseconds=u), u, "view", 0.0, "") for u in range(40) for k in range(8)]
    gap = timedelta(hours=2)
    rows += [(9000 + k, start + timedelta(days=1) + t, 99, "view", 0.0, "") for k, t in enumerate([gap * 0, gap - timedelta(microseconds=400), 2 * gap - timedelta(microseconds=400)])]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = queries.QUERIES["stream_silence_sessions"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(found) == 40 * 8 + 2
    assert sorted(r.n_words for r in found if r.doc_id == 99) == [1, 2]
