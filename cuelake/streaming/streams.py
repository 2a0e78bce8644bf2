"""Structured Streaming forms: transcript ingestion, silence sessions and the online cutter."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from ..operators.cutter import SILENCE_MS, Cutter, Limits
from ..operators.segmentation import silence_sessions
from ..sources.transcripts import TRANSCRIPT


def stream_transcripts(spark: SparkSession, path: str, handle: Callable[[DataFrame], tuple[DataFrame, DataFrame]], good_path: str, failed_path: str, checkpoint: str, max_files: int = 100, **trigger: Any) -> StreamingQuery:
    """Picks up new transcript files, each once; handle gives the good and the failed rows of a micro-batch."""
    raw = spark.readStream.schema(TRANSCRIPT).option("multiLine", "true").option("maxFilesPerTrigger", max_files).json(path).withColumn("doc_id", F.col("_metadata.file_path"))

    def sink(batch: DataFrame, epoch: int) -> None:
        # The epoch is part of the folder, so a batch that is run again replaces itself.
        good, failed = handle(batch)
        good.write.mode("overwrite").parquet(f"{good_path}/epoch={epoch}")
        failed.write.mode("overwrite").parquet(f"{failed_path}/epoch={epoch}")

    return raw.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stream_silence_sessions(words: DataFrame, delay: str = "10 seconds", gap_ms: int = SILENCE_MS) -> DataFrame:
    """Silence sessions of a live stream; words later than the watermark are dropped by Spark's rule (``late_rows`` counts them)."""
    return silence_sessions(words.withWatermark("ts", delay), gap_ms)


def late_rows(query: StreamingQuery) -> int:
    """Rows that a query's stateful operators have dropped for being later than the watermark, by its progress reports so far."""
    return sum(operator["numRowsDroppedByWatermark"] for p in query.recentProgress for operator in p["stateOperators"])


class LateRows(StreamingQueryListener):
    """Counts rows that arrive too late, by query id, for as long as it listens: spark.streams.addListener(LateRows())."""

    def __init__(self) -> None:
        self.dropped: Counter = Counter()

    def onQueryStarted(self, event: Any) -> None:
        pass

    def onQueryProgress(self, event: Any) -> None:
        self.dropped[str(event.progress.id)] += sum(o.numRowsDroppedByWatermark for o in event.progress.stateOperators)

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryTerminated(self, event: Any) -> None:
        pass


class OnlineCutter(StatefulProcessor):
    """Greedy cuts of live pieces; a piece is decided once the next one shows the silence after it.

    State of a document: the cutter's, of fixed size, and the last piece. A document is closed by its last
    piece where that is marked (``last``), and else by a timer of event time, once no
    more pieces come; a timer only fires when later events of any document move the watermark.
    Times are milliseconds since 1970 UTC throughout, so the session's zone has no part in it.
    """

    COUNTERS = ["seq", "start_ms", "end_ms", "cjk", "words", "characters"]

    def __init__(self, limits: Limits, idle_ms: int):
        self.limits, self.idle_ms = limits, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", "cutter array<bigint>, piece array<bigint>, ends boolean, proposed boolean, due bigint")

    def _load(self) -> tuple[Cutter, tuple | None, int]:
        if not self.state.exists():
            return Cutter(self.limits), None, 0
        cutter, piece, ends, proposed, due = self.state.get()
        return Cutter(self.limits, list(cutter)), (list(piece), ends, proposed), due

    def _decide(self, cutter: Cutter, last: tuple, gap: int) -> list[int]:
        piece, ends, proposed = last
        at = cutter.add(*piece, ends or gap >= self.limits.silence_ms, proposed)
        return [] if at is None else [at]

    def _close(self, cutter: Cutter, last: tuple) -> list[int]:
        cuts = self._decide(cutter, last, 0)
        return cuts if cutter.first is None else [*cuts, last[0][0]]

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        cutter, last, due = self._load()
        cuts: list[int] = []
        frame = pd.concat(list(rows)).sort_values("seq")
        for r in frame.itertuples(index=False):
            if last is not None:
                cuts += self._decide(cutter, last, max(0, r.start_ms - last[0][2]))
            last = ([int(getattr(r, c)) for c in self.COUNTERS], bool(r.ends), bool(r.proposed))
            if r.last:
                cuts += self._close(cutter, last)
                cutter, last = Cutter(self.limits), None
        if due:
            self.handle.deleteTimer(due)
        if last is None:
            self.state.clear()
        else:
            due = int(frame["ts_ms"].max()) + self.idle_ms
            self.handle.registerTimer(due)
            self.state.update((cutter.state(), *last, due))
        yield self._rows(key, cuts)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        cutter, last, _ = self._load()
        cuts = self._close(cutter, last) if last is not None else []
        self.state.clear()
        yield self._rows(key, cuts)

    @staticmethod
    def _rows(key: Any, cuts: list[int]) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": pd.Series([key[0]] * len(cuts), dtype=object), "seq": pd.Series(cuts, dtype="int32")})

    def close(self) -> None:
        pass


#: The state store that operators with timers need.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_constrain(pieces: DataFrame, limits: Limits = Limits(), delay: str = "10 seconds", idle_ms: int = 60_000) -> DataFrame:
    """doc_id, seq of the cuts of a live stream of pieces (doc_id, seq, ts, text, start_ms, end_ms, proposed, and last where it is known).

    Pieces of a document come in order from one micro-batch to the next. last (boolean, optional)
    marks the last piece of a document, which closes it at once; without it the tail of a
    document comes idle_ms after its last event, when the watermark has passed that. A piece after
    the last one begins the document anew. The session must keep state in RocksDB (PROVIDER = ROCKSDB).
    """
    from ..functions import text as T

    provider = pieces.sparkSession.conf.get(PROVIDER)
    if "RocksDB" not in provider:
        raise ValueError(f"set {PROVIDER} to {ROCKSDB}; {provider} has no timers")
    text = F.col("text")
    last = F.coalesce("last", F.lit(False)) if "last" in pieces.columns else F.lit(False)
    counted = pieces.withWatermark("ts", delay).select(
        "doc_id", F.col("seq").cast("int").alias("seq"), "ts", F.unix_millis("ts").alias("ts_ms"), "start_ms", "end_ms", T.cjk_count(text).alias("cjk"), T.latin_words(text).alias("words"),
        F.length(F.replace(text, F.lit(" "), F.lit(""))).alias("characters"), T.ends_sentence(text).alias("ends"), F.coalesce("proposed", F.lit(False)).alias("proposed"), last.alias("last"),
    )
    kind = pieces.schema["doc_id"].dataType.simpleString()
    return counted.groupBy("doc_id").transformWithStateInPandas(statefulProcessor=OnlineCutter(limits, idle_ms), outputStructType=f"doc_id {kind}, seq int", outputMode="Append", timeMode="EventTime")
