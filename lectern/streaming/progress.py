"""Progress event streams: frames decoded and folded to the current state, as batch or stream.

Frames are lines ``data: {json}`` of a session. State is bounded by session windows: with
``gap`` the folds group by a session window of the event time under a watermark, and state of
closed windows goes; without it (batch) by session only.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

EVENT = "type string, phase string, status string, message string, details string, content string, draftMarkdown string"
# The state that an event puts its session in; events of the later states are those of the reader's own actions.
STATES = {"draft-start": "draft-streaming", "draft-complete": "draft-confirm", "book-search": "book-search", "book-selection": "book-selection", "report-streaming": "report-streaming", "completed": "completed"}
# How progress logs say n of total keywords, and how many there are.
SEARCHED, ANALYSED, KEYWORDS = r"(?:已检索 |\()(\d+)/(\d+)", r"(?:已完成 |\()(\d+)/(\d+)", r"成功生成 (\d+) 个关键词"
FRAMES = "session_id long, seq long, ts timestamp, line string"


def read_frames(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A stream of frames from files of (session_id, seq, ts, line)."""
    return spark.readStream.schema(FRAMES).format(fmt).load(path)


def decode(frames: DataFrame) -> DataFrame:
    """Typed events of frames; other lines and broken JSON are skipped."""
    body = frames.where(F.col("line").startswith("data: ")).withColumn("e", F.from_json(F.substring("line", 7, 1 << 30), EVENT))
    good = body.where(F.col("e.type").isNotNull())
    return good.select("session_id", "seq", "ts", "e.*")


def _by(events: DataFrame, keys: list[str], gap: str | None, delay: str) -> tuple[DataFrame, list]:
    if gap is None:
        return events, list(keys)
    return events.withWatermark("ts", delay), [*keys, F.session_window("ts", gap).alias("session")]


def latest_by_phase(events: DataFrame, order: str = "first", gap: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """(session_id, phase, status, message, details, place): the last log of each phase.

    place orders the phases: by first sight, or with ``order='last'`` by last change.
    """
    logs, keys = _by(events.where("phase is not null"), ["session_id", "phase"], gap, delay)
    place = F.min("seq") if order == "first" else F.max("seq")
    out = logs.groupBy(*keys).agg(F.max_by(F.struct("status", "message", "details"), "seq").alias("s"), place.alias("place"))
    return out.select("session_id", "phase", "s.*", "place", *(["session"] if gap else []))


def session_phase(events: DataFrame, gap: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """(session_id, phase): the state of each session, by the last event that changes it; progress until then."""
    logs, keys = _by(events, ["session_id"], gap, delay)
    pairs = [F.lit(x) for kv in STATES.items() for x in kv]
    state = F.try_element_at(F.create_map(*pairs), F.col("type"))
    last = F.max_by(state, F.when(state.isNotNull(), F.col("seq")))
    return logs.groupBy(*keys).agg(F.coalesce(last, F.lit("progress")).alias("phase"))


def counters(events: DataFrame, gap: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """(session_id, searched, analysed, total): keywords, or documents, done and in all, as the progress logs say.

    Logs report n of total in their details, or else at the end of their message; sessions on
    uploaded documents have no search, their documents count as analysed. A session whose logs
    report none has zeros.
    """
    logs, keys = _by(events, ["session_id"], gap, delay)
    said = F.concat_ws(" ", "details", "message")

    def most(phase: str, pattern: str, k: int) -> Column:
        return F.max(F.when(F.col("phase").isin(*phase.split()), F.regexp_extract(said, pattern, k).try_cast("long")))

    total = F.greatest(most("search", SEARCHED, 2), most("analysis document-analysis", ANALYSED, 2), most("keyword", KEYWORDS, 1))
    made = {"searched": most("search", SEARCHED, 1), "analysed": most("analysis document-analysis", ANALYSED, 1), "total": total}
    return logs.groupBy(*keys).agg(*[F.coalesce(c, F.lit(0).cast("long")).alias(n) for n, c in made.items()])


def ratio(latest: DataFrame) -> DataFrame:
    """(session_id, ratio): completed phases in percent of all."""
    return latest.groupBy("session_id").agg((F.count_if(F.col("status") == "completed") * 100.0 / F.greatest(F.count("*"), F.lit(1))).alias("ratio"))


def assemble_draft(events: DataFrame) -> DataFrame:
    """(session_id, text, streaming, complete): chunks in order, or the text that completed them (X4), as a batch."""
    drafts = events.where("type like 'draft-%'")
    chunk = F.when(F.col("type") == "draft-chunk", F.struct(F.col("seq").alias("o"), F.coalesce("content", F.lit("")).alias("l")))
    whole = F.max_by(F.when(F.col("type") == "draft-complete", F.coalesce("draftMarkdown", F.lit(""))), F.when(F.col("type") == "draft-complete", F.col("seq")))
    made = F.array_join(F.transform(F.sort_array(F.collect_list(chunk)), lambda r: r["l"]), "")
    out = drafts.groupBy("session_id").agg(made.alias("made"), whole.alias("whole"), F.bool_or(F.col("type") == "draft-complete").alias("complete"))
    return out.select("session_id", F.coalesce("whole", "made").alias("text"), (~F.col("complete")).alias("streaming"), "complete")


#: The state store that the stream of drafts needs, as a setting of its session.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
DRAFT = "session_id long, text string, streaming boolean, complete boolean"


class DraftProcessor(StatefulProcessor):
    """A session's draft: chunks are appended to a list as they come, so a batch writes its own chunks only.

    Chunks carry their seq, so that a late one falls into its place and a repeated one counts
    once; the text that completes a draft replaces them, and they are dropped. A session has one
    timer; only when it fires is it set anew if events came since.
    """

    def __init__(self, idle: int, ttl: int | None):
        self.idle, self.ttl = idle, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunks = handle.getListState("chunks", "seq long, content string", self.ttl)
        self.whole = handle.getValueState("whole", "seq long, content string", self.ttl)
        self.latest = handle.getValueState("latest", "at long", None) if self.ttl is None else None

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        seen = self.latest.get() if self.latest else None
        known = self.latest is None or seen is not None  # else nothing is stored for the session
        had = self.whole.get() if known else None
        new, whole, latest = [], had, 0
        for r in rows:
            latest = max(latest, int(r.ts.timestamp() * 1000))
            if r.type == "draft-chunk":
                new.append(Row(seq=r.seq, content=r.content or ""))
            elif r.type == "draft-complete" and (whole is None or r.seq > whole[0]):
                whole = Row(seq=r.seq, content=r.draftMarkdown or "")
        if whole is None:
            if new:
                self.chunks.appendList(new)
            stored = self.chunks.get() if known else ((r.seq, r.content) for r in new)
            text = "".join(content for _, content in sorted({c[0]: c[1] for c in stored}.items()))
        else:
            if whole is not had:
                self.whole.update(whole)
                if known:
                    self.chunks.clear()
            text = whole[1]
        if self.ttl is None:  # by event time: the session goes when it has been idle
            at = max(latest, timerValues.getCurrentWatermarkInMs())
            if seen is None:
                self.handle.registerTimer(at + self.idle)
            if seen is None or at > seen[0]:
                self.latest.update(Row(at=at))
        yield Row(session_id=key[0], text=text, streaming=whole is None, complete=whole is not None)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        ends = self.latest.get()[0] + self.idle
        if ends > expiredTimerInfo.getExpiryTimeInMs():  # events came since
            self.handle.registerTimer(ends)
            return iter(())
        self.chunks.clear()
        self.whole.clear()
        self.latest.clear()
        return iter(())

    def close(self) -> None:
        pass


def assemble_draft_stream(events: DataFrame, delay: str = "10 minutes", idle: int = 3_600_000, ttl: int | None = None) -> DataFrame:
    """The same of a stream, in update mode; sessions idle for so many milliseconds of event time are dropped.

    With ttl, state is dropped by the clock instead: what has not been written for so many
    milliseconds goes. The session must name STATE_STORE before the query starts.
    """
    drafts = events.where("type like 'draft-%'").withWatermark("ts", delay)
    return drafts.groupBy("session_id").transformWithState(DraftProcessor(idle, ttl), DRAFT, "Update", "eventTime" if ttl is None else "processingTime")
