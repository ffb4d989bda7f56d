"""Progress folds: hand-made cases, and streams against batches."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lectern.streaming import progress
from lectern.streaming.current import CurrentState


@pytest.fixture(autouse=True)
def state_store(spark):
    spark.conf.set(*progress.STATE_STORE)
    yield
    spark.conf.unset(progress.STATE_STORE[0])

T0 = dt.datetime(2025, 1, 1)


def frames(spark, *events, session=1):
    rows = [(session, k, T0 + dt.timedelta(seconds=k), e if isinstance(e, str) else f"data: {json.dumps(e)}") for k, e in enumerate(events)]
    return spark.createDataFrame(rows, progress.FRAMES)


def log(phase, status):
    return {"type": "progress", "phase": phase, "status": status}


def places(df):
    return [r.phase for r in df.orderBy("place").collect()]


def test_decode_skips_what_is_no_event(spark):
    df = frames(spark, log("a", "running"), "data: {broken", "event: x", "data: 5", log("b", "completed"))
    assert [r.phase for r in progress.decode(df).orderBy("seq").collect()] == ["a", "b"]


def test_phase_log_in_place_and_moved(spark):
    events = progress.decode(frames(spark, log("a", "running"), log("b", "running"), log("a", "completed")))
    assert places(progress.latest_by_phase(events)) == ["a", "b"]
    assert places(progress.latest_by_phase(events, "last")) == ["b", "a"]
    assert progress.ratio(progress.latest_by_phase(events)).first().ratio == 50.0
    assert progress.session_phase(events).first().phase == "progress"


def said(phase, status, message, details=None):
    return {"type": "progress", "phase": phase, "message": message, "status": status, "details": details}


SESSION = [
    said("keyword", "running", "正在生成检索关键词..."), said("keyword", "completed", "成功生成 2 个关键词", "a, b"), said("search", "running", "正在执行Jina检索..."), said("analysis", "running", "准备分析检索结果..."),
    said("search", "running", "正在检索关键词... (1/2)", "已检索 1/2 个关键词"), said("analysis", "running", "正在分析关键词: a"), said("search", "completed", "正在检索关键词... (2/2)", "已检索 2/2 个关键词"),
    said("analysis", "running", "关键词分析完成: 7/9 (1/2)", "已完成 1/2 个关键词分析"), said("search", "completed", "Jina检索完成，获取 3 条结果"), said("cross-analysis", "running", "正在进行交叉分析..."),
    {"type": "draft-start", "keywords": [], "searchSnippets": [], "userInput": "u"}, {"type": "draft-chunk", "content": "ab"}, {"type": "draft-chunk", "content": "cd"}, said("cross-analysis", "completed", "交叉分析完成"),
    {"type": "draft-complete", "success": True, "draftMarkdown": "abcd!", "articleAnalysis": ""}]


def test_a_whole_session(spark):
    """Frames as the sender writes them, seen before, amid and after the draft."""
    at = lambda n: progress.decode(frames(spark, *SESSION[:n]))
    assert [progress.session_phase(at(n)).first().phase for n in (10, 11, 14, 15)] == ["progress", "draft-streaming", "draft-streaming", "draft-confirm"]
    assert [tuple(progress.counters(at(n)).first())[1:] for n in (1, 2, 5, 15)] == [(0, 0, 0), (0, 0, 2), (1, 0, 2), (2, 1, 2)]
    assert [tuple(progress.assemble_draft(at(n)).first())[1:] for n in (11, 13, 15)] == [("", True, False), ("abcd", True, False), ("abcd!", False, True)]
    assert progress.assemble_draft(at(10)).count() == 0


def test_drafts(spark):
    chunk = lambda x: {"type": "draft-chunk", "content": x}
    done = {"type": "draft-complete", "draftMarkdown": "xy!"}
    open_draft = progress.assemble_draft(progress.decode(frames(spark, chunk("x"), chunk("y")))).first()
    assert (open_draft.text, open_draft.streaming, open_draft.complete) == ("xy", True, False)
    full = progress.assemble_draft(progress.decode(frames(spark, chunk("x"), chunk("y"), done))).first()
    assert (full.text, full.complete) == ("xy!", True)


def streamed(spark, tmp_path, df, fold, mode):
    """The last state of each key after the files of df have been read one by one."""
    for k in range(3):
        df.where(f"seq % 3 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = progress.decode(spark.readStream.schema(progress.FRAMES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    seen = []
    run = fold(stream).writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(lambda b, n: seen.append([r.asDict() for r in b.collect()])).start()
    run.awaitTermination()
    return seen


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    from lectern.plans.tables import table

    df = table(spark, sf_dir, "frames").select("session_id", "seq", "ts", "line").cache()
    events = progress.decode(df)
    latest = {}
    for batch in streamed(spark, tmp_path / "a", df, progress.latest_by_phase, "update"):
        latest.update({(r["session_id"], r["phase"]): r for r in batch})
    want = {(r.session_id, r.phase): r.asDict() for r in progress.latest_by_phase(events).collect()}
    assert latest == want
    drafts = {}
    for batch in streamed(spark, tmp_path / "b", df, lambda e: progress.assemble_draft_stream(e, "60 days"), "update"):
        drafts.update({r["session_id"]: r for r in batch})
    assert drafts == {r.session_id: r.asDict() for r in progress.assemble_draft(events).collect()}


def start(spark, path, out, fold=progress.assemble_draft_stream, **options):
    stream = progress.decode(spark.readStream.schema(progress.FRAMES).parquet(f"{path}/in"))
    return fold(stream, **options).writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(out).start()


def test_drafts_go_on_after_a_restart(spark, tmp_path):
    """A query stopped amid a draft and started again from its checkpoint."""
    events = [{"type": "draft-start"}, *({"type": "draft-chunk", "content": f"{k} " * 50} for k in range(20)), {"type": "draft-complete", "draftMarkdown": "done"}]
    df, seen = frames(spark, *events), []
    for first, last in ((0, 8), (8, 9), (9, 21), (21, 22)):
        df.where(f"seq >= {first} and seq < {last}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        start(spark, tmp_path, lambda b, n: seen.extend(r.asDict() for r in b.collect())).awaitTermination()
    want = ["".join(f"{k} " * 50 for k in range(n)) for n in (7, 8, 20)]
    assert [r["text"] for r in seen] == [*want, "done"] and [r["complete"] for r in seen] == [False] * 3 + [True]


def test_late_and_repeated_chunks(spark, tmp_path):
    df, seen = frames(spark, *({"type": "draft-chunk", "content": x} for x in "abcd")), []
    for part in (df.where("seq in (0, 3)"), df.where("seq in (1, 3)"), df.where("seq = 2")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        start(spark, tmp_path, lambda b, n: seen.extend(r.text for r in b.collect())).awaitTermination()
    assert seen == ["ad", "abd", "abcd"]


def test_idle_drafts_are_dropped(spark, tmp_path):
    late = T0 + dt.timedelta(hours=5)
    rows = [(1, 0, T0, "a"), (2, 1, late, "x"), (2, 2, late + dt.timedelta(hours=5), "y"), (1, 3, late + dt.timedelta(hours=6), "b")]
    seen = []
    for session, seq, ts, text in rows:
        line = "data: " + json.dumps({"type": "draft-chunk", "content": text})
        spark.createDataFrame([(session, seq, ts, line)], progress.FRAMES).write.mode("append").parquet(str(tmp_path / "in"))
        start(spark, tmp_path, lambda b, n: seen.extend((r.session_id, r.text) for r in b.collect()), delay="1 minute").awaitTermination()
    assert seen == [(1, "a"), (2, "x"), (2, "xy"), (1, "b")]  # the first had been idle when time went on; the second was still there when its next chunk came


def test_current_state_is_idempotent(spark, tmp_path):
    kind = "k long, name string, v long"
    rows = lambda *r: spark.createDataFrame(list(r), kind)
    table = CurrentState(str(tmp_path / "table"), ["k", "name"], "v", buckets=4)
    read = lambda: sorted(map(tuple, table.read(spark, kind).collect()), key=repr)
    assert read() == []
    first = rows((1, "a", 1), (1, None, 2), (2, "b", 3), (2, "b", 4))
    table.merge(first, 0)
    assert read() == [(1, "a", 1), (1, None, 2), (2, "b", 4)]
    table.merge(rows((9, "z", 9)), 0)  # played again: nothing changes
    assert read() == [(1, "a", 1), (1, None, 2), (2, "b", 4)]
    table.merge(rows((1, None, 5), (3, "c", 6)), 1)
    want = [(1, "a", 1), (1, None, 5), (2, "b", 4), (3, "c", 6)]
    assert read() == want
    rows((7, "broken", 7)).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(str(tmp_path / "table/data/version=2"))  # a batch that broke off before its commit
    assert read() == want
    table.merge(rows((1, "a", 8)), 2)
    assert read() == [(1, "a", 8), *want[1:]]
    table.merge(rows(), 3)
    table.merge(rows((1, "a", 0)), 1)
    assert read() == [(1, "a", 8), *want[1:]]
    for n in range(4, 8):
        table.merge(rows((n, "n", n)), n)
    assert len(read()) == 8 and len(list((tmp_path / "table/commits").iterdir())) == 2


def test_current_state_of_a_stream(spark, sf_dir):
    from lectern.plans import queries

    got = {(r.session_id, r.phase): r.status for r in queries.x2_current_state(spark, sf_dir).collect()}
    assert got == {(r.session_id, r.phase): r.status for r in queries.x2_latest_by_phase(spark, sf_dir).collect()}


def test_document_sessions_are_counted(spark):
    logs = [said("document-analysis", "running", "正在分析文档内容..."), said("document-analysis", "running", "文档分析完成: a.md (1/3)", "已完成 1/3 个文档分析"), said("document-analysis", "running", "文档分析失败: b.md (2/3)")]
    at = lambda n: tuple(progress.counters(progress.decode(frames(spark, *logs[:n]))).first())[1:]
    assert [at(n) for n in (1, 2, 3)] == [(0, 0, 0), (0, 1, 3), (0, 2, 3)]


def test_windowed_state_is_bounded(spark, sf_dir):
    """With a gap the fold groups by session window too, so a watermark can drop it."""
    from lectern.plans.tables import table

    events = progress.decode(table(spark, sf_dir, "frames"))
    out = progress.latest_by_phase(events, gap="1 hour")
    assert "session" in out.columns and out.count() >= progress.latest_by_phase(events).count()


def test_a_draft_sets_one_timer_and_reads_nothing_of_a_new_session():
    from datetime import datetime, timezone
    from types import SimpleNamespace

    from pyspark.sql import Row

    calls = []

    class State:
        value = None

        def __init__(self, name):
            self.name, self.rows = name, []

        def get(self):
            calls.append(f"{self.name}.get")
            return self.value if self.name != "chunks" else iter(self.rows)

        def update(self, row):
            self.value = tuple(row)

        def appendList(self, rows):
            self.rows += [tuple(r) for r in rows]

        def clear(self):
            self.value, self.rows = None, []

    timers = []
    handle = SimpleNamespace(getListState=lambda name, *_: State(name), getValueState=lambda name, *_: State(name), registerTimer=timers.append)
    clock = SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
    chunk = lambda s, text: Row(type="draft-chunk", seq=s, content=text, ts=datetime.fromtimestamp(s, timezone.utc))
    draft = progress.DraftProcessor(1000, None)
    draft.init(handle)
    assert [r.text for r in draft.handleInputRows((1,), iter([chunk(2, "b"), chunk(1, "a")]), clock)] == ["ab"]
    assert calls == ["latest.get"] and timers == [3000]
    assert [r.text for r in draft.handleInputRows((1,), iter([chunk(5, "c")]), clock)] == ["abc"] and timers == [3000]
    list(draft.handleExpiredTimer((1,), clock, SimpleNamespace(getExpiryTimeInMs=lambda: 3000)))
    assert timers == [3000, 6000] and draft.chunks.rows
    list(draft.handleExpiredTimer((1,), clock, SimpleNamespace(getExpiryTimeInMs=lambda: 6000)))
    assert not draft.chunks.rows and draft.latest.value is None
