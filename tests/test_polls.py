"""Polls by cursor (S1), sync state (S5), back-off between attempts (ST7)."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from inboxlake.schemas import BACKOFF_SECONDS
from inboxlake.session import shared_path
from inboxlake.sources import cursor
from inboxlake.streaming import mailbox
from inboxlake.streaming.buckets import BucketedTable

UTC = dt.timezone.utc


def at(minute):
    return dt.datetime(2024, 1, 1, 12, minute, tzinfo=UTC)


def test_windows_follow_the_cursor_and_overlap():
    r = cursor.PollReader({"start": "2024-01-01T12:00:00", "end": "2024-01-01T12:12:00", "every": "300", "overlap": "60"})
    offset, seen = r.initialOffset(), []
    while True:
        rows, end = r.read(offset)
        rows = list(rows)
        if not rows:
            break
        assert rows == list(r.readBetweenOffsets(offset, end))   # a poll run again reads the same window
        seen += rows
        offset = end
    assert seen == [(0, at(0) - dt.timedelta(minutes=1), at(5)), (1, at(4), at(10)), (2, at(9), at(12))]
    assert list(r.read(offset)[0]) == [] and r.read(offset)[1] == offset
    live = cursor.PollReader({"start": (dt.datetime.now(UTC) - dt.timedelta(seconds=450)).replace(tzinfo=None).isoformat()})
    _, first = live.read(live.initialOffset())
    assert first["poll"] == 1 and list(live.read(first)[0]) == []  # the next window hasn't ended yet


def test_polls_stop_and_go_on(spark):
    rows = [(f"m{i}", at(i)) for i in range(10)] + [("m3", at(3))]
    box = spark.createDataFrame(rows, "gmail_id string, received_at timestamp")
    path = shared_path(spark, "t", uuid.uuid4().hex)
    table = BucketedTable(spark, f"{path}/m", "gmail_id string, received_at timestamp", "gmail_id")
    clock = iter(at(30) + dt.timedelta(seconds=i) for i in range(100))
    state = mailbox.SyncState(spark, f"{path}/s", "a", lambda: next(clock))
    windows = cursor.polls(spark, "2024-01-01T12:00:00", "2024-01-01T12:10:00", 180, 120)
    assert state.current().count() == 0

    def fails(poll):
        if poll == 2:
            raise ConnectionError("no route to the mail server")
    with pytest.raises(Exception, match="no route"):
        mailbox.poll_stream(spark, windows, box, table, state, f"{path}/c", fails)
    now = state.current().first()
    assert (now.status, now.last_error, now.poll) == ("error", "no route to the mail server", 2)
    assert now.sync_cursor == at(6).replace(tzinfo=None)             # a failed poll keeps the cursor
    assert sorted(r.gmail_id for r in table.read().collect()) == [f"m{i}" for i in range(6)]
    mailbox.poll_stream(spark, windows, box, table, state, f"{path}/c")
    assert sorted(r.gmail_id for r in table.read().collect()) == [f"m{i}" for i in range(10)]
    log = [(r.poll, r.status, r.new_messages) for r in state.transitions().orderBy("seq").collect()]
    assert log == [(0, "polling", None), (0, "idle", 3), (1, "polling", None), (1, "idle", 3), (2, "polling", None),
                   (2, "error", None), (2, "polling", None), (2, "idle", 3), (3, "polling", None), (3, "idle", 1)]
    assert state.current().first().last_error is None


def test_stale_polls(spark):
    rows = [("a", 0, 0, "polling", None, at(0), None, None), ("b", 0, 0, "polling", None, at(0), None, None),
            ("b", 1, 0, "idle", at(0), at(1), None, 4), ("c", 0, 0, "polling", None, at(9), None, None)]
    t = spark.createDataFrame(rows, mailbox.STATE)
    stale = lambda minute: sorted(r.account for r in mailbox.stale(
        t, F.lit(at(minute))).collect())
    assert stale(4) == [] and stale(6) == ["a"] and stale(15) == ["a", "c"]


def test_retries_wait_for_their_time(spark):
    from inboxlake.streaming import pipeline as pl
    from inboxlake.streaming.runner import land_polls
    mail = "From: Ann <ann{0}@a.example>\r\nMessage-ID: <m{0}@a.example>\r\nSubject: hi\r\n\r\nBody {0}"
    raw = spark.createDataFrame([(i, bytearray(mail.format(i).encode())) for i in range(3)], "uid long, content binary")
    good = '{"category_proposal": {"category": "Topic", "reasoning": "new"}, "confidence": 90}'
    # message 0 at once, message 1 at its second attempt, message 2 never
    answers = spark.createDataFrame([(0, 1, good), (1, 2, good), (2, 1, "5"), (2, 2, "null"), (2, 3, "{")],
                                    "id long, attempt int, raw string")
    seed = pl.empty_seed(spark, categories=spark.createDataFrame(
        [(1, "Banking", "active", None, None, None)], pl.SCHEMAS["categories"]))
    start, waited = F.lit("2024-01-01 12:00:00").cast("timestamp"), []
    path = land_polls(spark, raw.withColumn("poll", F.lit(0)), "backoff_test", "poll", 1)
    store = pl.run_pipeline(spark, path, raw.schema, seed, lambda b: start, answers=answers, wait=waited.append)
    step = dt.timedelta(seconds=BACKOFF_SECONDS["triage"])
    first = dt.datetime(2024, 1, 1, 12)
    assert waited == [first + step, first + 2 * step]
    logs = sorted((r.email_id, r.attempt, r.status, (r.recorded_at - first) / step)
                  for r in store.read("logs").where("stage = 'triage' AND status <> 'started'").collect())
    assert logs == [(0, 1, "succeeded", 0), (1, 1, "failed", 0), (1, 2, "succeeded", 1), (2, 1, "failed", 0),
                    (2, 2, "failed", 1), (2, 3, "failed", 2)]
    status = {r.id: r.pipeline_status for r in pl.pipeline_status(store).collect()}
    assert status == {0: "completed", 1: "completed", 2: "failed"} and pl.pending_retries(store) == 0
    assert {r.llm_backend for r in store.read("results").collect()} == {"stored"}
