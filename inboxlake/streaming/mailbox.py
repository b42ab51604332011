"""Polling a mailbox as a stream: windows by cursor (S1), messages once (S4, ST2), sync state.

The sync state of an account is a log of transitions: ``polling`` before a poll, ``idle`` with the new cursor after it,
``error`` with the message if it fails.  The current state is the last transition, so a poll that died without a word
shows as ``polling`` and is stale once it is older than a poll may last.  A failed poll stops the stream with its
error; run again, the stream takes the same window.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import cursor
from ..sources.store import checkpoint_table
from .buckets import BucketedTable
from .dedup import COMPACT_EVERY
from .runner import run_until_drained

STATE = ("account string, seq long, poll long, status string, sync_cursor timestamp, last_polled_at timestamp, "
         "last_error string, new_messages long")
#: Seconds that a poll may last before it counts as dead.
UNIQUE_FOR = 300


class SyncState:
    """Transitions of an account's sync state, appended below ``path``."""

    def __init__(self, spark: SparkSession, path: str, account: str, clock: Callable[[], dt.datetime] | None = None):
        self.spark, self.path, self.account = spark, path, account
        self.clock = clock or (lambda: dt.datetime.now(dt.timezone.utc))

    def transitions(self) -> DataFrame:
        from ..sources.store import fs_exists
        if not fs_exists(self.spark, self.path):
            return self.spark.createDataFrame([], STATE)
        return self.spark.read.schema(STATE).parquet(self.path).where(F.col("account") == self.account)

    def current(self) -> DataFrame:
        """The last transition; no row before the first poll."""
        return latest_state(self.transitions())

    def move(self, poll: int, status: str, sync_cursor: dt.datetime | None, error: str | None = None,
             new_messages: int | None = None) -> None:
        """Appends a transition; a failed poll keeps the cursor there was."""
        last = self.current().first()
        seq, known = (last.seq + 1, last.sync_cursor) if last else (0, None)
        row = (self.account, seq, poll, status, sync_cursor or known, self.clock(), error, new_messages)
        self.spark.createDataFrame([row], STATE).coalesce(1).write.mode("append").parquet(self.path)


def latest_state(transitions: DataFrame) -> DataFrame:
    """The current row of every account."""
    cols = [c for c in transitions.columns if c != "account"]
    return (transitions.groupBy("account").agg(F.max_by(F.struct(*cols), F.col("seq")).alias("_s"))
            .select("account", "_s.*"))


def stale(transitions: DataFrame, now: Column, seconds: int = UNIQUE_FOR) -> DataFrame:
    """Accounts whose poll began more than ``seconds`` ago and has not ended."""
    late = F.unix_micros(now) - F.unix_micros(F.col("last_polled_at")) > seconds * 1_000_000
    return latest_state(transitions).where((F.col("status") == "polling") & late)


def poll_into(mailbox: DataFrame, table: BucketedTable, state: SyncState,
              before: Callable[[int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function of a stream of windows: the messages of each are inserted if absent.

    ``mailbox`` are all messages (the table's columns; received_at).  ``before`` is called with a poll's number before
    its messages are read (a connection check, a planned failure).
    """
    def run(windows: DataFrame, batch_id: int) -> None:
        for w in windows.collect():  # one row: a micro-batch is a poll
            state.move(w.poll, "polling", None)
            try:
                if before is not None:
                    before(w.poll)
                found = mailbox.where(cursor.in_window(F.col("received_at"), w.from_ts, w.until_ts))
                once = checkpoint_table(table.spark, found.dropDuplicates([table.key]), "poll")
                known = table.lookup(once, before=batch_id).select(table.key)
                table.write(once.join(known, table.key, "left_anti"), batch_id, rows=once.count())
                new = table.read(batch_id + 1).count() - table.read(batch_id).count()
                if (batch_id + 1) % COMPACT_EVERY == 0:
                    table.compact(batch_id)
            except Exception as e:
                state.move(w.poll, "error", None, str(e))
                raise
            state.move(w.poll, "idle", w.until_ts, None, new)
    return run


def poll_stream(spark: SparkSession, windows: DataFrame, mailbox: DataFrame, table: BucketedTable, state: SyncState,
                checkpoint: str, before: Callable[[int], None] | None = None) -> None:
    """Runs the polls there are; called again with the same checkpoint it goes on with the next, or the failed, one."""
    run_until_drained(windows.writeStream.foreachBatch(poll_into(mailbox, table, state, before))
                      .option("checkpointLocation", checkpoint))
