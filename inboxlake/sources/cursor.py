"""Polls as a stream (S1, E5, ST1): a Python data source whose offset is the poll cursor.

Every micro-batch is one poll.  The source itself yields one row a poll, its window of time; the messages of the window
are then read by Spark from the mailbox table, with the window as a pushed-down filter, so nothing but windows passes
through the driver.  Windows overlap: a poll reads again what arrived shortly before its cursor, since mail may be
delivered late; who has been seen already is the sink's matter (insert-if-absent).  The cursor is the stream's offset,
kept in its checkpoint: a stream that stops goes on with the window it hadn't finished.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..session import ship_package

SCHEMA = "poll long, from_ts timestamp, until_ts timestamp"
#: Seconds between polls, and how far a window reaches back before its cursor.
EVERY, OVERLAP = 300, 3600


def _time(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text).replace(tzinfo=dt.timezone.utc)


class PollReader(SimpleDataSourceStreamReader):
    """Offsets {"cursor": end of the last window, "poll": its number}; options as in ``polls``."""

    def __init__(self, options: dict):
        self.start, self.end = options["start"], options.get("end")
        self.every = dt.timedelta(seconds=float(options.get("every", EVERY)))
        self.overlap = dt.timedelta(seconds=float(options.get("overlap", OVERLAP)))

    def initialOffset(self) -> dict:
        return {"cursor": _time(self.start).isoformat(), "poll": 0}

    def _last(self) -> dt.datetime:
        return _time(self.end) if self.end else dt.datetime.now(dt.timezone.utc)

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        """The next window, if it has begun, and the offset after it."""
        cursor = dt.datetime.fromisoformat(start["cursor"])
        last = self._last()
        if cursor >= last or not self.end and cursor + self.every > last:
            return iter([]), start
        end = {"cursor": min(cursor + self.every, last).isoformat(), "poll": start["poll"] + 1}
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """The window between two offsets: a poll that is run again reads the same one."""
        if start["cursor"] == end["cursor"]:
            return iter([])
        return iter([(start["poll"], dt.datetime.fromisoformat(start["cursor"]) - self.overlap,
                      dt.datetime.fromisoformat(end["cursor"]))])


class PollSource(DataSource):
    """Format ``polls``."""

    @classmethod
    def name(cls) -> str:
        return "polls"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> PollReader:
        return PollReader(self.options)


def polls(spark: SparkSession, start: str, end: str | None = None, every: float = EVERY,
          overlap: float = OVERLAP) -> DataFrame:
    """A stream of poll windows from ``start`` on (ISO time, UTC), ``every`` seconds one, up to ``end`` or for ever."""
    ship_package(spark)
    spark.dataSource.register(PollSource)
    options = {"start": start, "every": str(every), "overlap": str(overlap)} | ({"end": end} if end else {})
    return spark.readStream.format("polls").options(**options).load()


def in_window(received_at: Column, from_ts, until_ts) -> Column:
    """Messages of a poll: from the overlap on, up to and without the window's end."""
    return (received_at >= F.lit(from_ts)) & (received_at < F.lit(until_ts))
