"""Exactly-once ingest across overlapping polls (ST1, ST2, S4 streaming form).

Polls overlap (a cursor window re-reads recent messages), so the same message
arrives more than once, and a first delivery may arrive however late.  Every
micro-batch is reduced to one row per key and anti-joined with the stored rows
of its keys (insert if absent), then written as its own part of a bucketed
table.  The lookup opens only buckets that may hold one of the batch's keys, so
what a batch reads doesn't grow with the history.  A replayed batch replaces
its part with the same rows, so the sink holds every key once across failures
and restarts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.store import checkpoint_table
from .buckets import BucketedTable
from .runner import fresh_paths, run_available_now

COMPACT_EVERY = 16  # batches between compactions


def dedup_stream(spark: SparkSession, source_path: str, schema, key: str, files_per_trigger: int = 1,
                 sink: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Stream the landed files, insert rows whose ``key`` is absent, return the rows of the sink."""
    return dedup_table(spark, source_path, schema, key, files_per_trigger, sink, checkpoint).read()


def dedup_table(spark: SparkSession, source_path: str, schema, key: str, files_per_trigger: int = 1,
                sink: str | None = None, checkpoint: str | None = None,
                compact_every: int = COMPACT_EVERY) -> BucketedTable:
    """``dedup_stream``, returning the table itself (what its lookups opened is in ``opened``).

    ``sink`` and ``checkpoint`` belong to the caller: called again with the
    same two, the stream goes on where it stopped.  Without them a run gets
    new ones.
    """
    if sink is None or checkpoint is None:
        sink, checkpoint = fresh_paths(spark, "dedup")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    table = BucketedTable(spark, sink, ddl, key)
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
              .parquet(source_path))
    run_available_now(stream.writeStream.foreachBatch(insert_absent_into(table, compact_every))
                      .option("checkpointLocation", checkpoint))
    return table


def insert_absent_into(table: BucketedTable, compact_every: int = COMPACT_EVERY) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that adds the rows whose key the table doesn't hold."""
    def insert(batch: DataFrame, batch_id: int) -> None:
        # stored once: looked up, counted and written without reading the source again
        once = checkpoint_table(table.spark, batch.dropDuplicates([table.key]), "dedup")
        fresh = once.join(table.lookup(once, before=batch_id).select(table.key), table.key, "left_anti")
        table.write(fresh, batch_id, rows=once.count())
        if compact_every and (batch_id + 1) % compact_every == 0:
            table.compact(batch_id)
    return insert
