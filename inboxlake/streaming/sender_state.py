"""Rolling sender statistics with retraction (ST5, A8-A10 on a stream).

A stream of triage results is keyed by message.  A bucketed table holds one
small row per message: the snapshot it last folded in.  A micro-batch is
reduced to each message's newest result, meets the stored snapshots of its own
messages only (``buckets.lookup``), and writes signed deltas: the retraction of
an older snapshot and the new contribution; an older or repeated result writes
nothing.  All of it is SQL on the JVM, no Python call a message.  Deltas are
written per batch, so a batch that is run again replaces its own and adds
nothing twice.  Sender statistics are sums over the delta log per sender /
(sender, label) -- associative, so a hot sender is pre-aggregated in every map
task.  fold + revisions == rebuild.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.latest import latest_per_key
from ..operators.reputation import iso8601
from ..schemas import RECENT_ACTIONS_LIMIT
from ..sources.store import checkpoint_table
from .buckets import BucketedTable
from .runner import fresh_paths, run_available_now

# what a message folds in; times are microseconds since the epoch (seen_at: its arrival, at: its result)
SNAP_SCHEMA = ("triage_id long, sender_email string, category string, action string, urgency_weight long, "
               "confidence long, seen_at long, at long")
SNAP_COLS = [c.split()[0] for c in SNAP_SCHEMA.split(", ")]
DELTA_SCHEMA = f"email_id long, {SNAP_SCHEMA}, new_email long, sign long"
NUMBERS = ("urgency_weight", "confidence")  # a null adds nothing to a sum; a retraction takes them back
COMPACT_EVERY = 16


def snapshots(spark: SparkSession, path: str) -> BucketedTable:
    return BucketedTable(spark, path, f"email_id long, {SNAP_SCHEMA}", "email_id")


def _signed(side: str, sign: int, new_email: Column) -> Column:
    cols = [(F.col(f"{side}.{c}") * sign if c in NUMBERS else F.col(f"{side}.{c}")).alias(c) for c in SNAP_COLS]
    return F.struct(*cols, new_email.cast("long").alias("new_email"), F.lit(sign).cast("long").alias("sign"))


def fold(newest: DataFrame, stored: DataFrame) -> DataFrame:
    """Signed deltas of each message's newest result against its stored snapshots (columns of DELTA_SCHEMA).

    Of several stored snapshots the newest counts.  A result that isn't newer gives nothing.
    """
    old = (stored.groupBy("email_id").agg(F.max_by(F.struct(*SNAP_COLS), F.col("triage_id")).alias("old")))
    new = newest.select("email_id", F.struct(*SNAP_COLS).alias("new"))
    first = F.col("old").isNull()
    moved = (~F.col("old.sender_email").eqNullSafe(F.col("new.sender_email"))).cast("long")
    return (new.join(old, "email_id", "left").where(first | (F.col("old.triage_id") < F.col("new.triage_id")))
            .select("email_id", F.explode(F.when(first, F.array(_signed("new", 1, F.lit(1)))).otherwise(
                F.array(_signed("old", -1, -moved), _signed("new", 1, moved)))).alias("d"))
            .select("email_id", "d.*"))


def fold_into(table: BucketedTable, log: str, compact_every: int = COMPACT_EVERY) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that folds results into the snapshots and writes their deltas below ``log``."""
    def run(batch: DataFrame, batch_id: int) -> None:
        newest = checkpoint_table(table.spark, latest_per_key(batch, "email_id", "triage_id", SNAP_COLS), "newest")
        deltas = fold(newest, table.lookup(newest, before=batch_id))
        path = f"{log}/batch={batch_id}"
        deltas.write.mode("overwrite").parquet(path)
        # what was folded in becomes the snapshot: read back, so both say the same
        table.write(table.spark.read.schema(DELTA_SCHEMA).parquet(path).where("sign = 1"), batch_id,
                    rows=newest.count())
        if compact_every and (batch_id + 1) % compact_every == 0:
            table.compact(batch_id, lambda rows: latest_per_key(rows, "email_id", "triage_id", SNAP_COLS))
    return run


def fold_stream(spark: SparkSession, source_path: str, schema, sink: str | None = None,
                checkpoint: str | None = None) -> DataFrame:
    """Run the result stream (email_id and the columns of ``SNAP_SCHEMA``) to completion; return the delta log.

    ``sink`` and ``checkpoint`` belong to the caller: called again with the same two, the stream goes on where it
    stopped.  Without them a run gets new ones.
    """
    if sink is None or checkpoint is None:
        sink, checkpoint = fresh_paths(spark, "sender_deltas")
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source_path)
              .select("email_id", *[F.coalesce(c, F.lit(0)).alias(c) if c in NUMBERS else F.col(c) for c in SNAP_COLS]))
    run_available_now(stream.writeStream.foreachBatch(fold_into(snapshots(spark, f"{sink}/snapshots"), f"{sink}/deltas"))
                      .option("checkpointLocation", checkpoint))
    return spark.read.schema(DELTA_SCHEMA).parquet(f"{sink}/deltas")


def stats_from_deltas(deltas: DataFrame) -> DataFrame:
    """Sender scalars from the delta log (A7 as sums; averages derived)."""
    s = deltas.groupBy("sender_email").agg(
        F.sum("new_email").alias("email_count"), F.sum("urgency_weight").alias("urgency_sum"),
        F.sum("confidence").alias("confidence_sum"), F.max("seen_at").alias("seen_at")).where("email_count > 0")
    return s.select("sender_email", "email_count",
                    (F.col("urgency_sum") / F.col("email_count")).alias("avg_urgency_score"),
                    (F.col("confidence_sum") / F.col("email_count")).alias("avg_confidence"),
                    F.timestamp_micros("seen_at").alias("last_seen_at"))


def recent_from_deltas(deltas: DataFrame, n: int = RECENT_ACTIONS_LIMIT) -> DataFrame:
    """Newest ``n`` (action, category, at) per sender (A12): each message's last contribution, newest message first."""
    cur = latest_per_key(deltas.where(F.col("sign") == 1), "email_id", "triage_id",
                         ["sender_email", "action", "category", "seen_at", "at"])
    w = Window.partitionBy("sender_email").orderBy(F.col("seen_at").desc(), F.col("email_id").desc())
    return (cur.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= n)
            .select("sender_email", "pos", "action", "category", iso8601(F.timestamp_micros("at")).alias("at")))


def histograms_from_deltas(deltas: DataFrame) -> DataFrame:
    """(sender_email, kind, label, n) with empty bins removed (A10)."""
    cat = deltas.select("sender_email", F.lit("category").alias("kind"), F.col("category").alias("label"), "sign")
    act = deltas.select("sender_email", F.lit("action").alias("kind"), F.col("action").alias("label"), "sign")
    return (cat.unionByName(act).groupBy("sender_email", "kind", "label")
            .agg(F.sum("sign").alias("n")).where(F.col("n") > 0))
