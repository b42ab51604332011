"""Latest-row-per-key (A1), the queue's left join to it (J1), soft-delete scope
and the pipeline-status backfill (J5 / Q6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def alive(df: DataFrame, deleted_col: str = "deleted_at") -> DataFrame:
    """Default soft-delete scope; call sites that need trashed rows simply skip it."""
    return df.where(F.col(deleted_col).isNull())


def latest_per_key(df: DataFrame, key: str = "email_id", order: str = "id",
                   cols: list[str] | None = None) -> DataFrame:
    """One row per ``key``: the row with the highest ``order`` value.

    ``max_by(struct, order)`` is one aggregation (map-side partial, one
    shuffle on ``key``) instead of the GROUP BY + self-join of the reference.
    A hot key costs one partial row per map partition, not its full row set.
    """
    cols = cols or [c for c in df.columns if c != key]
    packed = F.struct(*[F.col(c) for c in cols])
    return (df.groupBy(key)
              .agg(F.max_by(packed, F.col(order)).alias("_l"))
              .select(key, *[F.col(f"_l.{c}").alias(c) for c in cols]))


def with_latest(emails: DataFrame, triage: DataFrame, cols: list[str],
                prefix: str = "", how: str = "left") -> DataFrame:
    """Left join of messages to their latest triage result."""
    latest = latest_per_key(triage, "email_id", "id", cols)
    renamed = latest.select(F.col("email_id").alias("_eid"),
                            *[F.col(c).alias(prefix + c) for c in cols])
    return emails.join(renamed, emails["id"] == renamed["_eid"], how).drop("_eid")


def pipeline_status_backfill(emails: DataFrame, triage: DataFrame, logs: DataFrame) -> DataFrame:
    """Priority cascade: triaged -> completed; else a failed log -> failed; else processing.

    Both EXISTS tests collapse into one keyed aggregation over the union of
    evidence rows (priority 1 = triage, 2 = failed log), followed by a single
    left join: one shuffle per side instead of two correlated subqueries.
    """
    evidence = (triage.select("email_id", F.lit(1).alias("p"))
                .unionByName(logs.where(F.col("status") == "failed").select("email_id", F.lit(2).alias("p")))
                .groupBy("email_id").agg(F.min("p").alias("p")))
    return (emails.select("id")
            .join(evidence, emails["id"] == evidence["email_id"], "left")
            .select("id",
                    F.when(F.col("p") == 1, "completed").when(F.col("p") == 2, "failed")
                     .otherwise("processing").alias("pipeline_status")))
